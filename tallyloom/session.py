"""Session helpers shared by the entry points, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def local_session(
    cpus: int | str = 8, memory: str = "16g", app: str = "tallyloom", shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which do not share the driver's import path.

    The archive goes through Spark's own file service, so no shared folder is needed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tallyloom_package.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only when it is unset in a local
    session, where driver and executors are one process, is a folder on this machine used instead; it
    goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, purpose: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table in the shared folder, and aggregates observed while it is written.

    Iterations cut their lineage this way: a round reads the table of the round before.
    """
    spark, path, seen = df.sparkSession, shared_dir(df.sparkSession, purpose), Observation()
    rows = df.observe(seen, *[value.alias(name) for name, value in aggregates.items()]) if aggregates else df
    rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if aggregates else {}


@cache
def _local_dir() -> str:
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
