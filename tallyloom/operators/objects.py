"""Object listings: prefix scans, lookups, sync differences, key mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def list_prefix(objects: DataFrame, prefix: str, page: int | None = None, after: str | None = None) -> DataFrame:
    """All objects below a prefix, or a page of them in key order that starts after a key."""
    found = objects.where(F.startswith("key", F.lit(prefix)))
    if after is not None:
        found = found.where(F.col("key") > after)
    return found if page is None else found.orderBy("key").limit(page)


def look_up(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Metadata of the asked keys, with whether they exist."""
    return keys.select("key").join(objects, "key", "left").withColumn("exists", F.col("size").isNotNull())


def to_upload(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local objects that are missing in the remote listing or differ in size."""
    theirs = remote.select("key", F.col("size").alias("remote_size"))
    joined = local.join(theirs, "key", "left")
    return joined.where(F.col("remote_size").isNull() | (F.col("remote_size") != F.col("size"))).withColumn(
        "cause", F.when(F.col("remote_size").isNull(), "missing").otherwise("size differs")
    )


def to_delete(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote objects without a local one; an option without a caller so far."""
    return remote.join(local.select("key"), "key", "left_anti")


def remote_key(prefix: str, relative: Column) -> Column:
    return F.replace(F.concat(F.lit(f"{prefix}/"), relative), F.lit("\\"), F.lit("/"))


def local_path(prefix: str, key: Column, target: str) -> Column:
    relative = F.ltrim(F.substr(key, F.lit(len(prefix) + 1)), F.lit("/"))
    return F.concat(F.lit(f"{target}/"), relative)
