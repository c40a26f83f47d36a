"""Incremental jobs: handle what is new since the last check, each item once.

The checkpoint of a query holds what was seen.  A one-shot check uses ``availableNow``; a daemon
gives an interval; fresh checkpoint and output folders start over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_files(
    spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet", per_check: int | None = 1000
) -> DataFrame:
    """A stream of the rows of parquet files as they arrive in a folder; without ``per_check`` a check takes all new ones."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", per_check) if per_check else reader).parquet(path)


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def collect_new(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the rows of a stream to a parquet table, exactly once.

    The table keeps its own list of finished batches, so starting over needs a fresh checkpoint and
    a fresh table.
    """
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start(out)
    )


def run_once(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def after_baseline(stream: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Only items that did not exist when the watch began."""
    return stream.join(baseline.select(key), key, "left_anti")


def first_of_key(stream: DataFrame, keys: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """One row per key, however late a repeat comes: the state holds every key.

    With ``ts`` and ``late`` the state is bounded instead, and a repeat that comes later than that after
    the first counts as new.
    """
    if ts is None or late is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def metric_parts(
    stream: DataFrame, ts: str, keys: list[str], value: str, width: str, out: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append each batch's sums per key and time window; no event is too late for them.

    A batch writes one row per key and window it touches, and a repeated batch replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.window(ts, width).alias("window"), *keys).agg(
            F.sum(value).alias("sum"), F.max(value).alias("max"), F.count(value).alias("n"), F.max(ts).alias("latest")
        )
        rows = sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "sum", "max", "n", "latest")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).start()


def merged_metrics(parts: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Mean, maximum and number per key and window of all batches so far.

    ``closed`` tells the windows that ended at least ``late`` before the latest event.
    """
    newest = parts.agg(F.max("latest").alias("m")).select(F.col("m") - F.expr(f"interval {late}")).scalar()
    done = parts.groupBy("start", "end", *keys).agg(
        (F.sum("sum") / F.sum("n")).alias("mean"), F.max("max").alias("max"), F.sum("n").alias("n")
    )
    return done.withColumn("closed", F.col("end") <= newest)


def sync_sources(
    stream: DataFrame,
    good: Column,
    writers: dict[str, Callable[[DataFrame], DataFrame]],
    out: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Write several tables from each batch; rows that fail ``good`` go to a reject table.

    Each batch has its own folder per table, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__good", F.coalesce(good, F.lit(False))).persist()
        try:
            kept = marked.where("__good").drop("__good")
            for name, build in writers.items():
                build(kept).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            marked.where("NOT __good").drop("__good").write.mode("overwrite").parquet(
                f"{out}/rejected/batch={number}"
            )
        finally:
            marked.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )
