"""Latency, throughput and value distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.ordered import pick_positions


def _wide(picked: DataFrame, group: Sequence[str], value: str, labels: Sequence[str]) -> DataFrame:
    return picked.groupBy(*group).agg(
        *[F.max(F.when(F.col("label") == label, F.col(value))).alias(label) for label in labels]
    )


def latency(runs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, extremes and percentiles, where pQ is the sorted value at index floor(n * Q)."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    wanted = {label: F.floor(F.col("n") * F.lit(q)) for label, q in shares.items()}
    picked = _wide(pick_positions(runs, group, value, wanted), group, value, list(shares))
    basics = runs.groupBy(*group).agg(
        F.count(value).alias("runs"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basics.join(picked, list(group), "left")


def throughput(log: DataFrame, group: Sequence[str], order: str, ts: str, warmup: int = 10) -> DataFrame:
    """Samples per second of each group, without its first ``warmup`` samples.

    Only the first rows of each group are ranked; the rest is counted.
    """
    first = (
        log.withColumn("__nth", F.row_number().over(W.partitionBy(*group).orderBy(order)))
        .where(F.col("__nth") <= warmup + 1)
        .where(F.col("__nth") == warmup + 1)
        .select(*group, F.col(ts).alias("__start"))
    )
    whole = log.groupBy(*group).agg(F.count("*").alias("__n"), F.max(ts).alias("__end"))
    seconds = (F.unix_micros("__end") - F.unix_micros("__start")) / 1e6
    samples = F.greatest(F.col("__n") - warmup, F.lit(0))
    return whole.join(first, list(group), "left").select(
        *group,
        samples.alias("samples"),
        seconds.alias("elapsed"),
        (samples / F.nullif(seconds, F.lit(0.0))).alias("throughput"),
    )


def describe(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles."""
    if not group:
        return describe(df.select(F.lit(0).alias("__all"), value), ["__all"], value).drop("__all")
    wanted = {}
    for label, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = (F.col("n") - 1) * q
        wanted[f"{label}_lo"], wanted[f"{label}_hi"] = F.floor(at), F.ceil(at)
    picked = _wide(pick_positions(df, group, value, wanted), group, value, list(wanted))
    basics = df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )

    def between(label: str, q: float) -> Column:
        at = (F.col("n") - 1) * q
        low, high = F.col(f"{label}_lo"), F.col(f"{label}_hi")
        return (low + (high - low) * (at - F.floor(at))).alias(label)

    return basics.join(picked, list(group), "left").select(
        *group, "n", "mean", "std", "min", between("p25", 0.25), between("p50", 0.5), between("p75", 0.75), "max"
    )


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal-width bin of a value; the last bin is closed, a constant column is widened by 1."""
    flat = low == high
    start, width = F.when(flat, low - 0.5).otherwise(low), F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.least(F.floor((value - start) / width * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts of all bins over the whole column, empty bins included."""
    given = df.where(F.col(value).isNotNull())
    low, high = given.agg(F.min(value)).scalar(), given.agg(F.max(value)).scalar()
    counts = given.groupBy(bin_number(F.col(value), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    frame = given.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")).select(
        F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    step = (F.col("high") - F.col("low")) / bins
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * step).alias("bin_low"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def logged_distribution(logged: DataFrame, keys: Sequence[str], values: str, bins: int = 20) -> DataFrame:
    """The histogram of each logged array of values; only filled bins have a row."""
    low, high = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    unfolded = logged.select(*keys, low.alias("__lo"), high.alias("__hi"), F.explode(values).alias("__v"))
    at = bin_number(F.col("__v").cast("double"), F.col("__lo"), F.col("__hi"), bins)
    return unfolded.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def availability(status: DataFrame, category: str, healthy: Column) -> DataFrame:
    return status.groupBy(category).agg(F.count_if(healthy).alias("healthy"), F.count("*").alias("total"))
