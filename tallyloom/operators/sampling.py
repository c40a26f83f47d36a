"""Repeatable samples, splits and text windows.  Order comes from a hash, not from file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def shuffled_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded random order; the same rows however the data is partitioned."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def train_split(df: DataFrame, key: str, percent: int = 90, seed: int = 42) -> DataFrame:
    """Mark each row train or validation by its hash (documented only)."""
    bucket = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < percent, "train").otherwise("validation"))


def stratified_sample(df: DataFrame, key: str, label: str, per_class: int, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` rows of each class, so that rare classes weigh more (documented only)."""
    order = W.partitionBy(label).orderBy(seeded_hash(key, seed), key)
    return df.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= per_class).drop("__nth")


def text_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Cut each text into windows of ``size`` characters that overlap (documented only).

    Every character is in a window; the last window may be shorter.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.char_length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / step).cast("int"))
    cut = F.transform(
        starts, lambda w: F.struct(w.alias("window"), F.substr(F.col(text), w * step + 1, F.lit(size)).alias("window_text"))
    )
    # cut before unfolding: the text itself is not copied to its windows unless it is asked for
    return df.select("*", F.inline(cut))
