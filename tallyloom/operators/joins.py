"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20
NULL_PARTS = 4096


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``large`` to ``small``, splitting each key with more than ``hot_rows`` rows.

    The hot keys are found by a count with map-side combine.  There can be at most
    rows / ``hot_rows`` of them, which is the proven bound for broadcasting their list.  A hot
    key's rows are spread over parts by a hash of ``spread``; its few rows in ``small`` are copied
    to each part.  The result keeps the part number as ``__salt`` so that a following aggregate can
    group by (key, __salt) in place before the final group by key.
    """
    on = list(on)
    parts = F.broadcast(
        large.groupBy(*on)
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__parts"))
    )
    n_parts = F.coalesce(F.col("__parts"), F.lit(1))
    has_null = reduce(or_, [F.col(k).isNull() for k in on])
    # a null key matches nothing, so its rows may go anywhere
    left = (
        large.join(parts, on=on, how="left")
        .withColumn("__parts", F.when(has_null, F.lit(NULL_PARTS)).otherwise(n_parts))
        .withColumn("__salt", F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int"))
        .drop("__parts")
    )
    right = (
        small.join(parts, on=on, how="left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        .drop("__parts")
    )
    return left.join(right, on=[*on, "__salt"], how=how)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table that must be small; more than ``limit`` rows is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
