"""Data quality: expectation suites, duplicates, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the two expectation types.
COLUMN_EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"


def run_suite(df: DataFrame, suite: str, expectations: Sequence[tuple[str, str]]) -> DataFrame:
    """Check all expectations (type, column) in one pass; one result row each.

    ``unexpected`` counts the rows that break the expectation and ``fraction`` their share.
    """
    total = F.count("*")
    results = []
    for kind, column in expectations:
        exists = column in df.columns
        if kind == COLUMN_EXISTS:
            unexpected = F.lit(0).cast("long") if exists else total
        elif kind == NOT_NULL:
            unexpected = F.count_if(F.col(column).isNull()) if exists else total
        else:
            raise ValueError(f"unknown expectation: {kind}")
        passed = F.lit(exists) & (unexpected == 0) if exists else F.lit(False)
        results.append(
            F.struct(
                F.lit(suite).alias("suite"),
                F.lit(kind).alias("expectation"),
                F.lit(column).alias("column"),
                unexpected.alias("unexpected"),
                F.coalesce(unexpected / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("fraction"),
                passed.alias("passed"),
            )
        )
    return df.agg(F.array(*results).alias("r")).select(F.inline("r"))


def duplicate_groups(df: DataFrame, content: Column) -> DataFrame:
    """Hash and size of each group of equal contents; only the hashes are moved."""
    return (
        df.groupBy(F.md5(content).alias("content_hash"))
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def curation_checks(df: DataFrame, content: str, label: str, min_share: float) -> DataFrame:
    """One row of the checks a data set must pass (documented only)."""
    text = F.col(content)
    copies = df.groupBy(F.md5(text).alias("h")).agg(F.count("*").alias("n"))
    repeated = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    share = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n") / F.sum("n")).scalar()
    unreadable = F.count_if(text.isNull() | (F.trim(text) == "") | F.contains(text, F.lit("�")))
    return df.agg(F.count("*").alias("rows"), unreadable.alias("corrupted")).select(
        "rows",
        "corrupted",
        repeated.alias("duplicates"),
        share.alias("smallest_share"),
        (share >= min_share).alias("balanced"),
    )
