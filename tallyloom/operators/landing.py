"""Landing records: numbering, limits, required columns, splitting into labelled tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators.ordered import positions

RESERVED = ("id", "text", "text_length", "timestamp")


def land_text(df: DataFrame, order: str, text: str = "text", limit: int = 0) -> DataFrame:
    """Number records from 0 along the unique key ``order`` (of any type), keep the first ``limit`` numbers, drop
    missing texts.

    A record without text still uses up its number.  ``limit`` <= 0 keeps all.  Only the keys are
    numbered; the texts move once, spread evenly by key, and not at all for a small ``limit``.
    """
    numbers = positions(df.select(order), [order], "__n").select(order, (F.col("__n") - 1).alias("__id"))
    if limit > 0:
        numbers = numbers.where(F.col("__id") < limit)
    rest = [c for c in df.columns if c not in (text, "id")]
    return (
        df.where(F.col(text).isNotNull())
        .join(numbers, order)
        .select(
            F.col("__id").alias("id"), F.col(text).alias("text"), F.char_length(text).alias("text_length"), *rest
        )
    )


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows along an order key."""
    return df.orderBy(*order).limit(n)


def land_media(df: DataFrame, order: str, payload: str, limit: int = 0) -> DataFrame:
    """Keep records that have a payload, at most ``limit`` of them, without the payload itself.

    Unlike texts, only kept records count towards the limit.  ``limit`` <= 0 keeps all.
    """
    kept = df.where(F.col(payload).isNotNull())
    if limit > 0:
        kept = head(kept, [order], limit)
    return kept.drop(payload)


def landing_counts(df: DataFrame, payload: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count(payload).alias("kept"),
        F.count_if(F.col(payload).isNull()).alias("skipped"),
    )


def clause_columns(df: DataFrame, reserved: Sequence[str] = RESERVED) -> list[str]:
    """Every column that is not reserved holds the label of one clause category."""
    return [c for c in df.columns if c not in reserved]


def clause_tasks(
    contracts: DataFrame,
    threshold: int = 3,
    carry: Sequence[str] = (),
    derive: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One task per contract and clause category, made in place without a shuffle.

    The contract text is left out so that tasks stay narrow.  ``carry`` names other columns that travel with
    the tasks; ``derive`` makes further ones from the category (and any column, such as the text) before the
    tasks are unfolded, so that a long text is not copied once per category.
    """
    fields = {f.name: f.dataType for f in contracts.schema.fields}
    tasks = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("clause_category"),
                    F.col(c).cast("string").alias("label"),
                    tx.yes_no(F.col(c), fields[c]).alias("truth"),
                    *[make(F.lit(c)).alias(name) for name, make in (derive or {}).items()],
                )
                for c in clause_columns(contracts)
            ]
        )
    )
    keep = list(carry)
    return contracts.select(F.col("id").alias("contract_id"), *keep, tasks.alias("__task")).select(
        "contract_id",
        *keep,
        "__task.*",
        F.lit("clause_identification").alias("task_type"),
        F.lit(threshold).alias("voting_threshold"),
    )


def present_categories(contracts: DataFrame) -> Column:
    """Sorted categories that are true for at least one contract, as an aggregate."""
    fields = {f.name: f.dataType for f in contracts.schema.fields}
    return F.sort_array(
        F.filter(
            F.array(
                *[
                    F.when(F.bool_or(tx.truthy(F.col(c), fields[c])), F.lit(c))
                    for c in clause_columns(contracts)
                ]
            ),
            lambda c: c.isNotNull(),
        )
    )


def collection_stats(contracts: DataFrame) -> DataFrame:
    """One row of totals in one pass; an empty collection is an error."""
    total = F.count("*")
    return contracts.agg(
        F.when(total > 0, total).otherwise(F.raise_error(F.lit("no samples collected"))).alias("total_samples"),
        present_categories(contracts).alias("clause_categories"),
        F.coalesce(F.sum("text_length"), F.lit(0)).alias("total_text_length"),
        (F.coalesce(F.sum("text_length"), F.lit(0)) / F.greatest(total, F.lit(1))).alias("avg_text_length"),
    )


def collection_metadata(contracts: DataFrame, dataset: str, split: str, as_of: Column, output_file: str) -> DataFrame:
    """The metadata document of a collection, as one row in the order of its fields."""
    stats = collection_stats(contracts)
    return stats.select(
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("download_date"),
        "total_samples",
        "clause_categories",
        F.size("clause_categories").alias("num_categories"),
        F.round("avg_text_length", 2).cast("decimal(18,2)").alias("avg_text_length"),
        F.lit(output_file).alias("output_file"),
    )


def task_config(tasks: DataFrame, voting_threshold: int, granularity: str, as_of: Column) -> DataFrame:
    """The configuration document of a task file, as one row."""
    return tasks.agg(
        F.lit(voting_threshold).alias("voting_threshold"),
        F.lit(granularity).alias("granularity"),
        F.count("*").alias("total_tasks"),
        F.date_format(F.max(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def dataset_cards(df: DataFrame, name: str) -> DataFrame:
    """A short card per data set: its size and fields."""
    fields = "\n".join(f"- `{c}`" for c in df.columns)
    content = F.concat(
        F.lit("# Dataset: "),
        F.col(name),
        F.lit("\n\n**Samples:** "),
        F.count("*").cast("string"),
        F.lit(f"\n\n## Fields\n\n{fields}"),
    )
    return df.groupBy(name).agg(content.alias("content"))
