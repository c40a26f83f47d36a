"""Small tables with the awkward rows that every operator must survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SENTENCES = (
    "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing.",
    "A careful reader checks every figure twice before the long report goes to the printer at noon.",
    "Old maps of the northern coast show harbours, cliffs and paths that nobody has walked for years.",
    "Rain fell on the market square all morning, yet the baker sold every loaf of bread by ten.",
    "She wrote three letters to her brother, folded them neatly, and left them under the blue lamp.",
)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows, odd characters."""
    prose = " ".join(SENTENCES)
    long_text = " ".join(f"{s} {n}" for n in range(400) for s in SENTENCES)
    rows = [
        (1, prose, "en", "a", len(prose)),
        (2, prose, "en", "a", len(prose)),
        (2, prose, "en", "a", len(prose)),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (5, " \n\t\r\n ", "en", "a", 6),
        (6, long_text, "en", "b", len(long_text)),
        (7, "x" * 200_000, "en", "b", 200_000),
        (8, "été à Noël, garçon naïf: ça va? \U0001f642\U0001f642 日本語 \x00\x01 ½²", "fr", "c", 10),
        (None, prose + " One more line.", None, None, None),
        (None, None, None, None, None),
        (None, prose + " One more line.", None, None, None),
        (-9, "Short text", "en", "", 10),
        (10, "1 2 3 " * 5000, "xx", "a", 30_000),
        (11, prose.upper(), "en", "a", len(prose)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def clashing(docs: DataFrame, *names: str) -> DataFrame:
    """The same rows with further columns that are named like those an operator adds."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("taken") for n in names})


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def key(row) -> tuple:
    return tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 9)) for v in row)


def same(one: DataFrame, other: DataFrame) -> bool:
    left, right = ([repr(key(r)) for r in df.collect()] for df in (one, other))
    return sorted(left) == sorted(right)
