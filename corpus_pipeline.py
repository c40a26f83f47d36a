"""From raw documents to token ids: rules, duplicates, benchmark leaks, personal data, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs.  Rejected documents go; the text changes where personal data is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, near_dups, pii, quality, templates
from tallyloom.llm.common import written
from tallyloom.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rules' weighed votes keep."""
    ship(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8)."""
    ship(spark)
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which an item of the benchmark is found."""
    ship(spark)
    return templates.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    ship(spark)
    clean = pii.redacted(docs, pii.Redactor.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    ship(spark)
    return bpe.encoded(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dups", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

# votes weighed by estimation, MinHash and byte-pair merges have no SQL form; tests/llm checks the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
