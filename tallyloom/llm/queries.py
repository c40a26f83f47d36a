"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import (
    bpe,
    fingerprints,
    language,
    licenses,
    near_dups,
    periods,
    pii,
    prefix_trie,
    quality,
    substrings,
    templates,
    token_files,
    urls,
)
from tallyloom.session import ship


def _over(build: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables])

    run.__doc__ = build.__doc__
    return run


QUERIES = {
    "op1_language": _over(language.language_query, "documents"),
    "op2_pii": _over(pii.pii_query, "documents"),
    "op3_urls": _over(urls.url_query, "pages"),
    "op4_substrings": _over(substrings.substring_query, "documents"),
    "op5_licenses": _over(licenses.license_query, "documents"),
    "op6_token_files": _over(token_files.token_file_query, "documents"),
    "op7_near_dups": _over(near_dups.near_duplicate_query, "documents"),
    "op8_quality": _over(quality.quality_query, "documents"),
    "op9_bpe": _over(bpe.bpe_query, "documents"),
    "op10_decontamination": _over(templates.leak_query, "documents", "benchmark"),
    "op11_prefix_trie": _over(prefix_trie.trie_query, "conversations"),
    "op12_periods": _over(periods.period_query, "documents"),
    "op13_fingerprints": _over(fingerprints.fingerprint_query, "documents"),
}
# Language and quality are estimated, spans are learned, and the others iterate, hash or tokenize:
# tests/llm holds them against brute force, the library or held-out rows instead.
ORACLES = {"op3_urls": urls.oracle_sql(), "op11_prefix_trie": prefix_trie.oracle_sql()}
