"""Markdown notes about manifests, models, papers, data sets and runs: one (filename, content) row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx

# The layouts of the notes.
MODEL_NOTE = """---
type: model-registry
model_id: "{{model_id}}"
version: "{{version}}"
image_digest: "{{digest}}"
created: "{{date}}"
stage: {{stage}}
run_id: "{{run_id}}"
tags: []
---

# Model: {{model_id}}

## Registry Info
- **Image:** {{registry}}/{{model_id}}:{{version}}
- **Digest:** {{digest}}
- **Run:** [[experiments/runs/{{run_id}}]]
"""
STUB_NOTE = """---
type: paper
title: "{{name}}"
authors: []
year:
url:
pdf: "[[papers/pdfs/{{file}}]]"
tags: []
---

# {{name}}
"""
DATASET_NOTE = """---
type: dataset
dataset_id: "{{name}}"
created: "{{date}}"
version: "1.0"
manifest: "[[datasets/manifests/{{file}}]]"
tags: []
---

# Dataset: {{name}}

## Statistics
{{stats}}
"""
EMPTY_STATS = "| Stat | Value |\n|------|-------|\n| Samples | |\n| Classes | |"
INDEX_HEAD = """---
type: index
tags: [experiments]
---

# Experiments Index

## Recent Experiments

"""


def model_notes(versions: DataFrame, registry_host: str, day: str) -> DataFrame:
    """A note per registered version (name, version, digest, stage, run_hash)."""
    content = tx.fill_template(
        MODEL_NOTE,
        {
            "model_id": F.col("name"),
            "version": F.col("version"),
            "digest": F.col("digest"),
            "date": F.lit(day),
            "stage": F.col("stage"),
            "run_id": F.substring("run_hash", 1, 8),
            "registry": F.lit(registry_host),
        },
    )
    name = F.concat(tx.slug(F.col("name")), F.lit("-"), "version", F.lit(".md"))
    return versions.select(name.alias("filename"), content.alias("content"))


def paper_stubs(files: DataFrame, stem: Column, file: Column) -> DataFrame:
    """An empty note for each paper file."""
    content = tx.fill_template(STUB_NOTE, {"name": stem, "file": file})
    return files.select(F.concat(stem, F.lit(".md")).alias("filename"), content.alias("content"))


def dataset_notes(manifests: DataFrame, name: Column, numbers: Column, day: str) -> DataFrame:
    """A card per manifest with its statistics; one that cannot be read gets an empty table."""
    table = F.coalesce(tx.markdown_table(numbers, EMPTY_STATS), F.lit(EMPTY_STATS))
    content = tx.fill_template(
        DATASET_NOTE,
        {"name": name, "file": F.concat(name, F.lit(".json")), "date": F.lit(day), "stats": table},
    )
    return manifests.select(F.concat(name, F.lit(".md")).alias("filename"), content.alias("content"))


def manifest_notes(manifests: DataFrame) -> DataFrame:
    """A note per manifest, sorted into folders by type; empty fields are left out of its head."""
    quote = F.lit('"')

    def line(key: str, column: str, json: bool = False) -> Column:
        value = F.col(column) if json else F.concat(quote, F.col(column), quote)
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{key}: "), value))

    parent = F.when(
        F.col("parent_collection_id").isNotNull(),
        F.concat(F.lit('"[[collections/'), "parent_collection_id", F.lit(']]"')),
    ).otherwise(F.lit("null"))
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        line("id", "id"),
        line("type", "type"),
        line("name", "name"),
        line("output_dir", "output_dir"),
        line("counts", "counts", json=True),
        line("parent_collection_id", "parent_collection_id"),
        F.concat(F.lit('links: {"collection": '), parent, F.lit("}")),
        F.lit("---"),
    )
    body = F.concat(
        F.lit("\n# "),
        F.coalesce("name", "id"),
        F.lit("\n\n**Type:** "),
        "type",
        F.lit("\n**Output:** "),
        F.coalesce("output_dir", F.lit("None")),
        F.lit("\n\n## Counts\n"),
        F.coalesce("counts", F.lit("{}")),
        F.lit("\n"),
    )
    return manifests.select(
        F.concat(F.col("type"), F.lit("s/"), "id", F.lit(".md")).alias("filename"),
        F.concat(head, body).alias("content"),
    )


def index_note(newest: DataFrame) -> DataFrame:
    """One note that lists the rows of ``experiment_index`` (a short report by its own limit)."""
    lines = F.array_join(
        F.transform(
            F.sort_array(F.collect_list("name"), asc=False), lambda n: F.concat(F.lit("- [["), n, F.lit("]]\n"))
        ),
        "",
    )
    total = F.coalesce(F.max("total"), F.lit(0)).cast("string")
    content = F.concat(
        F.lit(INDEX_HEAD), lines, F.lit("\n## Statistics\n\n- **Total Experiments:** "), total, F.lit("\n")
    )
    return newest.agg(F.lit("experiments-index.md").alias("filename"), content.alias("content"))
