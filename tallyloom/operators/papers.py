"""The paper library: search, notes, exports, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx


def search(papers: DataFrame, query: str) -> DataFrame:
    """Papers whose title contains the query, in any case."""
    return papers.where(F.contains(F.lower("title"), F.lit(query.lower())))


def tag_list(tags: Column) -> Column:
    """Tags given as a JSON list; a text that is no list gives no tags."""
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def note_name(year: Column, title: Column, key: Column) -> Column:
    """The note's file name: a short slug to read, and the paper's id, which no other paper has."""
    slug = F.substring(tx.slug(title), 1, 50)
    return F.concat(year.cast("string"), F.lit("-"), slug, F.lit("-"), key.cast("string"), F.lit(".md"))


# The layout of a paper note.
PAPER_NOTE = """---
type: paper
title: "{{title}}"
authors: "{{authors}}"
year: {{year}}
doi: "{{doi}}"
status: unread
tags:
  - paper
  - auto-generated
{{tags}}
---

# {{title}}

**Authors:** {{authors}}
**Year:** {{year}}
{{doi_line}}

## Abstract

{{abstract}}
"""
NO_ABSTRACT = "*No abstract available*"


def notes(papers: DataFrame) -> DataFrame:
    doi = F.col("doi")
    line = F.when(doi != "", F.concat(F.lit("**DOI:** ["), doi, F.lit("](https://doi.org/"), doi, F.lit(")")))
    tags = F.array_join(F.transform(tag_list(F.col("tags")), lambda t: F.concat(F.lit("  - "), t)), "\n")
    content = tx.fill_template(
        PAPER_NOTE,
        {
            "title": F.col("title"),
            "authors": F.col("authors"),
            "year": F.col("year").cast("string"),
            "doi": doi,
            "tags": tags,
            "doi_line": line,
            "abstract": F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.lit(NO_ABSTRACT)),
        },
    )
    return papers.select(note_name(F.col("year"), F.col("title"), F.col("id")).alias("filename"), content.alias("content"))


def bibtex(papers: DataFrame) -> DataFrame:
    entry = F.concat(
        F.lit("@article{paper"),
        F.col("id").cast("string"),
        F.lit(",\n  title = {"),
        F.col("title"),
        F.lit("},\n  author = {"),
        F.col("authors"),
        F.lit("},\n  year = {"),
        F.col("year").cast("string"),
        F.lit("}\n}"),
    )
    return papers.select("id", entry.alias("bibtex"))


def markdown(papers: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("## "), "title", F.lit("\n\n"), "authors", F.lit(" ("), F.col("year").cast("string"), F.lit(")")
    )
    return papers.select("id", line.alias("markdown"))


def year_counts(papers: DataFrame) -> DataFrame:
    """Papers per year, with the total on the row whose year is NULL."""
    return papers.rollup("year").agg(F.count("*").alias("n"))


def upsert(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """Add new papers and replace those with the same id."""
    return papers.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def delete(papers: DataFrame, ids: DataFrame) -> DataFrame:
    return papers.join(ids.select("id"), "id", "left_anti")
