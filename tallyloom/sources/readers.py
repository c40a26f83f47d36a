"""Readers for record files, sidecars, manifests, media folders and run stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import paths as px
from tallyloom.sources import json_arrays


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def media_folder(spark: SparkSession, path: str, extensions: Sequence[str], recursive: bool = True) -> DataFrame:
    """Path, size and time of the media files of a folder; their content is never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")
    )
    return files.where(px.has_extension(F.col("path"), extensions))


def object_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder as an object listing: key below the folder, size, last modification."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{path.rstrip('/')}/", "")
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def whole_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """One row per file with its path, stem, path without extension, and whole text."""
    files = (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), "value")
    )
    path = F.col("path")
    return files.select("path", px.stem(path).alias("stem"), px.base(path).alias("base"), F.col("value").alias("text"))


def caption_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, "*.txt").select("path", "stem", "base", F.trim("text").alias("caption"))


def json_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as text with the parsed value; unreadable ones have NULL."""
    return whole_texts(spark, path, "*.json").select(
        "path", "stem", "base", F.col("text").alias("json"), F.try_parse_json("text").alias("value")
    )


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files with their main fields; files that cannot be read are left out."""

    def field(name: str) -> Column:
        return F.try_variant_get("value", f"$.{name}", "string").alias(name)

    return (
        json_sidecars(spark, path)
        .where(F.col("value").isNotNull())
        .select(
            "path",
            "json",
            *[field(n) for n in ("id", "type", "name", "created_at", "input_dir", "output_dir", "parent_collection_id")],
        )
    )


def list_items(json: Column, key: str) -> Column:
    """The texts of a JSON list, given bare or under ``key`` of an object."""
    inner = F.get_json_object(json, f"$.{key}")
    body = F.when(F.startswith(F.ltrim(json), F.lit("[")), json).otherwise(inner)
    return F.from_json(body, "array<string>")


def text_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Texts with their position from JSON files: an object with ``key``, or a bare list, of any size."""
    items = json_arrays.items(spark, path).where(F.col("section").isNull() | (F.col("section") == key))
    text = F.get(F.from_json(F.concat(F.lit("["), F.col("item"), F.lit("]")), "array<string>"), 0)
    return items.select("pos", text.alias(key))


def annotation_count(spark: SparkSession, path: str) -> DataFrame:
    """How many annotations the JSON exports of a folder hold."""
    return count_annotations(whole_texts(spark, path, "*.json"), "text")


def count_annotations(exports: DataFrame, json: str) -> DataFrame:
    items = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.size(F.from_json(json, "array<variant>")))
    return exports.agg(F.coalesce(F.sum(items), F.lit(0)).alias("annotations"))
