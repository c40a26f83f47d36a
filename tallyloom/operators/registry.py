"""A versioned model registry as a table of version rows and a table of stage events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import salted_join
from tallyloom.operators.ordered import dense_position


def number_versions(entries: DataFrame, order: str = "seq") -> DataFrame:
    """v1, v2, … by registration order in each model; explicit versions keep their own name."""
    numbered = dense_position(entries, ["name"], order, "__n")
    auto = F.concat(F.lit("v"), F.col("__n"))
    explicit = F.col("version") if "version" in entries.columns else F.lit(None).cast("string")
    return numbered.withColumn("version", F.coalesce(explicit, auto)).drop("__n")


def model_info(versions: DataFrame) -> DataFrame:
    """Latest version, number of versions and registration span of each model."""
    return versions.groupBy("name").agg(
        F.max_by("version", "seq").alias("latest_version"),
        F.count("*").alias("n_versions"),
        F.min("seq").alias("created_seq"),
        F.max("seq").alias("updated_seq"),
    )


def resolve_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Turn requests (name, version or 'latest') into versions; an unknown one gives NULL."""
    info = model_info(versions).select("name", "latest_version")
    wanted = salted_join(requests, info, ["name"], F.col("request_id"), how="left").drop("__salt")
    asked = F.when(F.col("version") == "latest", F.col("latest_version")).otherwise(F.col("version"))
    known = versions.select("name", F.col("version").alias("resolved"), "stage", "seq")
    return salted_join(
        wanted.withColumn("resolved", asked), known, ["name", "resolved"], F.col("request_id"), how="left"
    ).select(
        "request_id",
        "name",
        F.when(F.col("seq").isNotNull(), F.col("resolved")).alias("version"),
        "stage",
    )


def delete_versions(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """The registry without some versions; the latest version follows from what is left."""
    return versions.join(deleted.select("name", "version"), ["name", "version"], "left_anti")


def current_stage(versions: DataFrame, events: DataFrame) -> DataFrame:
    """The stage of each version after all promotions; the last event wins."""
    last = events.groupBy("name", "version").agg(F.max_by("stage", "at").alias("__stage"))
    return (
        versions.join(last, ["name", "version"], "left")
        .withColumn("stage", F.coalesce("__stage", "stage"))
        .drop("__stage")
    )


def merge_indexes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The union of two registry indexes, one row per (model, version), with where it is known."""
    return (
        local.select("name", "version", F.lit(True).alias("__l"), F.lit(False).alias("__r"))
        .unionByName(remote.select("name", "version", F.lit(False).alias("__l"), F.lit(True).alias("__r")))
        .groupBy("name", "version")
        .agg(F.bool_or("__l").alias("in_local"), F.bool_or("__r").alias("in_remote"))
    )


def runs_with_models(runs: DataFrame, versions: DataFrame) -> DataFrame:
    return runs.select("run_hash", F.col("name").alias("run_name")).join(versions, "run_hash")


def artifact_sizes(files: DataFrame, model: Column) -> DataFrame:
    return files.groupBy(model.alias("model")).agg(F.sum("size").alias("size_bytes"), F.count("*").alias("files"))


def artifact_checksums(files: DataFrame) -> DataFrame:
    """The first 16 hex digits of SHA-256 over each artifact's file bytes in path order.

    ``files`` has artifact, path and content.  The digest is sequential by definition, so the files
    of an artifact meet in one sorted partition; they pass through in batches and only the digest
    state is kept, whatever the size of the artifact.  ``artifact_tree_checksums`` is the form for
    artifacts with very many files.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_name, state = None, None
        for batch in batches:
            done = []
            for name, content in zip(batch["artifact"], batch["content"]):
                if name != open_name:
                    if state is not None:
                        done.append((open_name, state.hexdigest()[:16]))
                    open_name, state = name, hashlib.sha256()
                state.update(content)
            if done:
                yield pd.DataFrame(done, columns=["artifact", "checksum"])
        if state is not None:
            yield pd.DataFrame([(open_name, state.hexdigest()[:16])], columns=["artifact", "checksum"])

    ordered = files.select("artifact", "path", F.col("content").cast("binary").alias("content"))
    return (
        ordered.repartition("artifact")
        .sortWithinPartitions("artifact", "path")
        .select("artifact", "content")
        .mapInPandas(digest, "artifact string, checksum string")
    )


def artifact_tree_checksums(files: DataFrame) -> DataFrame:
    """A checksum of file checksums: files are hashed where they lie and only digests are moved.

    Differs from ``artifact_checksums`` in value, not in purpose.  The digests are joined in three
    steps over the path hash (65,536 parts, 256 parts, one), so that no list grows with the files
    of one artifact.
    """

    def joined(items: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(items), lambda e: e["digest"]), ""), 256)

    level = files.select(
        "artifact", F.md5("path").alias("at"), "path", F.sha2(F.col("content").cast("binary"), 256).alias("digest")
    )
    for digits in (4, 2, 0):
        order = "path" if digits == 4 else "at"
        level = level.groupBy("artifact", F.substring("at", 1, digits).alias("part")).agg(
            joined(F.collect_list(F.struct(order, "digest"))).alias("digest")
        )
        level = level.withColumnRenamed("part", "at")
    return level.select("artifact", F.substring("digest", 1, 16).alias("tree_checksum"))
