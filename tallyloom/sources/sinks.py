"""Writers for record files, notes and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One JSON object per row; nulls are kept and texts stay as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def replace_dataset(df: DataFrame, path: str) -> str:
    """Write a data set in place of one with the same name."""
    df.write.mode("overwrite").parquet(path)
    return path


# The columns of a manifest; what differs from kind to kind is held as variants.
MANIFEST = (
    "id string, type string, name string, created_at string, parent_collection_id string, input_dir string,"
    " output_dir string, source variant, params variant, counts variant, git variant, config variant"
)
NESTED = ("source", "params", "counts", "git", "config")


# Types whose JSON text is the same from a struct as from a variant.
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _as_variant_text(value: Column, kind: T.DataType) -> Column | None:
    """A struct of plain values whose JSON text is its variant's, with sorted keys; None if there is none."""
    if isinstance(kind, _PLAIN):
        return value
    if not isinstance(kind, T.StructType) or not kind.fields:
        return None
    fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
    parts = [(f.name, _as_variant_text(value.getField(f.name), f.dataType)) for f in fields]
    if any(part is None for _, part in parts):
        return None
    return F.when(value.isNotNull(), F.struct(*[part.alias(name) for name, part in parts]))


def manifests(rows: DataFrame, text_only: bool = False) -> DataFrame:
    """Rows as whole manifests: structs become variants, and columns that a kind lacks are null.

    With ``text_only`` structs stay structs where that gives the same JSON text, which is far cheaper.
    """
    given = {f.name: f.dataType for f in rows.schema.fields}
    columns = []
    for field in MANIFEST.split(", "):
        name, kind = field.split()
        if name not in given:
            column = F.lit(None).cast(kind)
        elif kind == "variant" and text_only and (plain := _as_variant_text(F.col(name), given[name])) is not None:
            column = plain
        elif kind == "variant":
            column = F.col(name) if given[name].simpleString() == "variant" else F.to_variant_object(name)
        else:
            column = F.col(name).cast(kind)
        columns.append(column.alias(name))
    return rows.select(*columns)


def manifest_text(row_type: str = "collection") -> Column:
    """A manifest as one JSON document, with the fields of its kind."""
    own = ("source", "output_dir") if row_type == "collection" else ("parent_collection_id", "input_dir", "output_dir", "params")
    return F.to_json(F.struct("id", "type", "name", "created_at", *own, "counts", "git", "config"), {"ignoreNullFields": "false"})


def append_manifests(rows: DataFrame, table_path: str, sidecar_path: str | None = None) -> str:
    """Add whole manifests to the table and, if asked, a JSON document per manifest beside its data.

    Sidecars are rows (path, content) of one table, named by the manifest's output folder.
    """
    whole = manifests(rows)
    whole.write.mode("append").parquet(table_path)
    if sidecar_path:
        content = F.when(F.col("type") == "collection", manifest_text()).otherwise(manifest_text("annotation"))
        place = F.concat("output_dir", F.lit("/"), "type", F.lit("_manifest.json"))
        manifests(rows, text_only=True).select(place.alias("path"), content.alias("content")).write.mode("append").parquet(sidecar_path)
    return table_path


# What a caption sidecar is called after the stem of its image; metadata sidecars are <stem>.json.
CAPTION_ENDS = {"txt": ".txt", "json": ".caption.json"}


def captions(results: DataFrame, path: str, form: str = "jsonl") -> str:
    """Caption results as sidecars, (file name, content) rows of txt or json form, below ``path``/sidecars.

    The jsonl form writes one JSON line per result below ``path``/lines, and txt sidecars as well.
    Sidecars stay rows of one table: a folder of very many small files is slow to write and read.
    """
    if form == "jsonl":
        json_lines(results, f"{path}/lines", "overwrite")
    kind = "txt" if form == "jsonl" else form
    done = results.where(F.col("error").isNull())
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    content = F.col("caption") if kind == "txt" else F.to_json(F.struct(*done.columns), {"ignoreNullFields": "false"})
    rows = done.select(F.concat(stem, F.lit(CAPTION_ENDS[kind])).alias("filename"), content.alias("content"))
    rows.write.mode("overwrite").parquet(f"{path}/sidecars")
    return path


def notes(rows: DataFrame, path: str) -> str:
    """(filename, content) rows, added to those already there; existing names are not replaced."""
    try:
        existing = rows.sparkSession.read.schema("filename string, content string").parquet(path)
        rows = rows.join(existing.select("filename"), "filename", "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)
    return path
