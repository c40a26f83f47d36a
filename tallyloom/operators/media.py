"""Media curation: directory scans, sidecars, sample tables, work lists, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import paths as px
from tallyloom.operators.ordered import positions


def select_media(files: DataFrame, extensions: Sequence[str], hidden: bool = True) -> DataFrame:
    """Files with one of the extensions, in any case; ``hidden=False`` leaves dot files out."""
    keep = px.has_extension(F.col("path"), extensions)
    return files.where(keep if hidden else keep & ~px.is_hidden(F.col("path")))


def path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns(
        {
            "filename": px.file_name(path),
            "stem": px.stem(path),
            "base": px.base(path),
            "suffix": px.suffix(path),
            "source_dir": px.parent_name(path),
        }
    )


def sidecar_fields(json: Column) -> dict[str, Column]:
    """Fields of a metadata sidecar with their defaults; unreadable JSON gives the defaults.

    A field that is present but null also gets its default.
    """
    fields = {
        name: F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(""))
        for name in ("title", "author", "subreddit", "url")
    }
    fields["score"] = F.coalesce(
        F.get_json_object(json, "$.score").try_cast("long"), F.lit(0)
    )
    return fields


def readable(json: Column) -> Column:
    """TRUE if the text is a JSON object."""
    return F.coalesce(
        F.startswith(F.schema_of_variant(F.try_parse_json(json)), F.lit("OBJECT")), F.lit(False)
    )


def visual_samples(files: DataFrame, captions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images of a data set with their caption and metadata, where there are any.

    A sidecar belongs to the image of its own folder and stem: both sides meet on ``base``.
    """
    images = path_parts(select_media(files, px.DATASET_EXTENSIONS, hidden=False))
    found = captions.select("base", F.trim("caption").alias("caption"))
    meta = sidecars.where(readable(F.col("json"))).select(
        "base", *[c.alias(n) for n, c in sidecar_fields(F.col("json")).items()]
    )
    return images.join(found, "base", "left").join(meta, "base", "left")


def training_pairs(files: DataFrame, captions: DataFrame) -> DataFrame:
    """Images that have a caption in their own folder."""
    images = path_parts(select_media(files, px.PAIR_EXTENSIONS))
    return images.join(captions.select("base", F.trim("caption").alias("caption")), "base")


def media_counts(files: DataFrame, source: Column) -> DataFrame:
    kind = px.media_kind(F.col("path"))
    return files.groupBy(source.alias("source")).agg(
        F.count_if(kind == "image").alias("images"),
        F.count_if(kind == "video").alias("videos"),
        F.count_if(kind == "other").alias("other"),
    )


def processing_counts(results: DataFrame, error: str = "error") -> DataFrame:
    return results.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def annotation_tasks(files: DataFrame) -> DataFrame:
    """Labelling tasks, one per file, as an object with an empty list of predictions."""
    return files.select(
        F.struct(F.col("path").alias("image")).alias("data"),
        F.array().cast("array<string>").alias("predictions"),
    )


def min_resolution(files: DataFrame, pixels: int) -> DataFrame:
    """Files whose shorter side has enough pixels, with their aspect ratio (documented only)."""
    return files.where(F.least("width", "height") >= pixels).withColumn(
        "aspect_ratio", F.col("width") / F.col("height")
    )


def work_grid(files: DataFrame, order: str, patterns: Sequence[str], patch: tuple[int, int], seed: int) -> DataFrame:
    """Each sample with each pattern: running index, seed and the bounded centre position.

    The patterns are an argument list, unfolded in place.  ``patch`` is (height, width).
    """
    p_h, p_w = patch
    numbered = positions(files, [order], "__n")
    grid = numbered.select(
        "*", F.posexplode(F.array(*[F.lit(p) for p in patterns])).alias("__p", "pattern")
    )
    index = (F.col("__n") - 1) * len(patterns) + F.col("__p")
    top = F.expr(f"height div 2 - {p_h} div 2")
    left = F.expr(f"width div 2 - {p_w} div 2")
    return grid.select(
        *files.columns,
        "pattern",
        index.alias("sample_index"),
        (F.lit(seed) + index).alias("seed"),
        F.least(top, F.col("height") - p_h).alias("top"),
        F.least(left, F.col("width") - p_w).alias("left"),
    )


def prompt_work_list(prompts: DataFrame, order: str, seed: int | None) -> DataFrame:
    """Prompts numbered from 0 with their seed and output name; a zero or missing seed is NULL."""
    numbered = positions(prompts, [order], "__n").withColumn("index", F.col("__n") - 1)
    at = F.lit(seed) + F.col("index") if seed else F.lit(None).cast("long")
    return numbered.withColumns(
        {"seed": at, "output_name": F.format_string("generated_%04d.png", F.col("index"))}
    ).drop("__n")


# The captioning models, as (name, model id, type, fine-tuning, max length, beams).
MODEL_CATALOGUE = (
    ("blip-base", "Salesforce/blip-image-captioning-base", "blip", True, 50, 4),
    ("blip-large", "Salesforce/blip-image-captioning-large", "blip", True, 50, 4),
    ("blip2-opt", "Salesforce/blip2-opt-2.7b", "blip2", True, 100, 4),
    ("blip2-flan-t5", "Salesforce/blip2-flan-t5-xl", "blip2", True, 100, 4),
    ("git-base", "microsoft/git-base", "git", True, 50, 4),
    ("git-large", "microsoft/git-large", "git", True, 50, 4),
    ("git-large-coco", "microsoft/git-large-coco", "git", True, 50, 4),
    ("vit-gpt2", "nlpconnect/vit-gpt2-image-captioning", "vit-gpt2", True, 50, 4),
    ("tiny-vit-gpt2", "nlpconnect/vit-gpt2-image-captioning", "vit-gpt2", True, 30, 2),
    ("tiny-git", "microsoft/git-base", "git", True, 30, 2),
)
MODEL_ALIASES: Mapping[str, str] = {"blip": "blip-base", "blip2": "blip2-opt", "git": "git-base"}


def resolve_models(rows: DataFrame, model: str) -> DataFrame:
    """Look a model name or alias up in the catalogue (ten fixed rows, so it is broadcast).

    Unknown names keep their row, with ``known`` false.
    """
    catalogue = rows.sparkSession.createDataFrame(
        list(MODEL_CATALOGUE),
        "model_name string, model_id string, model_type string, supports_finetuning boolean,"
        " max_length int, num_beams int",
    )
    full = F.col(model)
    for alias, name in MODEL_ALIASES.items():
        full = F.when(F.col(model) == alias, F.lit(name)).otherwise(full)
    joined = rows.withColumn("model_name", full).join(F.broadcast(catalogue), "model_name", "left")
    return joined.withColumn("known", F.col("model_id").isNotNull())


def source_spec(names: Column, sort: str, time_range: str) -> Column:
    """Listing addresses for a comma list of communities."""
    query = f"?t={time_range}" if sort in ("top", "controversial") else ""
    return F.transform(
        F.split(names, ","),
        lambda n: F.concat(F.lit("https://reddit.com/r/"), F.trim(n), F.lit(f"/{sort}{query}")),
    )


def url_source_dir(url: Column) -> Column:
    return F.concat(F.lit("url_"), F.substring(F.md5(url), 1, 8))
