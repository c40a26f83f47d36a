"""Column functions over file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extension sets of the media operators.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov", ".avi", ".mkv")
DATASET_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
PAIR_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
COLLECTED_IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp")
COLLECTED_VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, or '' — a leading dot is part of the name."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def base(path: Column) -> Column:
    """The whole path without its last extension: the key a file shares with its sidecars."""
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_name(path: Column) -> Column:
    return file_name(parent_dir(path))


def is_hidden(path: Column) -> Column:
    return F.startswith(file_name(path), F.lit("."))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(suffix(path)).isin(*extensions)


def media_kind(
    path: Column,
    images: Sequence[str] = COLLECTED_IMAGE_EXTENSIONS,
    videos: Sequence[str] = COLLECTED_VIDEO_EXTENSIONS,
) -> Column:
    return (
        F.when(has_extension(path, images), F.lit("image"))
        .when(has_extension(path, videos), F.lit("video"))
        .otherwise(F.lit("other"))
    )


def clean_path(path: Column) -> Column:
    """An absolute path with single slashes and none at its end."""
    is_clean = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("//")) & ~F.endswith(path, F.lit("/"))
    cleaned = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""))
    return F.when(is_clean, path).otherwise(cleaned)


def path_depth(clean: Column) -> Column:
    """The number of names in a clean path; 0 for the root."""
    slashes = F.char_length(clean) - F.char_length(F.replace(clean, F.lit("/"), F.lit("")))
    return F.when(clean == "/", F.lit(0)).otherwise(slashes)
