"""Items of JSON lists of any size: one huge file is read in pieces by many tasks.

The files are read as text that ends at commas, so Spark splits them by bytes as it does lines.  Whether a
comma ends an item depends on all that stands before it: on being inside a string and on the depth of
brackets.  A piece tells how it changes both, for either state at its beginning; a task adds that up along its
block, and a table with one row per block carries it on from block to block.  Items are then the pieces
between such commas; no task holds more than a block, and nothing more than an item is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.ordered import Scan, prefix_scan
from tallyloom.session import staged

NAME = r'"((?:[^"\\]|\\.)*)"\s*:\s*'


def _depth_change(text: Column) -> Column:
    """How many brackets a text opens and does not close; strings do not count."""
    plain = F.regexp_replace(text, r'"[^"]*("|$)', "")
    opened = F.length(F.regexp_replace(plain, r"[^\[{]+", ""))
    return opened - F.length(F.regexp_replace(plain, r"[^\]}]+", ""))


def _pieces(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, block, row, value: the text between commas; ``inside`` and ``depth`` after it; ``bare`` lists."""
    raw = spark.read.option("lineSep", ",").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    text = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped character is neither quote nor bracket
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"')))
    rows = rows.withColumns({"odd": quotes % 2, "out": _depth_change(text), "in": _depth_change(F.concat(F.lit('"'), text))})
    along = W.partitionBy("file", "block").orderBy("row")
    before, so_far = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(W.unboundedPreceding, 0)
    # if the block begins outside of strings (0) or inside (1)
    rows = rows.withColumn("turned", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    rows = rows.withColumns(
        {"step0": F.when(F.col("turned") == 0, F.col("out")).otherwise(F.col("in")), "step1": F.when(F.col("turned") == 0, F.col("in")).otherwise(F.col("out"))}
    )
    rows = rows.withColumns({"depth0": F.sum("step0").over(so_far), "depth1": F.sum("step1").over(so_far)})
    blocks = rows.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"), F.sum("step0").alias("d0"), F.sum("step1").alias("d1"), F.min_by(F.ltrim("value"), "row").alias("head")
    )
    files = W.partitionBy("file").orderBy("block")
    earlier = files.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {
            "begins": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2,
            "bare": F.startswith(F.first("head").over(files), F.lit("[")),
        }
    )
    blocks = blocks.withColumn("d", F.when(F.col("begins") == 0, F.col("d0")).otherwise(F.col("d1")))
    blocks = blocks.select("file", "block", "begins", "bare", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base"))
    joined = rows.join(blocks, ["file", "block"])
    depth = F.col("base") + F.when(F.col("begins") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    inside = (F.col("begins") + F.col("turned") + F.col("odd")) % 2
    return joined.select("file", "block", "row", "value", "bare", depth.alias("depth"), (inside == 1).alias("inside"))


def items(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, section (null in a bare list, else the list's name in the object), pos (from 0) and item (JSON text).

    A file is a list, or an object whose values are lists or single values; the latter have no items.
    """
    found, _ = staged(_pieces(spark, path, glob), "json-pieces")
    level = F.when(F.col("bare"), 1).otherwise(2)
    # a comma between items, or in an object between its entries
    ends = ~F.col("inside") & ((F.col("depth") == level) | (~F.col("bare") & (F.col("depth") == 1)))
    found = found.withColumn("ends", ends.cast("long"))
    key = F.struct("block", "row").alias("at")
    numbered = prefix_scan(found.select("*", key), ["file"], "at", {"number": Scan("sum", "ends", inclusive=False)}, F.col("block"))
    number = F.coalesce("number", F.lit(0)).alias("number")
    whole = numbered.groupBy("file", "bare", number).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), ",").alias("text"),
        F.max_by("depth", "at").alias("depth"),
    )
    # what opens the list and what closes it belong to its first and last item
    opening = F.when(F.col("number") > 0, F.lit("^")).when(F.col("bare"), F.lit(r"^\s*\[")).otherwise(F.lit(r"^\s*\{"))
    whole = whole.withColumn("text", F.regexp_replace("text", opening, F.lit("")))
    closing = F.concat(F.lit(r"(\s*[\]}]){"), (level - F.col("depth")).cast("string"), F.lit(r"}\s*$"))
    whole = whole.withColumn("text", F.regexp_replace("text", closing, F.lit("")))
    entry = ~F.col("bare") & F.col("text").rlike(rf"(?s)^\s*{NAME}")
    name = F.when(entry, F.struct("number", F.regexp_extract("text", rf"(?s)^\s*{NAME}", 1).alias("name")))
    named = prefix_scan(whole.withColumn("name", name), ["file"], "number", {"section": Scan("max", "name")})
    listed = F.col("text").rlike(rf"(?s)^\s*{NAME}\[")
    text = F.when(F.col("name").isNull(), F.col("text")).when(listed, F.regexp_replace("text", rf"(?s)^\s*{NAME}\[", ""))
    rows = named.select(
        "file",
        F.col("section.name").alias("section"),
        (F.col("number") - F.coalesce("section.number", F.lit(0))).alias("pos"),
        F.trim(text).alias("item"),
    )
    return rows.where(F.length(F.regexp_replace("item", r"\s+", "")) > 0)
