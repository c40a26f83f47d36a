"""License scans by diagonal voting.

All rolling word k-grams of the texts are joined, by hash, to the places of the same k-grams in license
phrases.  A hit at word d of a document and word t of a phrase votes for the diagonal d - t.  Votes are
summed per diagonal, neighbouring diagonals of one phrase are merged (words added or left out move later
votes to the next diagonal), and a merged span is verified by the share of the phrase it covers.

k is 2, since the shortest phrases have two words; the joined words are compared too, so equal hashes of
different words do not count.  The phrase table is small by construction (``MAX_PLACES`` rows, checked)
and broadcast; every text is read once, and only hits and one row per document are written and shuffled.

Defined results: a null text counts as empty: no words, empty labels, score 0, null places.  Repeated
rows give repeated rows, also when their id is null.  An empty table gives an empty table.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty, written

GRAM = 2
NEAR = 2  # diagonals this close are merged
COVERED = 0.8  # share of a phrase's k-grams that a span must have
MAX_PLACES = 20_000

# fixed values: the contract's phrases
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# phrases of well-known license notices
PHRASES = (
    ("licensed under the apache license version", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by", "cc"),
    ("licensed under a creative commons attribution", "cc"),
    ("creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license", "boost"),
    ("all rights reserved", "reserved"),
)


def places(spark, phrases) -> DataFrame:
    """One row per k-gram of a phrase: phrase, label, base, grams, t, a, b, h."""
    rows = []
    for n, (text, label, base) in enumerate(phrases):
        words = text.split(" ")
        rows += [
            (n, label, base, len(words) - GRAM + 1, t, words[t], words[t + 1]) for t in range(len(words) - GRAM + 1)
        ]
    if len(rows) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} phrase places; the table would be too large to broadcast")
    schema = "phrase int, label string, base boolean, grams int, t int, a string, b string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("a", "b"))


def hits(docs: DataFrame, phrases, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per (document, phrase place) hit, and one with null phrase per document.

    ``key`` and the hash ``of`` the text tell documents apart; ``n_words`` comes with the null row.
    """
    words = F.split(F.lower(text_or_empty(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = docs.select(
        F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("of"), F.array_remove(words, "").alias("w")
    )
    grams = F.expr(
        "concat(array(0L), zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)),"
        " (x, y) -> xxhash64(x, y)))"
    )
    # place 0 stands for the document itself
    grams = rows.select("id", "of", "w", F.posexplode(grams).alias("at", "h"))
    table = F.broadcast(places(docs.sparkSession, phrases).withColumnRenamed("h", "ph"))
    # the hash alone is the join's key; the words are compared as a condition on the few rows that meet
    met = (F.col("at") > 0) & F.expr("array_contains(array(a), get(w, at - 1)) AND array_contains(array(b), get(w, at))")
    found = grams.join(table, (F.col("h") == F.col("ph")) & met, "left")
    return found.filter(F.col("phrase").isNotNull() | (F.col("at") == 0)).select(
        "id",
        "of",
        "phrase",
        "label",
        "base",
        "grams",
        "t",
        (F.col("at") - 1).cast("long").alias("d"),
        F.when(F.col("at") == 0, F.size("w")).cast("long").alias("n_words"),
    )


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: id, of, phrase, label, base, start, covered (share of the phrase)."""
    diagonals = (
        found.filter(F.col("phrase").isNotNull())
        .withColumn("diagonal", F.col("d") - F.col("t"))
        .groupBy("id", "of", "phrase", "label", "base", "grams", "diagonal")
        .agg(F.collect_set("t").alias("ts"))
    )
    mine = Window.partitionBy("id", "of", "phrase").orderBy("diagonal")
    # a complete diagonal and those of base phrases stand alone; others join the diagonal just before them
    complete = F.size("ts") == F.col("grams")
    opens = (
        F.col("base")
        | complete
        | F.coalesce(F.lag(complete).over(mine), F.lit(True))
        | (F.col("diagonal") - F.lag("diagonal").over(mine) > NEAR)
    )
    merged = (
        diagonals.withColumn("opens", opens.cast("int"))
        .withColumn("span", F.sum("opens").over(mine))
        .groupBy("id", "of", "phrase", "label", "base", "grams", "span")
        .agg(F.min("diagonal").alias("start"), F.flatten(F.collect_list("ts")).alias("ts"))
        .withColumn("covered", F.size(F.array_distinct("ts")) / F.col("grams"))
    )
    needed = F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(COVERED))
    return merged.filter(F.col("covered") >= needed)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", base=BASE, phrases=PHRASES) -> DataFrame:
    """Per document: n_words, places of base phrases, labels and the best share covered."""
    listed = [(t, x, True) for t, x in base] + [(t, x, False) for t, x in phrases]
    # one pass over the texts; what follows reads its hits and the documents' own rows
    found = written(hits(docs, listed, text, key), "licenses")
    own = found.filter(F.col("phrase").isNull()).groupBy("id", "of").agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("copies")
    )
    told = (
        spans(found)
        .groupBy("id", "of")
        .agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            F.collect_set(F.when(F.col("base"), F.col("label"))).alias("b"),
            F.collect_set("label").alias("l"),
            F.max("covered").alias("score"),
        )
        .select("*", F.col("id").alias("i"), F.col("of").alias("o"))
        .drop("id", "of")
    )
    joined = own.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")), "left")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join(F.sort_array("b"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.sort_array("l"), ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def license_query(documents: DataFrame) -> DataFrame:
    return scan(documents.select("doc_id", "text"))
