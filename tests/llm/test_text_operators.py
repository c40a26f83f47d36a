"""Language, quality, license and URL operators against brute force and labelled rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language, licenses, quality, urls
from tests.compare import connect, rows_of
from tests.llm.cases import SF_DIR, awkward, clashing, documents, empty, same

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


# -- language -------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_and_split(spark):
    counts = language.learn(documents(spark))
    model = language.Mixture.of(counts)
    by = {r["lang"]: r["text"] for r in documents(spark).filter("length(text) > 1500").collect()}
    shares, known = model.infer([by["en"] + "\n" + by["de"], by["en"], "", "12 34"])
    assert list(known) == [True, True, False, False]
    both = dict(zip(model.names, shares[0], strict=True))
    assert both["en"] > 0.15 and both["de"] > 0.15 and both["fr"] < 0.1
    assert shares[1].max() > 0.9 and shares[2].sum() == 0
    assert abs(shares[0].sum() - 1) < 1e-6
    ids = spark.createDataFrame([(i,) for i in (0, 1, 7, 123456, None)], "doc_id long")
    for row in ids.withColumn("h", language.held_out()).collect():
        assert row["h"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)


def _invented(rng, alphabet):
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def _languages(spark, names, seed=3):
    """A model of invented languages, and how to write them."""
    rng = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    write = {name: _invented(rng, rng.sample(letters, 12)) for name in names}
    rows = [(write[name](300), name) for name in names for _ in range(4)]
    return language.Mixture.of(language.learn(spark.createDataFrame(rows, "text string, lang string"))), write


def test_language_texts_of_many_languages(spark):
    model, write = _languages(spark, ["l1", "l2", "l3", "l4", "l5", "l6", "l7", "l8"])
    parts = ["l1", "l3", "l4", "l5", "l7", "l8"]
    shares, _ = model.infer([". ".join(write[p](150) for p in parts), write["l2"](200)])
    found = {n: s for n, s in zip(model.names, shares[0], strict=True) if s > 0.05}
    assert set(found) == set(parts) and all(0.1 < s < 0.25 for s in found.values())
    assert shares[1][model.names.index("l2")] > 0.95


def test_language_inference_by_plain_estimation(spark):
    """The same sets and shares as expectation-maximisation of one text at a time, trigram by trigram."""
    model, write = _languages(spark, ["a", "b", "c", "d"])
    rng = random.Random(5)
    texts = [" ".join(write[rng.choice("abcd")](rng.choice([1, 4, 30])) for _ in range(rng.randint(1, 4))) for _ in range(25)]

    def fit(p, n, shares, rounds):
        for _ in range(rounds):
            new = [0.0] * len(shares)
            for row, times in zip(p, n, strict=True):
                total = sum(x * s for x, s in zip(row, shares, strict=True))
                for i, s in enumerate(shares):
                    new[i] += times * row[i] * s / total
            shares = [x / sum(n) for x in new]
        return shares, sum(times * math.log(sum(x * s for x, s in zip(row, shares, strict=True))) for row, times in zip(p, n, strict=True))

    got, _ = model.infer(texts)
    for text, found in zip(texts, got, strict=True):
        _, cells, n, _ = language.trigram_counts([text])
        p, n = model.p[cells].tolist(), n.tolist()
        alone = [sum(t * math.log(row[i]) for row, t in zip(p, n, strict=True)) for i in range(4)]
        fine = language.PENALTY * math.log1p(sum(n))
        best, value, idle = [float(i == alone.index(max(alone))) for i in range(4)], max(alone) - fine, 0
        every, _ = fit(p, n, [0.25] * 4, language.ROUNDS)
        order = sorted(range(4), key=lambda i: -every[i])
        for size in (2, 3, 4):
            if idle == language.PATIENCE:
                break
            guess = [max(every[i], 1e-6) if i in order[:size] else 0.0 for i in range(4)]
            shares, likely = fit(p, n, [g / sum(guess) for g in guess], language.REFITS)
            idle += 1
            if likely - fine * size > value:
                best, value, idle = shares, likely - fine * size, 0
        assert np.allclose(found, best, atol=1e-9), text


def test_language_ties_go_to_the_first(spark):
    rows = [("same words here", "z"), ("same words here", "m"), ("same words here", "q")]
    model = language.Mixture.of(language.learn(spark.createDataFrame(rows, "text string, lang string")))
    docs = spark.createDataFrame([(1, "same words")], "doc_id long, text string")
    assert language.identify(docs, model).first()["lang_pred"] == "m"


def test_language_awkward_rows(spark):
    rows = language.language_query(awkward(spark)).collect()
    assert len(rows) == 15
    for r in rows:
        if r["doc_id"] in (3, 4, 5, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.language_query(empty(spark)).count() == 0
    # nothing to learn from
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_query(unlabelled).collect()} == {"und"}
    clash = clashing(awkward(spark), "lang_pred", "score", "held_out")
    model = language.Mixture.of(language.learn(clash))
    assert language.identify(clash, model).columns.count("score") == 1


# -- quality --------------------------------------------------------------------------------------


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_counts_by_brute_force(spark):
    for docs in (documents(spark), awkward(spark)):
        texts = Counter((r["doc_id"], counts_of(r["text"])) for r in docs.collect())
        got = quality.quality_query(docs).collect()
        assert Counter((r["doc_id"], tuple(r[c] for c in quality.COUNTS[:5])) for r in got) == texts
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_separates_junk_without_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_query(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_quality_edges(spark):
    assert quality.quality_query(empty(spark)).count() == 0
    assert quality.keep_good(empty(spark)).count() == 0
    docs = clashing(awkward(spark), "kept", "n_words", "probability", "__w")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["n_words"] for r in kept.collect()} == {"taken"}
    assert 3 not in {r["doc_id"] for r in kept.collect()}


# -- licenses -------------------------------------------------------------------------------------

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels))


def license_rows(spark):
    texts = [
        "MIT License mit  license; The MIT-License",
        "general public general public license public license",
        "Licensed under the Apache License, Version 2.0 and the GNU General Public License",
        "mité license licence mit",
        "Permission is hereby granted, free of charge, to any person now obtaining a copy of this software",
        "permission granted to any person",
        "MIT LICENSE " * 3000,
        None,
        "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (0, texts[0])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_licenses_by_brute_force(spark):
    for docs in (license_rows(spark), documents(spark), awkward(spark)):
        want = Counter((r["doc_id"], *base_of(r["text"])) for r in docs.collect())
        got = licenses.license_query(docs).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
        for r in got:
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1


def test_base_licenses_need_consecutive_words(spark):
    texts = ["general public public license", "general public new public license", "The general public license.", "general public public license general public license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_query(docs).collect()}
    assert [(rows[n]["n_base"], rows[n]["first_word"], rows[n]["base_labels"]) for n in range(4)] == [(0, None, ""), (0, None, ""), (1, 1, "gpl"), (1, 4, "gpl")]
    assert rows[0]["labels"] == rows[1]["labels"] == ""


def test_license_phrases_with_added_words(spark):
    rows = {r["doc_id"]: r for r in licenses.license_query(license_rows(spark).filter("doc_id > 0")).collect()}
    assert "mit" in rows[4]["labels"] and rows[4]["base_labels"] == ""
    assert 0.8 <= rows[4]["score"] < 1
    assert rows[5]["labels"] == ""
    assert licenses.license_query(empty(spark)).count() == 0


# -- urls -----------------------------------------------------------------------------------------

URLS = [
    "http://a.example.net/en/x?q#f", "https://example.net/en/", "http://example.net/en", "http://EXAMPLE.com/de/1",
    "http://xexample.com/de/1", "http://a.org/fr/", "http://a.org/FR/", "http://b.net", "http://b.net?x/", "net/", "",
    "http://spam-farm.example.org/en/1", "http://www.spam-farm.x.org/fr/2", "http://x.com/casino", "http://x.com/casinos",
    "http://x.com/my-casino/1", "ftp://user@xn--abc.com/", "://net/", "http:///net/", "http://a.net/\n/x", "http://x.com/a/malware/b",
    "http://é.net/ü", "HTTP://X.NET/", None, None,
]


def test_urls_against_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("taken"), "token": F.lit("taken")})
    got = urls.url_query(pages)
    con = connect(SF_DIR)
    pages.drop("host", "token").write.parquet(str(tmp_path / "pages"))
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = con.execute(urls.oracle_sql())
    names = [d[0] for d in want.description]
    rows = [tuple(r) for r in got.collect()]
    assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())
    by = {r["page_id"]: r for r in got.filter("page_id IS NOT NULL").collect()}
    assert (by[0]["rule"], by[0]["verdict"]) == ("example.net/en/", "allow")
    assert (by[3]["rule"], by[3]["verdict"]) == ("example.com/de/", "block")
    assert (by[7]["rule"], by[11]["verdict"], by[13]["verdict"], by[14]["verdict"]) == (None, "block", "block", "allow")


@pytest.mark.parametrize("limit", [0, 200_000])
def test_urls_index_forms_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    everywhere = urls.Pattern("*e*", "block")
    rows = urls.parsed(pages.select("url")).distinct()
    fits = urls.fitting_rules(rows, patterns=(*urls.PATTERNS, everywhere)).filter("rule = '*e*'")
    assert everywhere.tokens == [] and fits.count() == rows.filter("lower(url) LIKE '%e%'").count()
    assert same(urls.url_query(pages), urls.url_query(pages.select("page_id", "url")))


def test_urls_empty(spark):
    assert urls.url_query(spark.createDataFrame([], "page_id long, url string")).count() == 0
