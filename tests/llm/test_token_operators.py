"""Encoders against their library, token files by round trip, leaks by brute force, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import bpe, near_dups, pii, quality, templates, token_files
from tallyloom.llm.common import slices
from tests.llm.cases import SF_DIR, awkward, clashing, documents, empty

ODD = [
    "", "  ", "a  b", "Hello's I'LL ΣΑΣ xİy 12½ ² café Ångstrom", "tab\tnl\n\n x \x1c y\x85z q", "<|endoftext|> a <|startoftext|>b",
    "日本語 テスト \U0001f642\U0001f642 !!", "�\x00\x01 ab", "trailing \n", "A" * 500, " lead", "ǅ ß ŉ K", "é 가",
]


def odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (None, None), (3, ODD[3]), (99, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


# -- byte-pair encoding ---------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.FILE))
    for docs in (odd_rows(spark), documents(spark).select("doc_id", "text"), awkward(spark).select("doc_id", "text")):
        want = Counter()
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            want[(r["doc_id"], len(ids), *hashes)] += 1
        assert Counter(tuple(r) for r in bpe.bpe_query(docs).collect()) == want


def test_bpe_ids_and_decoding(spark):
    coder = bpe.Bpe(public_tokenizers.path(bpe.FILE))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.FILE))
    for text in ODD:
        ids = coder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encoded(clashing(odd_rows(spark), "n_tokens", "source")).collect()
    assert all(len(r["token_ids"]) == r["n_tokens"] and coder.decode(r["token_ids"]) == r["decoded"] for r in rows)
    assert bpe.encoded(empty(spark)).count() == 0


def test_bpe_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    coder = bpe.Bpe(public_tokenizers.path(bpe.FILE))
    text = " ".join(f"word{i}" for i in range(40)) + " word1 word2"
    once = [list(map(str, x)) for x in coder.codes([text, text])]
    assert len(coder.kept) <= 5 and len(coder.kept.old) <= 5
    assert once == [list(map(str, x)) for x in coder.codes([text, text])]


def test_bpe_merges_new_words_together(monkeypatch):
    """The new words of a block are merged once each and many at a time, in words of any length as the library does."""
    monkeypatch.setattr(bpe, "WORD_CHARS", 3000, raising=False)
    path, calls, rng = public_tokenizers.path(bpe.FILE), [], random.Random(4)
    coder, library = bpe.Bpe(path), Tokenizer.from_file(path)
    merge = coder.merged
    monkeypatch.setattr(coder, "merged", lambda words: calls.append(words) or merge(words))
    words = ["".join(rng.choices("aaabnt\u00e9\u00df\u65e5", k=rng.randrange(1, 30))) for _ in range(900)] + ["ab" * 4000, "a" * 5000]
    texts = [" ".join(rng.choices(words, k=80)) + rng.choice(["", "$$$", "12!"]) for _ in range(60)] + [" ".join(words), "", "$$$"]
    assert coder.codes(texts)[1].to_pylist() == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    merged = [word for call in calls for word in call]
    assert len(merged) == len(set(merged)) and len(calls) < 20


def test_slices_give_memory_back(monkeypatch):
    """A worker that outlives its task does not hold what Arrow no longer uses."""
    released = []
    pool = SimpleNamespace(release_unused=lambda: released.append(1))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["x"])
    sizes = [(part.num_rows, len(released)) for part in slices(iter([batch]))]
    assert sizes == [(1024, 0), (1024, 1), (452, 2)] and len(released) == 4


def test_bpe_equals_the_library_on_every_character():
    """Every code point below U+20000, alone, between letters and beside marks."""
    path = public_tokenizers.path(bpe.FILE)
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    characters = [chr(n) for n in range(0x20000) if not 0xD800 <= n < 0xE000]
    for form in ("{0}", "a{0}b {0}", "Q{0}\u0301 x{0},{0}1"):
        for start in range(0, len(characters), 8192):
            texts = [form.format(c) for c in characters[start : start + 8192]]
            want = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
            assert own.codes(texts)[1].to_pylist() == want


# -- token files ----------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, step in ((0, 1), (1, 5), (7, 2), (1000, 2000), (9000, 3), (5000, 1), (300, 10**9)):
        values = np.cumsum(rng.integers(0, step + 1, n))
        code = token_files.EliasFano.of(values)
        assert (code.select(0, n) == values).all()
        for a, b in ((n // 3, n // 2), (n - 1, n), (n // 2, n // 2)):
            assert (code.select(max(a, 0), b) == values[max(a, 0) : b]).all()
        if n > 100:
            bits = 8 * (len(code.low) + len(code.high))
            assert bits <= n * (3 + max(0, np.log2(values[-1] / n))) + 8 * token_files.SAMPLE


def test_token_files_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.FILE))
    for docs in (documents(spark).select("doc_id", "text"), odd_rows(spark), awkward(spark)):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
        starts = dict.fromkeys([d for d, _ in rows])
        got = token_files.token_file_query(docs).collect()
        want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids, strict=True))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == list(np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])[:-1]]))
        assert [r["doc_id"] for r in ordered] == [d for d, _ in rows] and starts is not None


def test_token_files_store_and_empty(spark, monkeypatch):
    assert token_files.token_file_query(empty(spark)).count() == 0
    monkeypatch.setattr(token_files, "KEPT", 4)
    coder = token_files.Encoder(public_tokenizers.path(token_files.FILE))
    library = Tokenizer.from_file(public_tokenizers.path(token_files.FILE))
    text = " ".join(f"w{i % 23}x" for i in range(200))
    want = [*library.encode(text).ids, 0]
    for _ in range(3):
        ids, counts = coder.encode(pa.array([text, None, text]))
        assert ids.tolist() == [*want, 0, *want] and counts.tolist() == [len(want), 1, len(want)]
    assert len(coder.kept) <= 4 and len(coder.kept.old) <= 4


# -- benchmark leaks ------------------------------------------------------------------------------


def test_leaks_on_given_tables(spark):
    docs, bench = documents(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(d, b["item_id"]) for b in bench.collect() for d, t in texts.items() if b["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in templates.leak_query(docs, bench).collect()}
    assert want and want <= got
    plain = lambda t: " ".join(re.findall("[a-zà-ÿ]+", t.lower()))
    loose = {(d, b["item_id"]) for b in bench.collect() for d, t in texts.items() if plain(b["text"]) in plain(t)}
    assert got <= loose


ITEM = "Anna Miller drives 120 km in 3 hours and then rests before driving another 45 km to the old town of Bremen on Sunday."


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_leaks_of_reworked_questions(spark, monkeypatch, local):
    monkeypatch.setattr(templates, "LOCAL_WINDOWS", local)
    other = ITEM.replace("Anna Miller", "Paul Schmidt").replace("120 km", "87 miles").replace("3 hours", "two minutes").replace("Bremen", "Ulm")
    twisted = ITEM.replace("another 45 km to the old", "slowly towards some new").replace("rests before driving", "sleeps until the")
    rows = [(1, "He says. " + ITEM + " End."), (2, "so far " + other + "\nMore text here."), (3, twisted), (4, "The town is old."), (5, None), (6, ""), (7, ITEM.upper())]
    rows += [(None, ITEM), (1, rows[0][1])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "key", "item", "h")
    items = spark.createDataFrame([(10, ITEM), (11, "Too short here"), (12, None), (None, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.leak_query(docs, items).collect()}
    assert {(1, 10), (2, 10), (None, 10)} <= got and not {d for d, _ in got} & {3, 4, 5, 6}
    clean = templates.without_benchmark(docs, items)
    assert clean.columns == docs.columns and {3, 4, 5, 6} <= {r["doc_id"] for r in clean.collect()}
    assert not {1, 2, None} & {r["doc_id"] for r in clean.collect()}


def test_leaks_need_consistent_slots(spark):
    item = "Take 5 apples, add 5 pears, then remove 5 plums and share the 5 boxes of fruit among 5 friends today."
    mixed = item
    for value in ("6", "7", "8", "9", "11"):
        mixed = mixed.replace(" 5 ", f" {value} ", 1)
    docs = spark.createDataFrame([(1, item.replace(" 5 ", " 6 ")), (2, mixed)], "doc_id long, text string")
    rows = templates.leak_query(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in rows] == [1] and rows[0]["agreed"] == 1.0


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_copies_of_short_and_dense_items_are_found(spark, monkeypatch, local):
    monkeypatch.setattr(templates, "LOCAL_WINDOWS", local)
    items = ["What is 12 + 45 * 3 - 7 / 2?", "Who Wrote The Great Gatsby In 1925", "Name the capital?", "1 2 3 4 5 6 7", "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b", "Ulm"]
    rows = [(n, f"He was asked something here. So {t} was read, and the rest followed later.") for n, t in enumerate(items)]
    rows += [(10, "What is the rest of 12 and 45? The capital was named."), (11, items[4][:6]), (12, "?!"), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (20, None), (21, "?")], "item_id long, text string")
    got = templates.leak_query(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(n, n) for n in range(len(items))}
    assert all(r["similarity"] == r["agreed"] == 1.0 for r in got)


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_copies_in_another_letter_case_are_found(spark, monkeypatch, local):
    monkeypatch.setattr(templates, "LOCAL_WINDOWS", local)
    half = ITEM[:60] + ITEM[60:].upper()
    # words in capitals cover one part, the template with other figures the rest
    both = ITEM[:60].replace("120", "87").replace("Anna Miller", "Paul Schmidt") + ITEM[60:].upper()
    rows = [(7, ITEM.upper()), (8, ITEM.lower()), (9, ITEM.title()), (10, half), (11, "Then " + both)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, ITEM.title() + " Or Not")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.leak_query(docs, items).collect()}
    assert got >= {(d, 10) for d, _ in rows} | {(d, 11) for d in (7, 8, 9, 10)}
    assert templates.without_benchmark(docs, items).count() == 0


def test_leaks_need_one_place(spark):
    words = ITEM.split()
    filler = " Meanwhile nobody else had seen what lay far beyond those quiet hills at dawn. "
    scattered = filler + filler.join(" ".join(words[i : i + 6]) for i in range(0, len(words), 3)) + filler
    short = "Name the capital city of old Prussia"
    moved = ITEM.replace("and then rests", "and so then often rests").replace("Anna Miller", "Dr Paul von Schmidt")
    own = ITEM.replace("120 km in 3", "120 km in 120")  # one item value in two places
    rows = [(1, scattered), (2, "Please. " + moved), (3, filler + ITEM + scattered), (4, "They name the capital city of Wales."), (5, "Go and name the capital city of old Prussia.")]
    rows += [(6, filler + own.replace("120 km in 120", "87 km in 87")), (7, scattered * 40 + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, short), (12, own)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leak_query(docs, items).collect()}
    assert {d for d, i in got if i == 10} >= {2, 3, 7} and not {1, 4, 5} & {d for d, i in got if i == 10}
    assert {d for d, i in got if i == 11} == {5}
    assert got[(6, 12)]["agreed"] == 1.0 and (1, 12) not in got
    assert got[(3, 10)]["similarity"] == 1.0 and got[(3, 10)]["last"] - got[(3, 10)]["first"] < 30


def test_leaks_of_repeated_words(spark, monkeypatch):
    """Places of one word in a document times those in an item are looked at by stretches."""
    item, text = "word " * 60, "word " * 4000
    items = spark.createDataFrame([(1, item), (2, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "word " * 20), (3, text + ITEM + " " + text)], "doc_id long, text string")
    want = None
    for pairs in (1 << 20, 5000):
        monkeypatch.setattr(templates, "PAIRS", pairs)
        got = sorted(tuple(r) for r in templates.leak_query(docs, items).collect())
        assert want in (None, got)
        want = got
    assert [(r[0], r[1]) for r in want] == [(1, 1), (3, 1), (3, 2)] and all(r[2] == 1.0 for r in want)


def test_leaks_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert templates.leak_query(documents(spark), bench).count() == 0
    assert templates.leak_query(empty(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).count() == 0
    assert templates.without_benchmark(awkward(spark), bench).count() == 15
    assert templates.leak_query(awkward(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.quality_rules,
        corpus_pipeline.near_duplicates,
        corpus_pipeline.decontamination,
        corpus_pipeline.personal_data,
        corpus_pipeline.encoding,
    ]


def test_pipeline_by_its_operators(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    docs = documents(spark)
    kept = quality.quality_query(docs).filter("kept").select("doc_id")
    left = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    one = near_dups.near_duplicates(left, 5).filter("id = component").select(F.col("id").alias("doc_id"))
    left = left.join(one, "doc_id", "left_semi").select(docs.columns)
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    bad = templates.leak_query(left, bench).select("doc_id").distinct()
    left = left.join(bad, "doc_id", "left_anti").select(docs.columns)
    library = Tokenizer.from_file(public_tokenizers.path(bpe.FILE))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(left, pii.Redactor.fit(left)).collect()}
    assert {r["doc_id"] for r in rows} == set(clean) and 0 < len(rows) < docs.count()
    for r in rows[:40]:
        assert r["token_ids"] == library.encode(clean[r["doc_id"]] or "", add_special_tokens=False).ids


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (clashing(awkward(spark), "id", "t", "kept", "key"), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "bpe":
                assert docs.columns == columns, name
        assert "token_ids" in docs.columns
        docs.collect()


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(names) and "op3_urls" in entry.oracle_sql()
