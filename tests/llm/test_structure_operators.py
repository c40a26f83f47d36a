"""Conversation trie, periodic runs and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints, periods, prefix_trie
from tallyloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.cases import SF_DIR, awkward, clashing, documents, empty, same

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


# --- conversation prefix trie ------------------------------------------------------------------------


def ordered(rows):
    """The turns of every conversation; rows of one turn in any fixed order."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def as_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def expected_nodes(sequences):
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                children[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        gain = (len(who) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += gain
    return sorted(
        (min(who), len(n), min(members[n[:-1]]) if n else -(1 << 62), len(who), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n])))))
        for n, who in members.items()
    )


def found_nodes(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-(1 << 62) if r[n] is None else r[n] for n in names) for r in df.collect())


def random_conversations(seed: int, n: int):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample([c for c in range(-250, 450) if c not in (0, 100)], n):
        at, first = 0, rnd.choice(["a", "b", "a"])
        for i in range(rnd.choice([1, 2, 3, 6, 9, 30])):
            at += rnd.choice([1, 1, 2])
            text = first * 3 if i < 4 else rnd.choice(["x", "yy", "é\U0001f642", "", None])
            rows.append((c, None if i == 0 and rnd.random() < 0.1 else at, rnd.choice(["user", "user", None]), text))
    rows += [(0, t, "user", "aaa") for t in range(40)] + [(100, t, "user", "aaa") for t in range(39)]
    rows += [(None, 1, "user", "nobody"), (500, None, None, None), (501, 3, "user", "only")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,piece,held", [(1, 4096, 1 << 19), (2, 5, 1 << 19), (3, 7, 6), (4, 4096, 10)])
def test_trie_by_brute_force(spark, monkeypatch, seed, piece, held):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    rows = random_conversations(seed, 60)
    table = spark.createDataFrame(rows, CONVERSATIONS)
    assert found_nodes(prefix_trie.trie_query(table)) == expected_nodes(as_rebuilt(ordered(rows)))


def test_trie_of_conversations_as_they_are(spark):
    rows = random_conversations(9, 40)
    table = clashing(spark.createDataFrame(rows, CONVERSATIONS), "depth", "p1", "conv", "size", "h1", "last")
    nodes = prefix_trie.conversation_trie(table)
    sequences = ordered(rows)
    assert found_nodes(nodes) == expected_nodes(sequences)
    for row in nodes.filter("depth > 0").collect():
        assert (row["role"], row["text"]) == sequences[row["conv_id"]][row["depth"] - 1]


def test_trie_of_nothing(spark):
    assert prefix_trie.trie_query(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    nobody = spark.createDataFrame([(None, None, None, None)], CONVERSATIONS)
    assert prefix_trie.trie_query(nobody).count() == 0


def test_trie_query_against_sql(spark):
    _, rows, problem = compare(spark, connect(SF_DIR), SF_DIR, QUERIES["op11_prefix_trie"], ORACLES["op11_prefix_trie"])
    assert rows and not problem, problem


def test_exit_node_by_fat_search():
    """Handles find the exit of every conversation, whatever the order of insertion."""
    rnd = random.Random(5)
    for _ in range(60):
        sequences = ["".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 3, 9, 40]))) for _ in range(30)]
        sequences += ["a" * n for n in rnd.sample(range(70), 12)]
        trie, expected = prefix_trie.ZFastTrie(), defaultdict(list)
        for c, s in enumerate(sequences):
            hashes = [(hash(("n", s[:d])) & (1 << 62) - 1 if d else 0) for d in range(len(s) + 1)]
            names = np.array(hashes, np.uint64)
            trie.insert(c, prefix_trie.Path(0, names, names, np.ones(len(names), np.uint64)))
            for d, name in enumerate(hashes):
                expected[name, d].append(c)
        table = trie.expanded().to_pydict()
        got = {(p, d): (c, n) for p, d, c, n in zip(table["p1"], table["depth"], table["conv"], table["convs"], strict=True)}
        assert got == {k: (min(v), len(v)) for k, v in expected.items()}
        # compacted: no more nodes than twice the conversations, and the root
        assert len(trie.low) <= 2 * len(sequences) + 1


# --- periodic runs ------------------------------------------------------------------------------------


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q) and i > start:
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def random_words(rnd):
    n = rnd.choice([0, 1, 5, 8, 30, 80, 200])
    words = [rnd.randrange(rnd.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n > 3 else 0):
        a = rnd.randrange(n)
        p, end = rnd.randint(1, max(1, (n - a) // rnd.randint(2, 8))), rnd.randint(a, n)
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    if n and rnd.random() < 0.2:  # Sturmian words have the most overlapping places
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        words = (y[: rnd.randint(3, max(3, n // 4))] * 9)[:n]
    return words


def test_runs_by_brute_force():
    rnd, total = random.Random(3), 0
    for _ in range(250):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 9))]
        words, counts = np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs])
        doc, *found = periods.runs_of(words, counts)
        for n, d in enumerate(docs):
            expected = brute_runs(d)
            total += len(expected)
            assert [tuple(int(x) for x in r) for r in zip(*(f[doc == n] for f in found), strict=True)] == expected
    assert total > 500


def test_range_successor():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        values = rnd.permutation(3 * n)[:n]
        tree = periods.Wavelet(values, 3 * n)
        lo = rnd.integers(0, n + 1, 50)
        hi = rnd.integers(lo, n + 1)
        x = rnd.integers(0, 3 * n, 50)
        expected = [min((v for v in values[a:b].tolist() if v > t), default=-1) for a, b, t in zip(lo, hi, x, strict=True)]
        assert tree.successor(lo, hi, x).tolist() == expected


def expected_periods(doc_id, text):
    words = [w for w in (text or "").encode("utf-8", "replace").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a, n = g % len(words), len(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hashlib.sha256(kept).hexdigest())


def test_period_query_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).filter("length(text) < 4000 or text is null").collect()]
    rows += [(n, rnd.choice([" ", "\n\t", "\x0b\x0c "]).join(f"w{w}" for w in random_words(rnd))) for n in range(20, 260)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in periods.period_query(clashing(table, "start", "period")).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected_periods(*r)) for r in rows)
    assert sum(r[1] for r in got) > 100


def test_periods_of_awkward_rows(spark):
    docs = awkward(spark)
    assert periods.period_query(docs).count() == docs.count()
    assert periods.period_query(empty(spark)).count() == 0
    # one very long text: a third of a million words of period 3
    row = periods.period_query(spark.createDataFrame([(1, "1 2 3 " * 100_000)], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 300_000, 3)


def test_collapsed_texts(spark):
    table = clashing(spark.createDataFrame([(1, "a b a b a b a b a b c"), (2, None), (3, "x  y"), (3, "x  y")], "doc_id long, text string"), "start")
    assert sorted(map(tuple, periods.collapsed(table).collect())) == [(1, "a b c", "taken"), (2, "", "taken"), (3, "x y", "taken"), (3, "x y", "taken")]


# --- fingerprints -------------------------------------------------------------------------------------


def slow_names(text: str) -> list[list[int]]:
    """The phrase names of all levels, one symbol at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def toss(own, left, bits=64):
        differ = own ^ left
        place = (differ & -differ).bit_length() - 1
        return 2 * place + ((own >> place) & 1)

    levels, symbols, mark, first = [], [ord(c) for c in text], 1 << 30, True
    while len(symbols) > 1 or first:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        run = lambda s, n: mix((s + n * 0x9E3779B97F4A7C15) & mask)
        symbols = [s if n == 1 else ((run(s, n) & 0xFFFFFFFF) | 1 << 31 if first else run(s, n) >> 1) for s, n in runs]
        labels = [128] + [toss(s, left) for s, left in zip(symbols, [mark, *symbols], strict=False)]
        for top in (16, 10, 8):
            labels = [top] + [toss(own, left) for left, own in zip(labels, labels[1:], strict=False)]
        labels = labels[1:]
        cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]] + [len(labels)]
        names = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            total = sum((s + 1) * (mix(((j + 1) * 0x9E3779B97F4A7C15) & mask) | 1) for j, s in enumerate(symbols[a:b]))
            names.append(mix((total + (b - a) * 0x9E3779B97F4A7C15) & mask) >> 1)
        symbols, mark, first = names, 1 << 63, False
        levels.append(names)
    return levels


def slow_sketch(text: str) -> str:
    if not text:
        return ""
    levels = slow_names(text)
    names = {n for level in levels[fingerprints.LEVEL - 1 :] or levels[-1:] for n in level}
    mixed = fingerprints.mixed(np.array(sorted(names), np.uint64) + fingerprints.MIX_A)
    return "".join(f"{int(h) >> 32:08x}" for h in sorted(mixed.tolist())[: fingerprints.KEPT])


def test_parsing_symbol_by_symbol():
    rnd = random.Random(2)
    texts = ["", "a", "ab", "aa", "aaaaaaaaaaaa", "abababababab", "\0\0x", "\U0010ffff" * 3 + "z"]
    texts += ["".join(rnd.choice(rnd.choice(["ab", "abcdefgh ", "aabé中\U0001f642"])) for _ in range(rnd.choice([2, 3, 10, 90, 700]))) for _ in range(60)]
    assert fingerprints.sketches(texts) == [slow_sketch(t) for t in texts]
    # neighbours in a block do not matter
    assert [fingerprints.sketches([t])[0] for t in texts[::-1]] == fingerprints.sketches(texts)[::-1]


def test_equal_substrings_share_interior_names(spark):
    texts = [r["text"] for r in documents(spark).filter("length(text) between 2000 and 6000").limit(30).collect()]
    for n, text in enumerate(texts):
        inside = {name for level in slow_names(text)[:3] for name in level}
        moved = {name for level in slow_names(texts[n - 1][: 50 + n] + text + "tail")[:3] for name in level}
        assert len(inside & moved) >= 0.97 * len(inside)


def test_likeness_is_jaccard_of_small_sets():
    a, b = ("".join(f"{i:08x}" for i in r) for r in (range(0, 60), range(30, 80)))
    assert fingerprints.likeness(a, b) == 30 / 80
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness("", a) == 0.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprint_query_by_brute_force(spark, partitions):
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).select("doc_id", "text").union(documents(spark).select("doc_id", "text")).collect()]
    rows = [(n, t if t is None or len(t) < 3000 else t[:3000]) for n, t in rows]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "part", "border", "fingerprint")
        got = [tuple(r) for r in fingerprints.fingerprint_query(table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    hashes = [r["h"] for r in table.select(F.xxhash64("text").alias("h")).collect()]
    in_order = [r for _, r in sorted(zip(hashes, rows, strict=True), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]
    expected = []
    for (n, text), (_, after) in zip(in_order, in_order[1:] + in_order[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        own, other, far = (slow_sketch(t) for t in (text, new, after))
        expected.append((n, len(text), sha(new), own, other, fingerprints.likeness(own, other), fingerprints.likeness(own, far)))
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_fingerprints_tell_edits_from_other_texts(spark):
    rows = [r for r in fingerprints.fingerprint_query(documents(spark)).collect() if r["n_chars"] >= 400]
    assert sum(r["near_edited"] > 0.35 for r in rows) >= 0.95 * len(rows)
    far = [r for r in rows if r["near_next"] < r["near_edited"]]
    assert len(far) >= 0.97 * len(rows)


def test_fingerprints_keep_columns(spark):
    docs = clashing(awkward(spark), "fingerprint", "extra")
    out = fingerprints.fingerprints(docs)
    assert out.columns == [*(c for c in docs.columns if c != "fingerprint"), "fingerprint"]
    assert same(out.drop("fingerprint"), docs.drop("fingerprint"))
    assert fingerprints.fingerprint_query(empty(spark)).count() == 0
    alone = fingerprints.fingerprint_query(spark.createDataFrame([(1, "alone " * 9)], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0
