import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.stemming import stem_word
from tallyloom.operators import classify, overlap, quality, review, similarity

# Published examples of the algorithm, with the later extensions where they differ.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die",
    "generalizations": "gener", "oscillators": "oscil", "died": "die", "spied": "spi", "enjoy": "enjoy",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stems(word):
    assert stem_word(word) == STEMS[word]


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("lanes,steps", [(4096, 2048), (2, 7), (16, 64)])
def test_lcs(monkeypatch, lanes, steps):
    """Pairs moved together, and pairs cut into rectangles that pass carries on."""
    monkeypatch.setattr(overlap, "LANES", lanes)
    monkeypatch.setattr(overlap, "STEPS", steps)
    rng = random.Random(2)
    for _ in range(30):
        items = rng.choice([2, 4, 30])
        side = lambda: np.array([rng.randrange(items) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 300]))], np.int64)  # noqa: B023, E731
        pairs = [(side(), side()) for _ in range(rng.randint(1, 9))]
        assert overlap.lcs_lengths(pairs) == [lcs_by_table(a.tolist(), b.tolist()) for a, b in pairs]


def test_lcs_of_many_pairs_in_few_rectangles(monkeypatch):
    """Pairs of up to some thousand words share rectangles; only a pair that fills one goes alone."""
    rng, calls, rectangle = np.random.default_rng(8), [], overlap._rectangle

    def counted(*args):
        calls.append(len(args[0]))
        return rectangle(*args)

    monkeypatch.setattr(overlap, "_rectangle", counted)
    pairs = [(rng.integers(0, 90, n), rng.integers(0, 90, n)) for n in (*[300] * 200, 2500, 2600)]
    found = overlap.lcs_lengths(pairs)
    assert len(calls) == 2 and max(calls) <= overlap.LANES
    assert [found[i] for i in (0, 99, 199)] == [lcs_by_table(*(x.tolist() for x in pairs[i])) for i in (0, 99, 199)]
    monkeypatch.setattr(overlap, "LANES", 16)
    assert overlap.lcs_lengths(pairs[-2:]) == found[-2:]


def test_blocks_of_words():
    lists = pa.array([["a"] * n for n in (5, 0, 3, 40, 2)])
    blocks = overlap.word_blocks(lists, lists)
    assert blocks == [(0, 5)] and overlap.word_blocks(lists[:0], lists[:0]) == []
    numbers, left, right = overlap._word_numbers(lists[2:], lists[1:4], True)
    assert (left.tolist(), right.tolist(), len(numbers)) == ([0, 3, 43, 45], [45, 45, 48, 88], 88)


def test_lcs_of_long_unrelated_texts():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3000, 20_000), rng.integers(0, 3000, 20_000)
    start = time.perf_counter()
    found = overlap.lcs_lengths([(a, b)])[0]
    assert time.perf_counter() - start < 20
    # one bit row as long as the text, moved word by word
    places = {}
    for i, item in enumerate(a.tolist()):
        places[item] = places.get(item, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for item in b.tolist():
        hit = row & places.get(item, 0)
        row = (row + hit | row - hit) & full
    assert found == len(a) - row.bit_count()


def test_unstemmed_longest_by_table(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "Cat", "sat", "mats", "running", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + ["the cat"], strict=True))]
    pairs = spark.createDataFrame(rows, "pos long, prediction string, reference string")
    for stemmed in (False, True):
        words = lambda t: [overlap.scored_stem(w) if stemmed else w for w in t.lower().split()]  # noqa: B023, E731
        for r in overlap.rouge_scores(pairs, stemmed=stemmed).collect():
            _, a, b = rows[r["pos"]]
            common = lcs_by_table(words(a), words(b))
            precision, recall = common / max(len(a.split()), 1), common / max(len(b.split()), 1)
            assert r["rougeL"] == pytest.approx(2 * precision * recall / (precision + recall) if common else 0.0)


def test_word_stems(spark):
    rows = spark.createDataFrame([("Running runs, the cats!",), ("the RUNNING",), (None,)], "t string")
    got = {r["word"]: (r["stem"], r["n"]) for r in overlap.word_stems(rows, "t").collect()}
    assert got == {"running": ("run", 2), "runs": ("run", 1), "the": ("the", 2), "cats": ("cat", 1)}


def bleu_by_hand(pred, ref):
    p, r = pred.lower().split(), ref.lower().split()
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p, r))
        hit = sum(min(c, b[g]) for g, c in a.items())
        if n == 1 and hit == 0:
            return 0.0
        logs += math.log((hit or 0.1) / max(sum(a.values()), 1)) / 4
    brevity = 1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p))
    return brevity * math.exp(logs)


def test_bleu_and_rouge(spark):
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "mat", "running", "dogs", "a"]
    texts = [("", ""), ("the", ""), ("", "the"), ("The cat", "the CAT"), ("x", "y")]
    texts += [tuple(" ".join(rng.choices(words, k=rng.randint(1, 15))) for _ in "pr") for _ in range(60)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(texts)], "pos int, prediction string, reference string")
    got = {r["pos"]: r["bleu"] for r in overlap.bleu_scores(df).collect()}
    rouge = {r["pos"]: r for r in overlap.rouge_scores(df).collect()}
    for i, (p, r) in enumerate(texts):
        assert got[i] == pytest.approx(bleu_by_hand(p, r), abs=1e-9), (p, r)
        a, b = ([stem_word(w) if len(w) > 3 else w for w in t.lower().split()] for t in (p, r))
        common = lcs_by_table(a, b)
        want = 2 * common / (len(a) + len(b)) if common else 0.0
        assert rouge[i]["rougeL"] == pytest.approx(want), (p, r)
        hit = sum((Counter(a) & Counter(b)).values())
        assert rouge[i]["rouge1"] == pytest.approx(2 * hit / (len(a) + len(b)) if hit else 0.0)
    summary = overlap.bleu(df).first()
    assert summary["bleu_std"] == pytest.approx(np.std(list(got.values())))


def test_positions_are_cut_to_the_shorter_list(spark):
    p = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, prediction string")
    r = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, reference string")
    assert overlap.align(p, r).count() == 2
    assert overlap.caption_metrics(overlap.align(p, r), p).first()["count"] == 3


def test_auc(spark):
    rng = random.Random(8)
    rows = [(rng.random() < 0.4, float(rng.randint(0, 20))) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y boolean, s double")
    assert classify.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    assert classify.roc_auc(df.where("y"), "y", "s").first()["auc"] is None


def test_labels_on_one_side_only(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "truth string, predicted string")
    scores = {r["label"]: r for r in classify.class_scores(df).collect()}
    assert scores["b"]["recall"] == 0 and scores["c"]["precision"] == 0
    assert scores["a"]["precision"] == scores["a"]["recall"] == 0.5
    assert classify.confusion_matrix(df).count() == 9
    assert classify.summary(df).first()["accuracy"] == pytest.approx(1 / 3)


def test_zero_vector_and_ties(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0])], "id int, v array<float>")
    unit = {r["id"]: list(r["u"]) for r in df.select("id", similarity.l2_normalise(F.col("v")).alias("u")).collect()}
    assert unit[0] == [0.0, 0.0] and unit[1] == pytest.approx([0.6, 0.8])
    prompts = [("x", [1.0, 0.0]), ("y", [0.0, 1.0])]
    best = {r["id"]: (r["prompt"], r["cosine"]) for r in similarity.best_prompt(df, "v", prompts).collect()}
    assert best[0] == ("x", 0.0) and best[1][0] == "y" and best[2][0] == "x"


def test_best_of_many_prompts(spark):
    rng = np.random.default_rng(2)
    images = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(70)], "id long, v array<double>")
    rows = [(f"p{i:04d}", rng.normal(size=5).tolist()) for i in range(300)]
    rows += [(f"q{i}", rows[i][1]) for i in range(3)]  # ties
    prompts = spark.createDataFrame(rows, "name string, p array<double>")
    want = {r["id"]: (r["prompt"], round(r["cosine"], 9)) for r in similarity.best_prompt(images, "v", sorted(rows)).collect()}
    for block, chunk in ((1024, 1 << 16), (7, 9)):
        got = similarity.best_of_many(images, "id", "v", prompts, "name", "p", block, chunk).collect()
        assert {r["id"]: (r["prompt"], round(r["cosine"], 9)) for r in got} == want and len(got) == 70
    assert similarity.best_of_many(images, "id", "v", prompts.where("false"), "name", "p").count() == 0


def test_entropy_limits(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "p array<double>")
    got = [r["h"] for r in df.select(similarity.entropy(F.col("p")).alias("h")).collect()]
    assert got == pytest.approx([0.0, math.log(2)])


def test_frechet(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(200, 4)), rng.normal(1.0, 2.0, size=(150, 4))
    frames = [spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>").repartition(3) for m in (a, b)]
    roots = np.sqrt(np.linalg.eigvals(np.cov(a.T) @ np.cov(b.T)).real.clip(0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a.T)) + np.trace(np.cov(b.T)) - 2 * roots
    assert similarity.frechet_distance(*frames, "v").first()["distance"] == pytest.approx(want)
    assert similarity.frechet_distance(frames[0], frames[0], "v").first()["distance"] == pytest.approx(0, abs=1e-6)


def test_moments_with_a_large_offset(spark):
    rng = np.random.default_rng(3)
    m = 1e8 + rng.normal(size=(300, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in m] + [(None,)], "v array<double>").repartition(4)
    means, covariances = similarity.moments(df, "v")
    assert [r["mean"] for r in means.orderBy("i").collect()] == pytest.approx(m.mean(0), abs=1e-6)
    want = np.cov((m - 1e8).T)
    for r in covariances.collect():
        assert r["covariance"] == pytest.approx(want[r["i"], r["j"]], rel=1e-6)
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="of one size"):
        similarity.moments(mixed, "v")[1].collect()


def test_confusion_of_many_labels(spark):
    pairs = spark.range(2000).select(F.concat(F.lit("t"), F.col("id") % 60).alias("truth"), F.concat(F.lit("p"), F.col("id") % 45).alias("predicted"))
    with pytest.raises(Exception, match="more than 100 labels"):
        classify.confusion_matrix(pairs, 100).collect()
    rows = classify.confusion_pairs(pairs).collect()
    assert sum(r["n"] for r in rows) == 2000 and {r["truth_total"] for r in rows} == {33, 34}


def test_scaling_laws(spark):
    rates = spark.createDataFrame([("a", 0.9, 10, 0.8), ("b", 0.5, 10, 0.8), ("c", 1.0, 10, 0.8)], "n string, p double, s int, v double")
    rows = {(r["n"], r["k"]): r for r in review.scaling_laws(rates, [1, 3], [0.95]).collect()}
    one = 1 / (1 + (0.1 / 0.9) ** 3)
    assert rows[("a", 3)]["p_sub"] == pytest.approx(one) and rows[("a", 3)]["p_full"] == pytest.approx(one**10)
    assert rows[("a", 1)]["k_min"] == math.ceil(math.log(0.95 ** (-1 / 10) - 1) / math.log(0.1 / 0.9))
    assert rows[("b", 1)]["k_min"] is None and rows[("c", 1)]["k_min"] == 1
    best = {r["n"]: r["k"] for r in review.best_threshold(review.scaling_laws(rates, [1, 3, 5], [0.95]), ["n"]).collect()}
    assert best == {"a": 3, "c": 1}


def test_unknown_expectation(spark):
    with pytest.raises(ValueError):
        quality.run_suite(spark.range(1), "s", [("other", "id")])
    row = quality.run_suite(spark.range(0), "s", [(quality.NOT_NULL, "id")]).first()
    assert row["passed"] and row["fraction"] == 0


def test_closest_prompts_in_little_memory():
    """A whole chunk times a block would be 128 MB; ties go to the first prompt, and a last slice may be short."""
    rng = np.random.default_rng(5)
    vectors, prompts = rng.normal(size=(16384 + 7, 8)), rng.normal(size=(1024, 8))
    prompts[900] = 2 * prompts[3]
    vectors[5] = prompts[3]
    rows, given = np.array([*vectors, None], dtype=object)[:-1], np.array([*prompts, None], dtype=object)[:-1]
    tracemalloc.start()
    at, cosine = similarity.closest(rows, given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    whole = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (prompts / np.linalg.norm(prompts, axis=1, keepdims=True)).T
    assert np.allclose(cosine, whole.max(axis=1)) and np.allclose(whole[np.arange(len(at)), at], cosine) and at[5] in (3, 900)
