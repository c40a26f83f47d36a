"""Scores of generated texts against references: n-gram precision (BLEU) and recall (ROUGE)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.functions.stemming import stem_word

# Fixed value: what a zero overlap counts as.
EPSILON = 0.1
# Rows whose n-grams are counted together, and about how many words are made numbers together.
ROWS_AT_ONCE, WORDS_AT_ONCE = 64, 1 << 20


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out evenly: scoring a pair costs far more than moving it, and few large files are few tasks."""
    return pairs.select("pos", "prediction", "reference").repartition("pos")


def align(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Pair predictions and references by position; the longer list is cut to the shorter."""
    return predictions.select("pos", "prediction").join(references.select("pos", "reference"), "pos")


def bleu_tokens(text: Column) -> Column:
    return tx.words(F.lower(text))


@lru_cache(1 << 17)
def scored_stem(word: str) -> str:
    """What a word counts as: words of up to three letters are kept."""
    return stem_word(word) if len(word) > 3 else word


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def word_stems(texts: DataFrame, text: str) -> DataFrame:
    """The distinct words of texts with the stem they are scored by, and how often they occur."""

    @F.arrow_udf(T.StringType())
    def stem(words: pa.Array) -> pa.Array:
        return pa.array([scored_stem(w) for w in words.to_pylist()], pa.string())

    words = texts.select(F.explode(rouge_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", stem("word").alias("stem"), "n")


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


# Lanes that move together, of one pair or several, and steps along the other side in a rectangle of a long pair.
LANES, STEPS = 4096, 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _rectangle(rows: np.ndarray, tiles: np.ndarray, masks: np.ndarray, base: np.ndarray, items: np.ndarray, start: np.ndarray, steps: int, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Advance bit rows of the common-subsequence table over ``steps`` items; the carries of the last lane.

    A lane is 64 items of one side of a pair; ``tiles`` is its number in its pair.  At wave w, lane t is at
    step w - t, so the carry that lane t - 1 made one wave before belongs to the same step: all lanes of all
    pairs move together.  ``masks[base + item]`` has the lane's bits that equal an item (0 stands for none),
    ``items[start + step]`` is the item of a step, with zeros around each pair's items.  ``given`` are the
    carries that come into lane 0 from the rectangle before.
    """
    n, first = len(rows), np.flatnonzero(tiles == 0)
    carry, at, into = np.zeros(n, np.uint64), start - tiles, np.zeros(n, np.uint64)
    out = np.zeros(steps, np.uint64)
    for wave in range(steps + int(tiles.max()) + (given is not None)):
        into[1:] = carry[:-1]
        into[first] = given[wave] if given is not None and wave < steps else 0
        mask = masks.take(base + items.take(at))
        at += 1
        low = rows + (rows & mask)
        total = low + into
        carry = ((low < rows) | (total < low)).astype(np.uint64)
        rows = total | (rows & ~mask)
        if given is not None and 0 <= wave - (n - 1) < steps:
            out[wave - (n - 1)] = carry[-1]
    return rows, out


def _tile_masks(tile: np.ndarray, item: np.ndarray, place: np.ndarray, n_items: int, n_tiles: int) -> np.ndarray:
    masks = np.zeros(n_tiles * n_items, np.uint64)
    np.bitwise_or.at(masks, tile * n_items + item, np.uint64(1) << (place & 63).astype(np.uint64))
    return masks


def _zeros(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Zero bits among the first ``sizes`` bits of each row."""
    full = np.where(sizes >= 64, ALL, (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~rows & full).astype(np.int64)


def _long_pair(a: np.ndarray, b: np.ndarray) -> int:
    """The common subsequence of one long pair, rectangle by rectangle: carries go to the next lanes."""
    common, carries = 0, np.zeros(len(b), np.uint64)
    for i in range(0, len(a), LANES * 64):
        part = a[i : i + LANES * 64]
        n = -(-len(part) // 64)
        rows, tiles = np.full(n, ALL), np.arange(n)
        for j in range(0, len(b), STEPS):
            block = b[j : j + STEPS]
            known, code = np.unique(block, return_inverse=True)
            place = np.minimum(np.searchsorted(known, part), len(known) - 1)
            item = np.where(known[place] == part, place + 1, 0)
            hit = np.flatnonzero(item)
            masks = _tile_masks(hit >> 6, item[hit], hit, len(known) + 1, n)
            items = np.concatenate([np.zeros(n, np.int64), code + 1, np.zeros(n + 1, np.int64)])
            rows, carries[j : j + STEPS] = _rectangle(rows, tiles, masks, tiles * (len(known) + 1), items, np.full(n, n), len(block), carries[j : j + STEPS].copy())
        common += int(_zeros(rows, np.minimum(len(part) - 64 * tiles, 64)).sum())
    return common


def lcs_lengths(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Lengths of the longest common subsequences of pairs of number arrays.

    Pairs of alike size move together in one rectangle; a pair that fills one by itself is cut into several,
    so work is done in steps of bounded size and memory does not grow with the product of the lengths.
    """
    out = [0] * len(pairs)
    todo = []
    for n, (a, b) in enumerate(pairs):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        # a common start and a common end belong to it in any case
        short = len(b)
        differ = np.flatnonzero(a[:short] != b)
        start = int(differ[0]) if len(differ) else short
        back = np.flatnonzero(a[len(a) - (short - start) :] != b[start:])
        end = short - start - 1 - int(back[-1]) if len(back) else short - start
        out[n] = start + end
        a, b = a[start : len(a) - end], b[start : short - end]
        if len(b):
            todo.append((n, a, b))
    todo.sort(key=lambda t: len(t[2]))
    held, lanes, cells = [], 0, 0
    for n, a, b in todo:
        known, code = np.unique(b, return_inverse=True)
        tiles = -(-len(a) // 64)
        size = tiles * (len(known) + 1)
        if tiles > LANES or size > LANES * STEPS // 2:
            out[n] += _long_pair(a, b)
            continue
        # shorter pairs wait for the longest, so a wide rectangle takes only those of about its length
        uneven = lanes > LANES // 8 and 2 * len(b) > 3 * len(held[0][3])
        if held and (uneven or lanes + tiles > LANES or cells + size > LANES * STEPS // 2):
            _together(held, out)
            held, lanes, cells = [], 0, 0
        held.append((n, a, known, code))
        lanes, cells = lanes + tiles, cells + size
    if held:
        _together(held, out)
    return out


def _together(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], out: list[int]) -> None:
    """Add the lengths of several pairs to ``out``: one side, and the distinct items and codes of the other."""
    tiles_of = np.array([-(-len(a) // 64) for _, a, _, _ in held])
    widest = int(tiles_of.max())
    masks, bases, items, starts, sizes, used, at = [], [], [np.zeros(widest, np.int64)], [], [], 0, widest
    steps = max(len(code) for _, _, _, code in held)
    for (_, a, known, code), n in zip(held, tiles_of.tolist(), strict=True):
        place = np.minimum(np.searchsorted(known, a), len(known) - 1)
        hit = np.flatnonzero(known[place] == a)
        masks.append(_tile_masks(hit >> 6, place[hit] + 1, hit, len(known) + 1, n))
        tiles = np.arange(n)
        bases.append(used + tiles * (len(known) + 1))
        used += len(masks[-1])
        # a lane is read from ``tiles`` places before its pair's items to ``widest`` places behind the last step
        items += [code + 1, np.zeros(steps - len(code) + 2 * widest, np.int64)]
        starts.append(np.full(n, at))
        at += steps + 2 * widest
        sizes.append(np.minimum(len(a) - 64 * tiles, 64))
    rows = np.full(int(tiles_of.sum()), ALL)
    tiles = np.concatenate([np.arange(n) for n in tiles_of])
    rows, _ = _rectangle(rows, tiles, np.concatenate(masks), np.concatenate(bases), np.concatenate(items), np.concatenate(starts), steps, None)
    zeros = _zeros(rows, np.concatenate(sizes))
    for (n, _, _, _), common in zip(held, np.add.reduceat(zeros, np.cumsum(tiles_of) - tiles_of).tolist(), strict=True):
        out[n] += common


def _word_numbers(a: pa.Array, b: pa.Array, stemmed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words (or stems) of two list columns as numbers, and where the lists of either column begin and end.

    Each distinct word of both columns is stemmed once, and words seen lately not at all.
    """
    words = pa.concat_arrays([side.flatten().cast(pa.string()) for side in (a, b)]).dictionary_encode()
    numbers = words.indices.to_numpy().astype("int64")
    if stemmed:
        stems = pa.array([scored_stem(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        numbers = stems.indices.to_numpy().astype("int64")[numbers]
    left, right = _offsets(a).to_numpy().astype("int64"), _offsets(b).to_numpy().astype("int64")
    return numbers, left, right + left[-1]


def common_subsequences(numbers: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    pairs = [(numbers[i:j], numbers[k:m]) for i, j, k, m in zip(left, left[1:], right, right[1:])]
    return np.array(lcs_lengths(pairs), dtype="int32").reshape(-1, 1)


def count_shared_ngrams(numbers: np.ndarray, left: np.ndarray, right: np.ndarray, max_n: int) -> np.ndarray:
    """Per row and n, the n-grams both lists have, each as often as in the list with fewer.

    All these rows are counted together: an n-gram is the number of its first n - 1 words
    together with its last word, and numbers start anew in each row.
    """
    word = np.concatenate([numbers[left[0] : left[-1]], numbers[right[0] : right[-1]]])
    sizes = np.concatenate([np.diff(left), np.diff(right)])
    rows = len(left) - 1
    row, end = np.repeat(np.tile(np.arange(rows), 2), sizes), np.repeat(np.cumsum(sizes), sizes)
    is_left = np.arange(len(word)) < left[-1] - left[0]
    n_words = int(word.max(initial=0)) + 1
    at, gram = np.arange(len(word)), row
    out = np.zeros((rows, max_n), dtype="int32")
    for n in range(1, max_n + 1):
        fits = at + n <= end[at]
        at, gram = at[fits], gram[fits]
        gram, _ = pd.factorize(gram * n_words + word[at + n - 1])
        size = int(gram.max(initial=-1)) + 1
        ours = np.bincount(gram[is_left[at]], minlength=size)
        theirs = np.bincount(gram[~is_left[at]], minlength=size)
        home = np.zeros(size, dtype="int64")
        home[gram] = row[at]
        out[:, n - 1] = np.bincount(home, weights=np.minimum(ours, theirs), minlength=rows)
    return out


def word_blocks(a: pa.Array, b: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows with about ``WORDS_AT_ONCE`` words; a longer row is alone."""
    total = (_offsets(a).to_numpy().astype("int64") + _offsets(b).to_numpy())[:-1]
    cuts = np.flatnonzero(np.diff(total // WORDS_AT_ONCE)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)])) if len(a) else []


def clipped_overlaps(
    p: Column, r: Column, max_n: int, stemmed: bool = False, longest: bool = False
) -> Column:
    """The overlap for n = 1 to ``max_n`` as an array, then the common subsequence if asked for.

    A pair is handled where it lies, without any shuffle, and its words go to Python once.
    Unfolding all n-grams into rows and grouping them by pair gives the same numbers but took far
    longer and moved every n-gram.
    """
    width = max_n + longest

    def count(a: pa.Array, b: pa.Array) -> np.ndarray:
        numbers, left, right = _word_numbers(a, b, stemmed)
        # few rows at a time, so that the n-gram tables stay in the processor's cache; subsequences of all rows by size
        parts = [slice(i, i + ROWS_AT_ONCE + 1) for i in range(0, len(a), ROWS_AT_ONCE)]
        grams = np.concatenate([count_shared_ngrams(numbers, left[part], right[part], max_n) for part in parts])
        return np.hstack([grams, common_subsequences(numbers, left, right)]) if longest else grams

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
        counts = np.concatenate([np.zeros((0, width), "int32"), *[count(a[i:j], b[i:j]) for i, j in word_blocks(a, b)]])
        offsets = np.arange(len(a) + 1, dtype="int32") * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))

    return overlaps(p, r)


def ngrams_in(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def ngram_overlap(tokens: DataFrame, max_n: int) -> DataFrame:
    """Per pair and n: n-grams of the prediction, of the reference, and their clipped overlap.

    ``tokens`` has pos, p (prediction tokens) and r (reference tokens).
    """
    counted = tokens.withColumn("__o", clipped_overlaps(F.col("p"), F.col("r"), max_n))
    per_n = [
        F.struct(
            F.lit(n).alias("n"),
            ngrams_in(F.col("p"), n).alias("p"),
            ngrams_in(F.col("r"), n).alias("r"),
            F.col("__o")[n - 1].alias("overlap"),
        )
        for n in range(1, max_n + 1)
    ]
    return counted.select("pos", F.inline(F.array(*per_n)))


def bleu_value(overlaps: Column, n_pred: Column, n_ref: Column) -> Column:
    """Sentence BLEU-4 from the overlaps and the token counts: uniform weights, a zero overlap
    counts as ``EPSILON``, and a prediction shorter than its reference is marked down."""
    logs = F.lit(0.0)
    for n in range(1, 5):
        hit = F.when(overlaps[n - 1] == 0, F.lit(EPSILON)).otherwise(overlaps[n - 1])
        logs = logs + F.log(hit / F.greatest(n_pred - (n - 1), F.lit(1))) / 4
    brevity = F.when(n_pred > n_ref, F.lit(1.0)).otherwise(F.exp(1 - n_ref / n_pred))
    return F.when(overlaps[0] == 0, F.lit(0.0)).otherwise(brevity * F.exp(logs))


def bleu_scores(pairs: DataFrame) -> DataFrame:
    """Sentence BLEU-4 of each pair."""
    tokens = spread(pairs).select(
        "pos", bleu_tokens(F.col("prediction")).alias("p"), bleu_tokens(F.col("reference")).alias("r")
    )
    counted = tokens.select(
        "pos",
        clipped_overlaps(F.col("p"), F.col("r"), 4).alias("o"),
        F.size("p").alias("n_pred"),
        F.size("r").alias("n_ref"),
    )
    return counted.select("pos", bleu_value(F.col("o"), F.col("n_pred"), F.col("n_ref")).alias("bleu"))


def bleu(pairs: DataFrame) -> DataFrame:
    return bleu_scores(pairs).agg(
        F.avg("bleu").alias("bleu_mean"),
        F.stddev_pop("bleu").alias("bleu_std"),
        F.min("bleu").alias("bleu_min"),
        F.max("bleu").alias("bleu_max"),
    )


def f_measure(hit: Column, predicted: Column, expected: Column) -> Column:
    """Harmonic mean of precision and recall, 0 when there is nothing in common."""
    precision, recall = hit / F.greatest(predicted, F.lit(1)), hit / F.greatest(expected, F.lit(1))
    return F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def rouge_scores(pairs: DataFrame, stemmed: bool = True, longest: bool = True) -> DataFrame:
    """ROUGE-1, -2 and -L F-measure of each pair."""
    tokens = spread(pairs).select(
        "pos", rouge_tokens(F.col("prediction")).alias("p"), rouge_tokens(F.col("reference")).alias("r")
    )
    p, r = F.col("p"), F.col("r")
    counted = tokens.select(
        "pos",
        clipped_overlaps(p, r, 2, stemmed, longest).alias("o"),
        F.size(p).alias("n_pred"),
        F.size(r).alias("n_ref"),
    )
    scores = [
        f_measure(
            F.col("o")[n - 1],
            F.greatest(F.col("n_pred") - (n - 1), F.lit(0)),
            F.greatest(F.col("n_ref") - (n - 1), F.lit(0)),
        ).alias(f"rouge{n}")
        for n in (1, 2)
    ]
    if longest:
        scores.append(f_measure(F.col("o")[2], F.col("n_pred"), F.col("n_ref")).alias("rougeL"))
    return counted.select("pos", *scores)


def rouge(pairs: DataFrame) -> DataFrame:
    return rouge_scores(pairs).agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def caption_metrics(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """All text scores in one row; ``count`` is the number of predictions, paired or not."""
    count = predictions.agg(F.count("*")).scalar()
    both = pairs.select("pos", "prediction", "reference")
    scores = bleu_scores(both).join(rouge_scores(both), "pos")
    return scores.agg(
        F.avg("bleu").alias("bleu_mean"),
        F.stddev_pop("bleu").alias("bleu_std"),
        F.min("bleu").alias("bleu_min"),
        F.max("bleu").alias("bleu_max"),
        *[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")],
    ).withColumn("count", count)
