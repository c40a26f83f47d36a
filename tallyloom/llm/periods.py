"""Periodic runs of words by internal pattern matching.

A run is a stretch with smallest period q (words q apart are equal) of at least ``max(LEAST, TIMES * q)`` words
that cannot be extended.  The words of a block of documents are numbered and put one after the other, each
document closed by a number of its own, so nothing matches across documents.

* Prefix doubling names the stretches of 2, 4, 8, … words and yields the suffix array; the names of all
  lengths stay as tables, which compare and extend stretches by doubling steps.
* The dyadic blocks of length 2 ** k (starts divisible by it) answer for the periods q with
  2 ** (k + 1) <= 3 * q + 1 < 2 ** (k + 2): the first block inside a run ends early enough to occur again q
  words later, inside the run.  A block whose name is unique has no other place and is skipped.
* For the others, a wavelet tree over the suffix array answers range successor: the least place after a given
  one among the suffixes that begin with the block.  The places in the window of the level's periods overlap
  by more than half a block, so they are one arithmetic progression.  One or two places give their distances
  as candidates.  Of three or more, whose step g is a period of the block, only one can be q: the one that
  moves the end of the block's stretch of period g onto the end of the other's.
* Candidates are extended to both sides; those long enough are runs.  A stretch found with several periods
  has the smallest of them.

Blocks hold at most ``BLOCK_BYTES`` of text, or one document.  Documents are independent, so there is no shuffle.

Defined results: null texts and texts without words have no words and no runs; a null doc_id is never edited
(its checksum is no number).  Repeated rows give repeated rows.  Other columns are ignored by the query and
kept by ``collapsed``, which replaces the text.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded, ranges, word_hashes

LEAST = 6
TIMES = 4
BLOCK_BYTES = 1 << 20


class Names:
    """Names of all stretches of 1, 2, 4, … items of a sequence, and its suffix array.

    The name of a stretch is the number of suffixes that are smaller than all that begin with it.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        order = np.argsort(items, kind="stable")
        name = self._named(items[order], order, np.zeros(n, np.int64))
        self.levels, step = [name], 1
        while True:
            name = self.levels[-1]
            sizes = np.bincount(name, minlength=n)
            open_ = sizes[name[order]] > 1  # places of the suffix array that are not decided yet
            if not open_.any():
                break
            at = np.flatnonzero(open_)
            who = order[at]
            after = np.where(who + step < n, name[np.minimum(who + step, n - 1)] + 1, 0)
            key = name[who] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            who, key = who[by], key[by]
            order[at] = who
            finer = name.copy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            finer[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            self.levels.append(finer)
            step *= 2
        self.order = order

    @staticmethod
    def _named(sorted_items: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = sorted_items[1:] != sorted_items[:-1]
        out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on."""
        n, a0 = len(self.order), a
        for k in range(len(self.levels) - 1, -1, -1):
            step, name = 1 << k, self.levels[k]
            fits = (a < n) & (b < n)
            same = fits & (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)])
            a, b = a + same * step, b + same * step
        return a - a0

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b."""
        a0 = a
        for k in range(len(self.levels) - 1, -1, -1):
            step, name = 1 << k, self.levels[k]
            fits = (a >= step) & (b >= step)
            same = fits & (name[np.maximum(a - step, 0)] == name[np.maximum(b - step, 0)])
            a, b = a - same * step, b - same * step
        return a0 - a


class Wavelet:
    """A wavelet tree (its levels stored as matrices) over a permutation part: range successor."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.counts = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.counts.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(len(values) - int(self.counts[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def up_to(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the ranges are at most x."""
        total = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.counts[level], self.zeros[level]
            one_lo, one_hi = ones[lo], ones[hi]
            high = ((x >> b) & 1) == 1
            total += np.where(high, (hi - lo) - (one_hi - one_lo), 0)
            lo, hi = np.where(high, zeros + one_lo, lo - one_lo), np.where(high, zeros + one_hi, hi - one_hi)
        return total + (hi - lo)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range."""
        out = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.counts[level], self.zeros[level]
            one_lo, one_hi = ones[lo], ones[hi]
            low = (hi - lo) - (one_hi - one_lo)
            high = k >= low
            out += high.astype(np.int64) << b
            k = np.where(high, k - low, k)
            lo, hi = np.where(high, zeros + one_lo, lo - one_lo), np.where(high, zeros + one_hi, hi - one_hi)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value above x in each range, or -1."""
        k = self.up_to(lo, hi, x)
        found = np.full(len(lo), -1)
        some = np.flatnonzero(k < hi - lo)
        found[some] = self.nth(lo[some], hi[some], k[some])
        return found


def level_periods(k: int) -> tuple[int, int]:
    """Least and greatest period that the blocks of length 2 ** k answer for."""
    low = -(-((1 << (k + 1)) - 1) // 3)
    return (1 if k == 1 else low), -(-((1 << (k + 2)) - 1) // 3) - 1


def candidates(names: Names, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which a run may be; ``longest`` is the greatest document's number of words."""
    n = len(names.order)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(names.levels) < 2:
        return places[0], periods[0]
    # only suffixes whose first two items stand elsewhere too can be asked for
    pair = names.levels[1]
    often = np.bincount(pair, minlength=n)[pair] > 1
    ranked = often[names.order]
    before = np.concatenate([[0], np.cumsum(ranked)])
    tree = Wavelet(names.order[ranked], n)
    for k in range(1, len(names.levels)):
        least, most = level_periods(k)
        size = 1 << k
        if TIMES * least > longest:
            break
        name = names.levels[k]
        at = np.arange(0, n, size)
        sizes = np.bincount(name, minlength=n)
        at = at[sizes[name[at]] > 1]
        if not len(at):
            continue
        lo = before[name[at]]
        hi = before[name[at] + sizes[name[at]]]
        one = tree.successor(lo, hi, at + least - 1)
        near = (one >= 0) & (one - at <= most)
        at, lo, hi, one = at[near], lo[near], hi[near], one[near]
        if not len(at):
            continue
        two = tree.successor(lo, hi, one)
        two = np.where((two >= 0) & (two - at <= most), two, -1)
        more = np.flatnonzero(two >= 0)
        three = np.full(len(at), -1)
        three[more] = tree.successor(lo[more], hi[more], two[more])
        three = np.where((three >= 0) & (three - at <= most), three, -1)
        few = three < 0
        places += [at[few], at[few & (two >= 0)]]
        periods += [one[few] - at[few], (two - at)[few & (two >= 0)]]
        at, one, step = at[~few], one[~few], (two - one)[~few]
        end = at + step + names.right(at, at + step)
        other = one + step + names.right(one, one + step)
        period = other - end
        good = (period >= least) & (period <= most)
        places.append(at[good])
        periods.append(period[good])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (word number), length and period of all runs, by document, start and period.

    ``words`` are numbers that tell words apart, ``counts`` the words of each document.
    """
    n_docs = len(counts)
    empty = np.zeros(0, np.int64)
    if not len(words) or int(counts.max()) < LEAST:
        return empty, empty, empty, empty
    _, number = np.unique(words, return_inverse=True)
    top = int(number.max()) + 1
    ends = np.cumsum(counts)
    items = np.insert(number, ends, top + np.arange(n_docs))
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    names = Names(items)
    at, period = candidates(names, int(counts.max()))
    length = names.right(at, at + period)
    start = at - names.left(at, at + period)
    length += period + at - start
    good = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    doc = np.searchsorted(begins, start, "right") - 1
    return doc, start - begins[doc], length, period


def repeats_of(words: np.ndarray, counts: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The runs, and which of all words are repeats: inside a run, after its first period."""
    doc, start, length, period = found = runs_of(words, counts)
    change = np.zeros(len(words) + 1, np.int64)
    begin = (np.cumsum(counts) - counts)[doc] + start
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    return found, np.cumsum(change[:-1]) > 0


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]
    for a, b in bounded([len(t) for t in texts], BLOCK_BYTES):
        yield a, b, texts[a:b]


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run of the text cut to its first period; words are joined by one space."""
    fields, place = docs.schema.fields, docs.columns.index(text)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _blocks(batch, place):
                hashes, counts = word_hashes(texts)
                _, gone = repeats_of(hashes, counts)
                ends = np.cumsum(counts)
                new = []
                for t, i, j in zip(texts, ends - counts, ends, strict=True):
                    words = t.split()
                    new.append(b" ".join([words[w] for w in np.flatnonzero(~gone[i:j]).tolist()]).decode("utf-8", "replace"))
                columns = [batch.column(c).slice(a, b - a) for c in range(len(fields))]
                columns[place] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in fields)
    return docs.withColumn(text, F.col(f"`{text}`").cast("string")).mapInArrow(collapse, schema)


def edit(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of an edited document; None if it is not edited."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


RESULT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
)


def period_query(documents: DataFrame) -> DataFrame:
    """Per document: its runs after the contract's edit of the words, and the text without repeats."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in _blocks(batch, 1):
                hashes, counts = word_hashes(texts)
                ends = np.cumsum(counts)
                begins = ends - counts
                edits = {}
                for n, doc_id in enumerate(ids[a:b]):
                    if (places := edit(doc_id, int(counts[n]))) is not None:
                        edits[n] = places
                        hashes[begins[n] : ends[n]] = hashes[begins[n] + places]
                (doc, start, length, period), gone = repeats_of(hashes, counts)
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                changed = np.add.reduceat(np.append(gone, False), np.append(begins, len(gone)))[:-1] * (counts > 0)
                rows = []
                for n, t in enumerate(texts):
                    words = t.split()
                    if n in edits or changed[n]:
                        places = edits.get(n)
                        kept = np.flatnonzero(~gone[begins[n] : ends[n]])
                        words = [words[i] for i in (kept if places is None else places[kept]).tolist()]
                    i, j = bounds[n], bounds[n + 1]
                    best, lines = (None,) * 4, b""
                    if i < j:
                        found = list(zip(start[i:j].tolist(), length[i:j].tolist(), period[i:j].tolist(), strict=True))
                        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
                        best = (s, m, q, 1000 * m // q)
                        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
                    rows.append((ids[a + n], j - i, *best, digest(lines), digest(b" ".join(words))))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(find, schema)
