"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points.  On every level equal neighbours become one symbol (with their count),
then deterministic coin tossing gives each symbol a small label: twice the lowest bit in which it differs
from its left neighbour, plus that bit.  Neighbours keep different labels, and after ``len(TABLES) + 1``
rounds labels are below 8.  Phrases begin at labels that exceed both neighbours' labels, so where a phrase
begins depends on a few symbols around it alone.  A phrase's name is a hash of its symbols' names; the names
are the next level's sequence, until one name stands for the whole text.  Equal substrings thus have equal
names inside, wherever they stand.

The names of level ``LEVEL`` and above are a text's set (a text that ends below it has its last name).  Its
fingerprint are the ``KEPT`` smallest hashes of the set, 32 bits each, in hexadecimal.  The likeness of two
fingerprints is the share of common values among the ``KEPT`` smallest values of both: the exact Jaccard
similarity of small sets, an estimate of it for larger ones.

All texts of a block are parsed at once, each behind a mark that separates it from the one before.

Defined results: a null text counts as empty and has the empty fingerprint; two empty fingerprints are alike
(1), an empty one and another are not (0).  For the next document, rows are ordered by doc_id, null first,
then by a hash of the text; the last row is followed by the first, and a single row by itself.  Repeated rows
give repeated rows.  Other columns are kept by ``fingerprints`` and ignored by ``with_next``.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import MIX_A, U64, bounded, mixed, parts, weights

LEVEL = 2
KEPT = 128
BLOCK_CHARS = 1 << 19
# the mark before each text: no code point, and no name (names have their highest bit cleared)
MARKS = {4: np.uint32(1 << 30), 8: U64(1 << 63)}
RUN_BIT = np.uint32(1 << 31)
FIRST_MARK = 128  # label of a mark after the first round


def _table(bits: int) -> np.ndarray:
    """The label of a symbol of so many bits, by its left neighbour (high part of the index) and itself."""
    left, own = np.divmod(np.arange(1 << (2 * bits)), 1 << bits)
    differ = left ^ own
    lowest = differ & -differ
    place = np.bitwise_count(np.maximum(lowest - 1, 0)).astype(np.int64)
    return (2 * place + ((own & lowest) != 0)).astype(np.uint8)


# labels below 129, 17 and 11 become labels below 16, 10 and 8; the mark gets the number after them
TABLES = [(bits, _table(bits), mark) for bits, mark in ((8, 16), (5, 10), (4, 8))]


def _without_runs(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours as one symbol, and the places of the marks after that."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    if len(starts) == len(x):
        return x, marks
    counts = np.diff(np.append(starts, len(x)))
    x = x[starts]
    many = np.flatnonzero(counts > 1)
    names = mixed(x[many].astype(U64) + counts[many].astype(U64) * MIX_A)
    x[many] = (names.astype(np.uint32) | RUN_BIT) if x.itemsize == 4 else names >> U64(1)
    return x, np.searchsorted(starts, marks)


def _labels(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Small labels by deterministic coin tossing; those of marks exceed all others."""
    differ = x[1:] ^ x[:-1]
    lowest = differ & (~differ + x.dtype.type(1))
    label = np.empty(len(x), np.uint8)
    place = np.bitwise_count(lowest - x.dtype.type(1))
    label[1:] = ((place & np.uint8(63)) << np.uint8(1)) | ((x[1:] & lowest) != 0)
    label[marks] = FIRST_MARK
    for bits, table, mark in TABLES:
        at = label[:-1].astype(np.uint16)
        at <<= bits
        at |= label[1:]
        label[1:] = table[at]
        label[marks] = mark
    return label


def _phrases(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level, and the places of the marks among them."""
    label = _labels(x, marks)
    begins = np.zeros(len(x), bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begins[marks] = True
    begins[marks + 1] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(x)))
    place = np.arange(len(x))
    place -= np.repeat(starts, sizes)
    names = np.add.reduceat((x.astype(U64) + U64(1)) * weights(int(sizes.max()))[place], starts)
    names = mixed(names + sizes.astype(U64) * MIX_A) >> U64(1)
    marks = np.searchsorted(starts, marks)
    names[marks] = MARKS[8]
    return names, marks


def name_sets(texts: list[str], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Owner and name of all phrases from ``level`` on, sorted by owner and hash, each once."""
    live = np.array([n for n, t in enumerate(texts) if t], np.int64)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sizes = np.array([len(texts[n]) for n in live], np.int64)
    x = np.frombuffer("\0".join(["", *(texts[n] for n in live)]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    marks = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    x[marks] = MARKS[4]
    owners, names, depth = [], [], 0
    while len(live):
        x, marks = _without_runs(x, marks)
        x, marks = _phrases(x, marks)
        depth += 1
        counts = np.diff(np.append(marks, len(x))) - 1
        done = counts == 1
        shown = np.ones(len(live), bool) if depth >= level else done
        keep = np.repeat(shown, counts + 1)
        keep[marks] = False
        owners.append(np.repeat(live, counts * shown))
        names.append(x[keep])
        if done.any():
            stay = np.repeat(~done, counts + 1)
            x, live = x[stay], live[~done]
            marks = np.concatenate([[0], np.cumsum(counts[~done] + 1)])[:-1]
    owner, name = np.concatenate(owners), mixed(np.concatenate(names) + MIX_A)
    order = np.lexsort((name, owner))
    owner, name = owner[order], name[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], name[fresh]


def sketches(texts: list[str]) -> list[str]:
    """The fingerprints of texts."""
    owner, name = name_sets(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    short = (name >> U64(32)).astype(">u4")
    return [short[a : min(b, a + KEPT)].tobytes().hex() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def likeness(one: str, other: str) -> float:
    """The share of common values among the smallest values of two fingerprints."""
    if one == other:
        return 1.0
    a, b = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (one, other))
    smallest = sorted(a | b)[:KEPT]
    return sum(v in a and v in b for v in smallest) / len(smallest)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text; a column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name != name]
    keep = [F.col(f"`{f.name}`") for f in fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in bounded([len(t) for t in texts], BLOCK_CHARS):
                columns = [batch.column(i).slice(a, b - a) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches(texts[a:b]), pa.string())], names=[*(f.name for f in fields), name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` string"])
    return docs.select(*keep, F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(add, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LEAST_ID = -(1 << 63)  # orders rows without an id


def _judged(rows: list[tuple], changed: list[str], prints: list[str]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, fingerprint), all but the last, which only follows."""
    out = [
        (n, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own, other, likeness(own, other), likeness(own, after))
        for (n, text, own), (_, _, after), new, other in zip(rows, rows[1:], changed, prints, strict=False)
    ]
    columns = list(zip(*out, strict=True)) or [()] * len(RESULT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def first_rows(rows: DataFrame) -> list[tuple[int, int]]:
    """Order and hash of the first row of each range that Spark deals the rows out to: one per partition."""
    keys = rows.select("k", "h").repartitionByRange(parts(rows.sparkSession), "k", "h")
    firsts = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("k", "h")).alias("first"))
    return sorted((r["first"]["k"], r["first"]["h"]) for r in firsts.collect())


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next.

    Ranges of (id, hash of the text) are found on these two numbers alone; their first rows, one per
    partition, go to the tasks.  Each row is then sent to its range, and a range's first row to the range
    before too, so texts move once and every task streams its range in order, the next text at hand.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)).alias("k")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", order, F.xxhash64("text").alias("h"))
    firsts = first_rows(rows)
    starts, hashes = (np.array([f[i] for f in firsts], np.int64) for i in (0, 1))
    n_ranges = max(1, len(firsts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(c).to_numpy() for c in ("k", "h"))
            part = np.searchsorted(starts, k, "right") - 1
            low = np.searchsorted(starts, k, "left")
            for i in np.flatnonzero(low <= part).tolist():  # ids at which a range begins
                part[i] = low[i] + np.searchsorted(hashes[low[i] : part[i] + 1], h[i], "right") - 1
            first = np.flatnonzero((starts[part] == k) & (hashes[part] == h))
            first = first[np.unique(part[first], return_index=True)[1]]
            at = np.concatenate([np.arange(len(k)), first])
            where = np.concatenate([part, (part[first] - 1) % n_ranges]).astype(np.int32)
            peek = np.arange(len(at)) >= len(k)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where), pa.array(peek)], names=["doc_id", "text", "k", "h", "part", "peek"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = [], False
        for batch in batches:
            if done:
                continue  # further copies of the row that follows the range
            ids, texts, peeks = (batch.column(i).to_pylist() for i in range(3))
            if done := any(peeks):
                stop = peeks.index(True) + 1
                ids, texts = ids[:stop], texts[:stop]
            texts = [t or "" for t in texts]
            for a, b in bounded([len(t) for t in texts], BLOCK_CHARS):
                bodies = [r[1] for r in last] + texts[a:b]
                changed = [edited(t, n) for t, n in zip(bodies, bodies[1:])]
                prints = sketches(texts[a:b] + changed)
                held = last + list(zip(ids[a:b], texts[a:b], prints, strict=False))
                yield _judged(held, changed, prints[b - a :])
                last = held[-1:]

    dealt = rows.mapInArrow(deal, "doc_id long, text string, k long, h long, part int, peek boolean")
    sent = dealt.repartitionById(n_ranges, F.col("part")).sortWithinPartitions("peek", "k", "h")
    return sent.select("doc_id", "text", "peek").mapInArrow(stream, SCHEMA)


def fingerprint_query(documents: DataFrame) -> DataFrame:
    return with_next(documents.select("doc_id", "text"))
