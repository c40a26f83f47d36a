"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import shared_dir

U64 = np.uint64
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, purpose: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """The same, and aggregates over its rows that are computed while writing, without a second scan."""
    seen = Observation()
    table = written(df.observe(seen, *[value.alias(name) for name, value in aggregates.items()]), purpose)
    return table, seen.get


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; a cluster sets it for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * MIX_B
    x = (x ^ (x >> U64(27))) * MIX_C
    return x ^ (x >> U64(31))


def weights(n: int) -> np.ndarray:
    """Odd multipliers for n places, unrelated to each other, so that sums of weighed items tell orders apart."""
    return mixed(np.arange(1, n + 1, dtype=U64) * MIX_A) | U64(1)


def bounded(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``limit``; a larger item is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python strings at a time.

    Between them Arrow gives back what it does not use: a worker outlives its task, and would keep its peak.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
            pool.release_unused()
    batch = None
    pool.release_unused()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, … for each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(total, dtype=np.int64)


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs without space or \\x09-\\x0D) and the words per text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    gap = SPACES[buf]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    length = ends - starts
    powers = np.full(int(length.max()), 0x100000001B3, U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)
    inside = ranges(starts, length)
    begins = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(inside)) - np.repeat(begins, length)
    values = np.add.reduceat((buf[inside].astype(U64) + U64(1)) * powers[place], begins)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.diff(np.searchsorted(starts, bounds))
    return mixed(values + length.astype(U64) * MIX_A), counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and how many; a shorter text is one run."""
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = ranges(begins, n)
    left = np.repeat(np.minimum(counts, size), n)
    out = np.repeat(np.minimum(counts, size).astype(U64) * MIX_B, n)
    for j in range(size):
        use = left > j
        term = words[np.where(use, at + j, 0)] if len(words) else out
        out = np.where(use, mixed(out + MIX_A) ^ term * MIX_C, out)
    return mixed(out), n


class Store(dict):
    """A dict of the entries used lately: when full, it starts anew and takes back what is asked for."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def all(self, keys: list) -> list:
        """The values of the keys, None where there is none."""
        found = list(map(self.get, keys))
        if self.old:
            old = self.old
            for i, value in enumerate(found):
                if value is None and (value := old.get(keys[i])) is not None:
                    found[i] = value
                    self.put(keys[i], value)
        return found
