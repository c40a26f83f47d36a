"""Token ids as concatenated binary arrays with Elias-Fano coded document boundaries.

A shard file holds, in this order: the ids of its documents one after the other (little-endian, two
bytes each if the vocabulary allows, else four); the document ids (int64); the low and the high part of
the Elias-Fano code of the documents' ends; a footer of fixed size.  With n documents and m ids the code
takes n * (2 + log2(m / n)) bits; ``select`` finds an end in it by sampled positions, without a table of
64-bit offsets.

The table is ordered by doc_id with a range partitioning; each task streams its part to one file of the
shared folder, under a name of its own, so a repeated task leaves an unused file and no damage.  The
list of the files that count is written as a table.  Ids are made by the tokenizers library; runs of
text are encoded once per worker and kept (at most twice ``KEPT``), which is exact, as they are cut only
where the vocabulary's expressions never match across.

Defined results: a null text counts as empty and has the end id alone.  Rows with equal doc_id follow
each other; null ids come first and stay null.  An empty table gives an empty table.
"""

from __future__ import annotations

import array
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Store, bounded, parts, written
from tallyloom.session import shared_dir

FILE = "byte_bpe_50k.json"
END_ID = 0
KEPT = 300_000
MAGIC = b"TLEF0001"
FOOTER = "<8sBBQQQQQ"  # magic, id width, low bits, documents, null ids, ids, low and high bytes
SAMPLE = 256
BLOCK = 4096
BLOCK_BYTES = 1 << 23
SPACES = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
MARK, CLOSE = "\x01", "\x02"  # a run that has no space before it; the end of a text
RUNS = 4096
ODD_SPACE = f" [{SPACES}]|[{SPACES}] |{MARK}"
CUTS = (
    (r"(\pL)([.,;:!?]+[ \n])", rf"\1 {MARK}\2"),
    (rf"([^{SPACES}])\n([^{SPACES}])", "\\1 " + MARK + "\n " + MARK + "\\2"),
)


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(last / n) bits per value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones.reshape(-1, SAMPLE).sum(axis=1))])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        lows = values & ((1 << low_bits) - 1)
        bits = (lows[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        size = -(-(int(places[-1]) + 1 if n else 0) // 8)
        high = np.zeros(-(-max(size, 1) // SAMPLE) * SAMPLE, np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return cls(n, low_bits, low, high)

    def select(self, first: int, last: int) -> np.ndarray:
        """The values number first up to (not including) last."""
        if last <= first:
            return np.zeros(0, np.int64)
        a = int(np.searchsorted(self.before, first, "right")) - 1
        b = int(np.searchsorted(self.before, last, "left"))
        bits = np.flatnonzero(np.unpackbits(self.high[a * SAMPLE : b * SAMPLE], bitorder="little"))
        skip = first - int(self.before[a])
        places = bits[skip : skip + last - first] + a * SAMPLE * 8
        upper = (places - np.arange(first, last)) << self.low_bits
        if not self.low_bits:
            return upper
        from_bit, to_bit = first * self.low_bits, last * self.low_bits
        window = np.unpackbits(self.low[from_bit // 8 : -(-to_bit // 8)], bitorder="little")[from_bit % 8 :]
        rows = window[: (last - first) * self.low_bits].reshape(-1, self.low_bits).astype(np.int64)
        return upper + (rows << np.arange(self.low_bits)).sum(axis=1)


class Encoder:
    """Ids of texts, by the tokenizers library.

    The texts of a batch are cut where the vocabulary's expressions always end a match: between single
    spaces, before a final run of punctuation, around a single line feed.  Arrow puts the runs into a
    dictionary, so Python sees each distinct run once per batch, and puts the ids of all runs together.
    Runs seen before are looked up, new ones encoded by the library, many at once: an added token of the
    vocabulary stands between them, as the library cuts texts at added tokens before all else.  Texts with
    other white space around a space, or with an added token or a mark, go to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        added = self.tokenizer.get_added_tokens_decoder()
        self.odd = "|".join([ODD_SPACE, CLOSE, *(re.escape(t.content) for t in added.values())])
        plain = [(t.content, i) for i, t in sorted(added.items()) if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between, self.between_id = plain[0] if plain else ("", -1)
        self.kept = Store(KEPT)

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array("H" if self.width == 2 else "I", ids).tobytes()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.between:
            found = (self.tokenizer.encode_batch_fast(texts[i : i + RUNS], add_special_tokens=False) for i in range(0, len(texts), RUNS))
            return [self._bytes(e.ids) for batch in found for e in batch]
        out = []
        for i in range(0, len(texts), RUNS):
            joined = self.between.join(texts[i : i + RUNS])
            data = self._bytes(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            places = np.flatnonzero(np.frombuffer(data, self.kind) == self.between_id) * self.width
            starts = [0, *(places + self.width).tolist()]
            out += [data[a:b] for a, b in zip(starts, [*places.tolist(), len(data)], strict=True)]
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs: those with MARK as they are, others with the space before them."""
        data = self.kept.all(runs)
        new = [i for i, d in enumerate(data) if d is None]
        found = self._encoded([run[1:] if (run := runs[i])[:1] == MARK else " " + run for i in new])
        for i, ids in zip(new, found, strict=True):
            data[i] = ids
            self.kept.put(runs[i], ids)
        return data

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each closed by END_ID, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pc.if_else(odd, "", texts) if len(whole) else texts
        for pattern, by in CUTS:
            cut = pc.replace_substring_regex(cut, pattern, by)
        # a first run has no space before it, and the last run stands for the end id
        cut = pc.binary_join_element_wise(*(x if x is cut else pa.scalar(x, cut.type) for x in (MARK, cut, f" {CLOSE}", "")))
        lists = pc.split_pattern(cut, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary.to_pylist()
        data = self._runs(runs)
        if CLOSE in runs:
            data[runs.index(CLOSE)] = self._bytes([END_ID])
        codes = coded.indices
        if len(whole):
            codes = codes.to_numpy().astype(np.int64)
            codes[offsets[whole]] = len(data) + np.arange(len(whole))
            for i in whole.tolist():
                data.append(self._bytes(self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids))
        together = pa.array(data, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(together.buffers()[1], np.int64)[: len(together) + 1] if len(together) else np.zeros(1, np.int64)
        held = together.buffers()[2] if len(together) else b""
        ids = np.frombuffer(held, self.kind)[: int(ends[-1]) // self.width]
        return ids, np.diff(ends[offsets]) // self.width


@cache
def loaded(path: str) -> Encoder:
    return Encoder(path)


def write_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shard files; the table of them: shard, file, n_docs, n_ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path or public_tokenizers.path(FILE))
        shard, ids, ends, nulls, total, out, name = TaskContext.get().partitionId(), [], [], 0, 0, None, ""
        for batch in batches:
            if out is None:
                system, base = pyarrow.fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                name = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex[:12]}.bin"
                out = system.open_output_stream(f"{base}/{name.rpartition('/')[2]}")
            nulls += batch.column(0).null_count
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for a, b in bounded(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BLOCK_BYTES):
                data, lengths = encoder.encode(batch.column(1).slice(a, b - a))
                out.write(data.tobytes())
                ends.append(total + np.cumsum(lengths))
                total += int(lengths.sum())
        if out is None:
            return
        code = EliasFano.of(np.concatenate(ends) if ends else np.zeros(0, np.int64))
        for data in (*ids, code.low, code.high):
            out.write(data.tobytes())
        out.write(struct.pack(FOOTER, MAGIC, encoder.width, code.low_bits, code.n, nulls, total, len(code.low), len(code.high)))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [code.n], "n_ids": [total]})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id")
    shards = ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long")
    return written(shards, "token-shards")


def read_documents(file: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a shard: document ids, which of them are null, their starts and ends, all their ids."""
    system, path = pyarrow.fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as data:
        size = data.size()
        data.seek(size - struct.calcsize(FOOTER))
        magic, width, low_bits, n, nulls, total, low, high = struct.unpack(FOOTER, data.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{file} is not a token file")
        at = total * width
        data.seek(at + 8 * n)
        code = EliasFano(n, low_bits, np.frombuffer(data.read(low), np.uint8), np.frombuffer(data.read(high), np.uint8))
        begin = 0
        for first in range(0, n, BLOCK):
            last = min(first + BLOCK, n)
            ends = code.select(first, last)
            data.seek(at + 8 * first)
            ids = np.frombuffer(data.read(8 * (last - first)), "<i8")
            starts = np.concatenate([[begin], ends[:-1]])
            data.seek(begin * width)
            tokens = np.frombuffer(data.read((int(ends[-1]) - begin) * width), f"<u{width}")
            yield ids, np.arange(first, last) < nulls, np.stack([starts, ends], axis=1), tokens
            begin = int(ends[-1])


def read_files(shards: DataFrame) -> DataFrame:
    """Read shard files back: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    listed, start = [], 0
    for row in sorted(shards.collect()):  # one row per file, as many as partitions wrote
        listed.append((row["file"], start))
        start += row["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids, nulls, bounds, tokens in read_documents(file):
                    wide = tokens.astype("<u4")
                    places = bounds - bounds[0, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, mask=nulls),
                            pa.array(bounds[:, 0] + before),
                            pa.array(bounds[:, 1] - bounds[:, 0]),
                            pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in places], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    table = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_query(documents: DataFrame) -> DataFrame:
    folder = shared_dir(documents.sparkSession, "token-files")
    return read_files(write_files(documents.select("doc_id", "text"), folder))
