"""Byte-pair encoding and decoding with a given vocabulary file.

A word becomes a doubly linked list of symbols.  A heap holds the merge rank of every adjacent pair; the
lowest rank is merged first, and entries whose symbols have changed since are skipped when they come up.
Symbols are numbers and a heap entry is one number, rank and place; the bytes of all new words of a block and
the ranks of their first pairs come from tables at once.  Decoding concatenates the vocabulary's strings as the vocabulary's library does.

The file's steps are followed: its added tokens are cut out of the raw text, the rest is put into NFC,
white space becomes one space, letters are lowered, and words are split, mapped to byte characters and
closed by the word-end mark.  White space separates words for good, so the codes of a run of
non-space characters can be kept and used again; the store holds at most twice ``KEPT`` runs and words per worker.

Python's Unicode tables may lack characters that the vocabulary's library knows.  A text with a code point
that Python does not assign, or a mark that it orders otherwise, is put into normal form and cut into words by the library; its words are merged
by the same heap.

Defined results: a null text counts as empty and has no tokens; the hash of nothing is that of an empty
string.  Bytes without a vocabulary entry are left out, as the file has no unknown token.  Repeated rows
give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from tallyloom.llm.common import Store, bounded, slices

KEPT = 60_000
BLOCK_CHARS = 1 << 21
# characters of the words that are merged together
WORD_CHARS = 1 << 18
# symbols: 256 bytes, the same at the end of a word, the stop behind a word, then what merges make
LAST, STOP = 256, 512
# a heap entry is rank * PLACES + place
PLACE_BITS = 32
FILE = "word_bpe_49k.json"
# white space of the file's expressions
SPACE = "\t-\r\x20\x85\xa0  -     　"


def unassigned(ordered: Callable[[str], str]) -> np.ndarray:
    """Which code points Python's Unicode tables do not assign, or are marks that they order otherwise."""
    marks = [chr(n) for n in range(0x20000) if unicodedata.combining(chr(n))]
    moved = [ord(c) for c in marks if any(unicodedata.normalize("NFC", t) != ordered(t) for x in ("\u0301", "\u0323") for t in (c + x, x + c))]
    table = np.fromiter((unicodedata.category(chr(n)) == "Cn" for n in range(0x110000)), bool, 0x110000)
    table[moved] = True
    return table


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else 256, 257, …"""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.unknown = unassigned(NFC().normalize_str)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._number({pair: i for i, pair in enumerate(pairs)}, model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.other_spaces = regex.compile("[" + SPACE.replace("\x20", "") + "]")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        size = max(self.strings) + 1
        self.shown = pa.array(map(str, range(size)), pa.string()), pa.array([self.strings.get(i) for i in range(size)], pa.string())
        self.kept = Store(KEPT)

    def _number(self, ranks: dict[tuple[str, str], int], end: str) -> None:
        """The tables of the merges, with numbers for symbols."""
        characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(characters)}
        names = [*characters, *(c + end for c in characters), None]
        numbers = {s: i for i, s in enumerate(names)}
        for a, b in ranks:
            for s in (a, b, a + b):
                if s not in numbers:
                    numbers[s] = len(names)
                    names.append(s)
        # id of each symbol, -1 without one, as at the stop and for a symbol that was merged into another
        self.ids = np.array([*(self.vocabulary.get(s, -1) for s in names), -1], np.int64)
        self.ids[STOP] = -1
        self.made = [0] * (max(ranks.values(), default=-1) + 1)
        none: dict[int, int] = {}
        self.after = [none] * len(names)
        self.first = np.full((STOP + 1, STOP + 1), -1, np.int64)
        for (a, b), rank in ranks.items():
            left, right, entry = numbers[a], numbers[b], rank << PLACE_BITS
            self.made[rank] = numbers[a + b]
            if self.after[left] is none:
                self.after[left] = {}
            self.after[left][right] = entry
            if left < STOP and right < STOP:
                self.first[left, right] = entry

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids (four bytes each) of each word after all merges."""
        stops = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
        starts = np.concatenate([[0], stops + 1])[:-1]
        symbols = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(np.int64)
        symbols[stops[stops > starts] - 1] += LAST
        symbols[stops] = STOP
        entries = np.full(len(symbols), -1, np.int64)
        entries[:-1] = self.first[symbols[:-1], symbols[1:]]
        found = np.flatnonzero(entries >= 0)
        entries[found] += found - starts[np.searchsorted(starts, found, "right") - 1]
        heaps = np.searchsorted(found, np.append(starts, len(symbols))).tolist()
        held, entries, symbols = entries[found].tolist(), entries.tolist(), symbols.tolist()
        for n, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            if heaps[n] < heaps[n + 1]:
                symbols[start:stop] = self._merge(symbols[start : stop + 1], entries[start : stop + 1], held[heaps[n] : heaps[n + 1]])[:-1]
        ids = self.ids[symbols]
        kept = np.concatenate([[0], np.cumsum(ids >= 0)]) * 4
        data = ids[ids >= 0].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(kept[starts].tolist(), kept[stops].tolist(), strict=True)]

    def _merge(self, symbols: list[int], now: list[int], heap: list[int]) -> list[int]:
        """The symbols of a word and the stop after all merges, -1 for those that went into the one before.

        ``now`` has the heap entry of the pair that begins at each place; the place before the first one is the stop's.
        """
        n, after, made, mask = len(symbols), self.after, self.made, (1 << PLACE_BITS) - 1
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if now[i] != entry:
                continue  # stale
            j = right[i]
            k = right[i] = right[j]
            left[k] = i
            symbols[i] = new = made[entry >> PLACE_BITS]
            symbols[j] = now[j] = -1
            if (entry := after[new].get(symbols[k])) is None:
                now[i] = -1
            else:
                now[i] = entry = entry + i
                heappush(heap, entry)
            p = left[i]
            if (entry := after[symbols[p]].get(new)) is None:
                now[p] = -1
            else:
                now[p] = entry = entry + p
                heappush(heap, entry)
        return symbols

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs without white space."""
        data = self.kept.all(runs)
        # letters alone are one word
        cut = {run: [run] if run.isalpha() else self.words.findall(run) for run, d in zip(runs, data, strict=True) if d is None}
        words = list({word: None for found in cut.values() for word in found})
        known = dict(zip(words, self.kept.all(words), strict=True))
        words = [w for w, d in known.items() if d is None]
        for a, b in bounded([len(w) for w in words], WORD_CHARS):
            for word, ids in zip(words[a:b], self.merged([w.encode("utf-8", "replace") for w in words[a:b]]), strict=True):
                known[word] = ids
                self.kept.put(word, ids)
        for i, run in enumerate(runs):
            if data[i] is None:
                data[i] = known.get(run)
                if data[i] is None:
                    data[i] = b"".join([known[w] for w in cut[run]])
                    self.kept.put(run, data[i])
        return data

    def _shown(self, data: list[bytes]) -> tuple[np.ndarray, list[pa.Array]]:
        """Number of tokens, and ids and strings (each joined by one space), of what ids stand for."""
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        ids = pa.array(np.frombuffer(b"".join(data), "<u4"))
        # the file names no decoder: its library puts a space between the vocabulary's strings
        return sizes, [pc.binary_join(pa.ListArray.from_arrays(bounds, s.take(ids)), " ") for s in self.shown]

    def normal(self, text: str) -> str:
        text = self.other_spaces.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def strange(self, texts: list[str]) -> set[int]:
        """Which texts hold a code point that Python does not know."""
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(self.unknown[codes])
        if not len(at):
            return set()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return set(np.searchsorted(ends, at, "right").tolist())

    def codes(self, texts: list[str]) -> tuple[list[int], pa.Array, pa.Array]:
        """Number of tokens, ids joined by one space, and decoded text, of each text.

        Arrow cuts the normal texts at spaces, finds the distinct runs, and joins what they stand for.
        """
        normal, specials, strange = [], {}, self.strange(texts)
        for n, text in enumerate(texts):
            if ("<|" in text and self.cut.search(text)) or n in strange:
                specials[n] = text
                text = ""
            normal.append(self.normal(text))
        # a word and the punctuation that ends its run are coded apart anyway
        cut = pc.replace_substring_regex(pa.array(normal, pa.large_string()), r"(\pL)([.,;:!?]+ )", r"\1 \2")
        lists = pc.split_pattern(cut, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary.to_pylist()
        sizes, shown = self._shown(self._runs(runs))
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        held = counts > 0  # runs without tokens would leave empty strings in the joined ones
        bounds = pa.array(np.concatenate([[0], np.cumsum(held)])[offsets], pa.int32())
        totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets]).tolist()
        out = []
        for strings in shown:
            out.append(pc.binary_join(pa.ListArray.from_arrays(bounds, strings.take(pa.array(codes[held]))), " "))
        if specials:
            ids, decoded = (x.to_pylist() for x in out)
            for n, text in specials.items():
                totals[n], ids[n], decoded[n] = self._with_added(text)
            out = [pa.array(x, pa.string()) for x in (ids, decoded)]
        return totals, *out

    def _with_added(self, text: str) -> tuple[int, str, str]:
        """The same for a text that holds added tokens."""
        parts = []
        for piece in self.cut.split(text):
            if piece in self.added:
                parts.append((1, str(self.added[piece]), piece))
            elif self.strange([piece]):
                parts.append(self._by_library(piece))
            elif piece:
                n, ids, decoded = self.codes([piece])
                parts.append((n[0], ids[0].as_py(), decoded[0].as_py()))
        parts = [p for p in parts if p[0]]
        return sum(p[0] for p in parts), " ".join(p[1] for p in parts), self.joined([p[2] for p in parts])

    def _by_library(self, text: str) -> tuple[int, str, str]:
        """The same for a text with characters that Python does not know: only its words come from the library."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        data = self.merged([bytes([self.bytes[c] for c in word]) for word, _ in words])
        sizes, shown = self._shown([b"".join(data)])
        return int(sizes[0]), *(x[0].as_py() for x in shown)

    @staticmethod
    def joined(strings: list[str]) -> str:
        # the file names no decoder: its library puts a space between the vocabulary's strings
        return " ".join(strings)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.codes([text])[1][0].as_py().split(" ") if i]

    def decode(self, ids: list[int]) -> str:
        return self.joined([self.strings[i] for i in ids if i in self.strings])


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, tokens: bool = True) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256, decoded_sha256 (and token_ids, decoded).

    Columns of ``docs`` with these names are replaced.
    """
    added = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded")
    keep = [c for c in docs.columns if c not in (text, *added)]
    fields = [f for f in docs.schema.fields if f.name in keep]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or public_tokenizers.path(FILE))
        digest = lambda strings: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in strings], pa.string())
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in bounded([len(t) for t in texts], BLOCK_CHARS):
                counts, ids, decoded = bpe.codes(texts[a:b])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [pa.array(counts, pa.int64()), digest(ids), digest(decoded)]
                if tokens:
                    numbers = pc.split_pattern(ids, " ").flatten()
                    numbers = numbers.filter(pc.not_equal(numbers, "")).cast(pa.int32())
                    bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    columns += [pa.ListArray.from_arrays(bounds, numbers), decoded]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(added if tokens else added[:3])])

    kinds = ["long", "string", "string", "array<int>", "string"]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema += [f"{n} {k}" for n, k in zip(added, kinds, strict=True)][: 5 if tokens else 3]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(encode, ", ".join(schema))


def bpe_query(documents: DataFrame) -> DataFrame:
    return encoded(documents.select("doc_id", "text"), tokens=False)
