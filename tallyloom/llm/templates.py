"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose figures or names were exchanged
keeps its template.  Windows of ``SIZE`` template words of documents and benchmark items are hash-joined,
and so are windows of ``SIZE`` plain words in lower case, which letter case cannot change.  An item is found
in a document when the windows that meet in one span cover at least ``COVERED`` of its words (all of them if
they are fewer than ``SHORT``) and the slots agree: within the span the same item value must stand for the
same document value.  A span is one diagonal (place in the document less place in the item), or all those
that are at most a quarter of the item's words, and at least ``NEAR``, above the lowest of them: words that
were put in or left out move what follows to the next diagonals, but windows from other parts of a text do
not add up.

Words are runs of letters or numbers (with inner . and ,); each letter of a script without spaces is a word.
A capitalised word is a name unless it begins a sentence or line, or is all capitals; names in a row are one.
Number words count as numbers, a unit is a known unit word right after a number.  Template windows need
``LITERALS`` words that are not placeholders.  An item's first word is tried both as a word and as a name,
as a document may continue a sentence with it.

Templates alone are judged by the words that an item's template windows can cover.  Where these are fewer
than ``COVERED`` of all its words, only its plain words can find it; plain windows cover any item of
``SIZE`` words or more, so every copy is found.  An item of fewer words is found where all its plain words
stand in a row.

If the benchmark has at most ``LOCAL_WINDOWS`` windows and words (counted), their hashes are sent to the
tasks to drop other windows before the join; a larger benchmark is joined with all windows instead.  Rows
are the same either way.

Defined results: null texts and texts without words meet nothing, and neither do such items.  Rows of the
same id and text are one document; ids may be null.  An empty table on either side gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import MIX_A, MIX_C, U64, bounded, mixed, ranges, slices, text_or_empty, weights, written

SIZE = 5
COVERED = 0.8
SHORT = 2 * SIZE
NEAR = 2
AGREED = 0.6
LITERALS = 2
LOCAL_WINDOWS = 2_000_000
BLOCK_CHARS = 1 << 19
PAIRS = 1 << 20  # pairs of places that are looked at together

# scripts without spaces: Thai to Myanmar, Khmer, kana, Han
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    " seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand"
    " million billion".split()
)
UNITS = frozenset(
    "mm cm m km g kg mg t l ml s ms min h hz khz mhz ghz kb mb gb tb w kw mw v a ohm pa kpa n j kj cal kcal c f k"
    " inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons gram grams kilogram"
    " kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres"
    " second seconds minute minutes hour hours day days week weeks month months year years degree degrees"
    " percent dollar dollars euro euros cent cents mph kmh".split()
)
WORD, NUMBER, UNIT, CAPITAL, STOP = range(5)
TEMPLATE, PLAIN, WHOLE = range(3)  # windows of template words, of plain words, short items as a whole
NUMBER_MARK, UNIT_MARK, NAME_MARK = U64(0x4E554D), U64(0x554E4954), U64(0x4E414D45)


# what a character is: a letter, a letter of a script without spaces, a digit, the end of a sentence
OTHER, LETTER, DIGIT, SINGLE, END = range(5)


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, lower case, and whether it is upper case, other case, and a digit of any kind."""
    n = 0x40000  # no letter or digit comes after it
    known = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(n)]
    alone = regex.compile(f"[{UNSPACED}]")
    kinds = [DIGIT if c.isdecimal() else OTHER if not c.isalnum() else SINGLE if alone.match(c) else LETTER for c in known]
    table = np.zeros(0x110000, np.uint8)
    table[:n] = kinds
    table[[ord(c) for c in ".!?\n"]] = END
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[:n] = [ord(c.lower()[0]) for c in known]
    lower[0x3C2] = 0x3C3  # the letter sigma at the end of a word
    flags = [np.zeros(0x110000, bool) for _ in range(3)]
    for flag, test in zip(flags, (str.isupper, lambda c: c.islower() or c.istitle() and not c.isupper(), str.isdigit), strict=True):
        flag[:n] = [test(c) for c in known]
    return table, lower, *flags


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash (of the lower-cased token) and class of all tokens, by array operations over code points."""
    table, lower, upper, small, digit = characters()
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table[codes]
    # a point or comma between digits belongs to the number
    if len(codes) > 2:
        mark = (codes[1:-1] == 0x2E) | (codes[1:-1] == 0x2C)
        kind[1:-1][mark & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)] = DIGIT
    begins = kind != OTHER
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] >= SINGLE)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int8)
    inside = np.flatnonzero(kind != OTHER)
    first = np.searchsorted(inside, starts)
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    codes = codes[inside]
    value = np.add.reduceat((lower[codes].astype(U64) + U64(1)) * weights(int(sizes.max()))[place], first)
    value = mixed(value + sizes.astype(U64) * MIX_C)
    begin = codes[first]
    capital = upper[begin] & ((sizes == 1) | np.logical_or.reduceat(small[codes], first))
    found = np.where(capital, np.int8(CAPITAL), np.int8(WORD))
    found[member(word_hash(UNITS), value)] = UNIT
    found[(kind[starts] == DIGIT) | digit[begin] | member(word_hash(NUMBER_WORDS), value)] = NUMBER
    found[kind[starts] == END] = STOP
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.searchsorted(bounds, starts, "right"), value, found


@cache
def word_hash(words: frozenset) -> np.ndarray:
    """The sorted hashes of a list of words."""
    codes = [np.array([ord(c) for c in w], U64) for w in words]
    sums = np.array([((c + U64(1)) * weights(len(c))).sum() for c in codes], U64)
    return np.sort(mixed(sums + np.array([len(c) for c in codes], U64) * MIX_C))


class Lexicon:
    """Reads words of texts, and whether they are among ``vocabulary`` (sorted hashes; without it all are)."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, hash, class and membership in the vocabulary of all words."""
        owner, value, kind = tokens(texts)
        listed = np.ones(len(value), bool) if self.vocabulary is None else member(self.vocabulary, value)
        return owner, value, kind, listed


def member(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


class Words(NamedTuple):
    """Words of texts: document, hash, slot value (0 for literal words), place (begin, end), wanted or not."""

    owner: np.ndarray
    mark: np.ndarray
    slot: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    wanted: np.ndarray


def words_of(lexicon: Lexicon, texts: list[str], opened: bool = True) -> tuple[Words, Words]:
    """The template words and the plain words of the texts; places are numbers of plain words.

    Unless ``opened``, the texts are taken to continue a sentence.
    """
    owner, value, kind, listed = lexicon.read(texts)
    opens = np.concatenate([[True], (owner[1:] != owner[:-1]) | (kind[:-1] == STOP)])[: len(owner)]
    after_number = np.concatenate([[False], (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])])[: len(owner)]
    if not opened:
        opens &= np.concatenate([[False], owner[1:] == owner[:-1]])[: len(owner)]
    name = (kind == CAPITAL) & ~opens
    number, unit = kind == NUMBER, (kind == UNIT) & after_number
    mark = np.where(name, NAME_MARK, np.where(number, NUMBER_MARK, np.where(unit, UNIT_MARK, value)))
    slot = np.where(name | number | unit, value | U64(1), U64(0))
    keep = kind != STOP
    owner, value, mark, slot, name, listed = (x[keep] for x in (owner, value, mark, slot, name, listed))
    n = len(owner)
    place = np.arange(n) - np.searchsorted(owner, owner)
    plain = Words(owner, value, np.zeros(n, U64), place, place + 1, listed)
    if not n:
        return plain, plain
    # a run of names is one name whose value is the sum of theirs
    goes_on = np.concatenate([[False], name[1:] & name[:-1] & (owner[1:] == owner[:-1])])
    starts = np.flatnonzero(~goes_on)
    ends = place[np.append(starts[1:], n) - 1] + 1
    template = Words(
        owner[starts], mark[starts], np.add.reduceat(slot, starts), place[starts], ends, (listed | (slot != 0))[starts]
    )
    return template, plain


def windows(words: Words, form: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``words`` and hash of the windows of ``size`` words, without those that have an unwanted word."""
    n = len(words.owner) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    whole = words.owner[:n] == words.owner[size - 1 :]
    if not words.wanted.all():
        missing = np.concatenate([[0], np.cumsum(~words.wanted)])
        whole &= missing[size:] == missing[:-size]
    if form == TEMPLATE:
        literal = np.concatenate([[0], np.cumsum(words.slot == 0)])
        whole &= literal[size:] - literal[:-size] >= LITERALS
    at = np.flatnonzero(whole)
    h = np.full(len(at), U64(form * 64 + size), U64)
    for j in range(size):
        h = mixed(h + MIX_A) ^ words.mark[at + j] * MIX_C
    return at, mixed(h)


def short_lengths(sizes: Iterable[int]) -> list[int]:
    return sorted({n for n in sizes if 0 < n < SIZE})


# one row per document and hash: all its places there, with SIZE slot values each for template windows
SCHEMA = "key long, id long, h long, at array<int>, begin array<int>, end array<int>, slots array<long>"


def document_windows(docs: DataFrame, text: str, key: str, lengths: list[int], wanted: tuple | None) -> DataFrame:
    """Windows of the documents, and runs of as many words as short items have.

    ``wanted``, if given, are the hashes of the items' words and windows; others are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value[0] if shared is not None else None)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            for a, b in bounded([len(t) for t in texts], BLOCK_CHARS):
                template, plain = words_of(lexicon, texts[a:b])
                for form, size in ((TEMPLATE, SIZE), (PLAIN, SIZE), *((WHOLE, n) for n in lengths)):
                    words = template if form == TEMPLATE else plain
                    at, h = windows(words, form, size)
                    if shared is not None:
                        met = member(shared.value[1], h)
                        at, h = at[met], h[met]
                    of = words.owner[at]
                    order = np.lexsort((at, h, of))
                    at, h, of = at[order], h[order], of[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
                    if form == WHOLE:
                        # one place of a short item in a document is enough
                        at, h, of, new = at[new], h[new], of[new], new[new]
                    first = at - np.searchsorted(words.owner, of)
                    starts = np.append(np.flatnonzero(new), len(at)).astype(np.int32)
                    slots = np.stack([words.slot[at + j] for j in range(SIZE)], axis=1) if form == TEMPLATE else np.zeros((len(at), 0), U64)
                    rows = pa.array(of[new] + a)
                    lists = ((starts, first), (starts, words.begin[at]), (starts, words.end[at + size - 1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.array(h[new].view(np.int64)),
                            *(pa.ListArray.from_arrays(pa.array(o), pa.array(v.astype(np.int32))) for o, v in lists),
                            pa.ListArray.from_arrays(pa.array(starts * slots.shape[1], pa.int32()), pa.array(slots.ravel().view(np.int64))),
                        ],
                        names=["key", "id", "h", "at", "begin", "end", "slots"],
                    )

    rows = docs.select(row_key(text, key).alias("key"), F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.filter("t <> ''").mapInArrow(cut, SCHEMA)


def row_key(text: str = "text", key: str = "doc_id"):
    """One number for the id and text of a row, whether or not they are null."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), text_or_empty(text))


INDEX = (
    "item_key long, item long, words int, coverable int, form int, h long, span int,"
    " item_at array<int>, item_begin array<int>, item_end array<int>, item_slots array<long>"
)


def item_rows(lexicon: Lexicon, body: str) -> tuple[int, int, list[tuple]]:
    """Words of an item, how many of them its template windows cover, and its windows.

    A window is a hash with all places it has in the item; its span is the sum of their words.
    """
    template, plain = words_of(lexicon, [body])
    n, places, covered = len(plain.owner), {}, set()
    if 0 < n < SIZE:
        _, h = windows(plain, WHOLE, n)
        return n, 0, [(WHOLE, int(h.view(np.int64)[0]), n, [0], [0], [n], [])]

    def add(words: Words, form: int, only_first: bool = False) -> None:
        at, h = windows(words, form)
        for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            if only_first and i:
                break
            begin, end = int(words.begin[i]), int(words.end[i + SIZE - 1])
            slots = words.slot[i : i + SIZE].view(np.int64).tolist() if form == TEMPLATE else []
            row = places.setdefault((form, x), (form, x, [], [], [], []))
            for values, new in zip(row[2:], ([i], [begin], [end], slots), strict=True):
                values += new
            if form == TEMPLATE:
                covered.update(range(begin, end))

    add(plain, PLAIN)
    add(template, TEMPLATE)
    if len(template.slot) and template.slot[0] == 0:
        # the first word as a name, alone and with the names that follow it
        mark, slot = template.mark.copy(), template.slot.copy()
        mark[0], slot[0] = NAME_MARK, mark[0] | U64(1)
        add(template._replace(mark=mark, slot=slot), TEMPLATE, True)
        inside, _ = words_of(lexicon, [body], opened=False)
        if len(inside.mark) < len(template.mark):
            add(inside, TEMPLATE, True)
    return n, len(covered), [(form, x, sum(e) - sum(b), at, b, e, slots) for form, x, at, b, e, slots in places.values()]


def item_windows(items: DataFrame, text: str, key: str) -> DataFrame:
    """Windows of the benchmark's items, with the items' number of words and of words that templates cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            for own, item, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, coverable, rows = item_rows(lexicon, body)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()))
                same = [pa.array([v] * len(rows), t) for v, t in ((own, pa.int64()), (item, pa.int64()), (n, pa.int32()), (coverable, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    same + [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                    names=["item_key", "item", "words", "coverable", "form", "h", "span", "item_at", "item_begin", "item_end", "item_slots"],
                )

    rows = items.select(row_key(text, key).alias("k"), F.col(key).cast("long").alias("i"), text_or_empty(text).alias("t"))
    return rows.distinct().mapInArrow(cut, INDEX)


def item_words(items: DataFrame, text: str) -> DataFrame:
    """Hashes of the distinct plain words of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            _, plain = words_of(lexicon, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(plain.mark).view(np.int64))], names=["w"])

    return items.select(text_or_empty(text).alias("t")).mapInArrow(cut, "w long").distinct()


def sent(column: DataFrame) -> np.ndarray:
    return np.sort(column.toArrow().column(0).to_numpy().view(U64))


def needed(words: str) -> Column:
    """How many of so many words must be covered."""
    return F.when(F.col("words") < SHORT, F.col(words)).otherwise(F.col(words) * COVERED)


def usable() -> Column:
    """Whether template windows alone can find the item."""
    return (F.col("coverable") > 0) & (F.col("coverable") >= F.col("words") * COVERED)


def agreement(item: np.ndarray, own: np.ndarray) -> float:
    """The share of slot values that stand for the value that their item value mostly stands for."""
    both = (item != 0) & (own != 0)
    if not both.any():
        return 1.0
    pairs, n = np.unique(np.stack([item[both], own[both]], axis=1), axis=0, return_counts=True)
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
    return float(np.maximum.reduceat(n, starts).sum() / n.sum())


class Lists(NamedTuple):
    """A column of lists: where each begins, and all values."""

    starts: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Lists:
        starts = column.offsets.to_numpy().astype(np.int64)
        return cls(starts - starts[0], column.flatten().to_numpy(zero_copy_only=False))


class Hits:
    """The windows that documents share with items: one row per window, with its places on both sides."""

    def __init__(self, rows: pa.StructArray):
        names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
        field = lambda name: rows.field(names.index(name))
        self.form = field("form").to_numpy()
        self.h = field("h").to_numpy()
        self.own = {c: Lists.of(field(c)) for c in ("at", "begin", "end", "slots")}
        self.item = {c: Lists.of(field(f"item_{c}")) for c in ("at", "begin", "end", "slots")}

    def pairs(self, rows: np.ndarray, coordinate: str, low: int | None = None, high: int | None = None) -> tuple:
        """All pairs of a document's and an item's place (row, own place, item's place), as indices.

        ``low`` and ``high`` bound the document's places.
        """
        starts = self.own["at"].starts
        count = starts[rows + 1] - starts[rows]
        own, row = ranges(starts[rows], count), np.repeat(rows, count)
        if low is not None:
            place = self.own[coordinate].values[own]
            inside = (place >= low) & (place < high)
            own, row = own[inside], row[inside]
        first = self.item["at"].starts
        many = first[row + 1] - first[row]
        return np.repeat(row, many), np.repeat(own, many), ranges(first[row], many)

    def slots(self, side: dict, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The slot values of template windows, SIZE for each."""
        at = side["slots"].starts[row] + (place - side["at"].starts[row]) * SIZE
        return side["slots"].values[at[:, None] + np.arange(SIZE)]


def best_span(hits: Hits, rows: np.ndarray, words: int, of: int, coordinate: str) -> tuple | None:
    """Similarity, agreement, first and last word of the best span of one document and item, if one suffices.

    ``of`` is the number of words that can be covered; diagonals count places by ``coordinate``.  Places
    are taken by stretches of the document, so a document of any length needs bounded memory.
    """
    starts, first = hits.own["at"].starts, hits.item["at"].starts
    size = int(((starts[rows + 1] - starts[rows]) * (first[rows + 1] - first[rows])).sum())
    reach, best = max(NEAR, words // 4), None
    if size <= PAIRS:
        stretches = [(None, None)]
    else:
        last = max(int(hits.own[coordinate].values[starts[r] : starts[r + 1]].max()) for r in rows)
        step = max(words, (last + words) * PAIRS // size)
        stretches = [(low, low + step) for low in range(-words, last + 1, step)]
    for low, high in stretches:
        # a span that begins on a diagonal in [low, high) has no place after high + reach + words
        found = hits.pairs(rows, coordinate, low, None if high is None else high + reach + words)
        best = max(best or (), _best(hits, *found, words, of, coordinate, reach, low, high) or ()) or None
    return best and (best[0], best[1], -best[2], best[3])


def _best(hits: Hits, row, own, item, words: int, of: int, coordinate: str, reach: int, low, high) -> tuple | None:
    need = of if words < SHORT else of * COVERED
    diagonal = hits.own[coordinate].values[own].astype(np.int64) - hits.item[coordinate].values[item]
    order = np.argsort(diagonal, kind="stable")
    row, own, item, diagonal = row[order], own[order], item[order], diagonal[order]
    begin, end = hits.item["begin"].values[item], hits.item["end"].values[item]
    total = np.concatenate([[0], np.cumsum(end - begin)])
    start = np.flatnonzero(np.concatenate([[True], diagonal[1:] != diagonal[:-1]])) if len(diagonal) else np.zeros(0, np.int64)
    here = np.searchsorted(diagonal, diagonal[start], "right")
    far = np.searchsorted(diagonal, diagonal[start] + reach, "right")
    hopeful = total[far] - total[start] >= need
    if low is not None:
        hopeful &= (diagonal[start] >= low) & (diagonal[start] < high)
    best = None
    for a, *stops in zip(start[hopeful].tolist(), here[hopeful].tolist(), far[hopeful].tolist(), strict=True):
        for b in sorted(set(stops)):
            if total[b] - total[a] < need:
                continue
            change = np.zeros(words + 1, np.int64)
            np.add.at(change, begin[a:b], 1)
            np.add.at(change, end[a:b], -1)
            n = int((np.cumsum(change) > 0).sum())
            if n < need:
                continue
            slotted = np.flatnonzero(hits.form[row[a:b]] == TEMPLATE) + a
            agreed = agreement(
                hits.slots(hits.item, row[slotted], item[slotted]).ravel(), hits.slots(hits.own, row[slotted], own[slotted]).ravel()
            )
            if agreed >= AGREED:
                got = (n / of, agreed, -int(hits.own["begin"].values[own[a:b]].min()), int(hits.own["end"].values[own[a:b]].max()) - 1)
                best = got if best is None else max(best, got)
    return best


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best span of each document and item."""
    names = ["key", "item_key", "id", "item", "similarity", "agreed", "first", "last"]
    for batch in batches:
        out, column = [], {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        hits = Hits(column["hits"].flatten())
        bounds = Lists.of(column["hits"]).starts
        plain = [column[c].to_pylist() for c in ("key", "item_key", "id", "item", "words", "coverable")]
        for n, (*names_of, words, coverable) in enumerate(zip(*plain, strict=True)):
            rows = np.arange(bounds[n], bounds[n + 1])
            template = hits.form[rows] == TEMPLATE
            views = [(rows, words, "begin"), (rows[~template], words, "begin")]
            if coverable > 0 and coverable >= words * COVERED:
                views.append((rows[template], coverable, "at"))
            found = [best_span(hits, which, words, of, by) for which, of, by in views if len(which)]
            found = [f for f in found if f]
            if found:
                out.append((*names_of, *max(found, key=lambda f: (f[0], f[1], -f[2], f[3]))))
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs of a document and an item found in it: key, doc_id, item_id, similarity, agreed, first, last.

    ``similarity`` is the share of the item's words that the best span covers, ``agreed`` the share of slot
    values that are consistent; first and last are the (plain) words of the document that take part.
    """
    index = written(item_windows(items, "text", "item_id"), "templates")
    lengths = short_lengths(r[0] for r in index.filter(F.col("form") == WHOLE).select("words").distinct().collect())
    hashes = index.select("h").distinct()
    wanted = None
    if hashes.count() <= LOCAL_WINDOWS:
        vocabulary = written(item_words(items, "text"), "template-words")
        if vocabulary.count() <= LOCAL_WINDOWS:
            wanted = (sent(vocabulary), sent(hashes))
    cut = document_windows(docs, text, key, lengths, wanted)
    met = cut.join(index, "h").dropDuplicates(["key", "item_key", "h"])
    hit = F.struct("form", "h", *[p + c for p in ("", "item_") for c in ("at", "begin", "end", "slots")])
    template = F.when(F.col("form") == TEMPLATE, F.col("span"))
    groups = met.groupBy("key", "item_key", "id", "item", "words", "coverable").agg(
        F.collect_list(hit).alias("hits"), F.sum("span").alias("by_any"), F.coalesce(F.sum(template), F.lit(0)).alias("by_template")
    )
    # a span covers no more than all windows together
    enough = (F.col("by_any") >= needed("words")) | (usable() & (F.col("by_template") >= needed("coverable")))
    pairs = groups.filter(enough).drop("by_any", "by_template")
    rows = pairs.mapInArrow(judged, "key long, item_key long, id long, item long, similarity double, agreed double, first int, last int")
    return rows.select("key", F.col("id").alias(key), F.col("item").alias("item_id"), "similarity", "agreed", "first", "last")


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns."""
    bad = contaminated(docs, items, text, key).select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, row_key(text, key) == F.col("__bad"), "left_anti")


def leak_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(documents.select("doc_id", "text"), benchmark).drop("key")
