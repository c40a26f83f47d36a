"""Language identification by mixtures of languages.

Character trigrams of the labelled texts give one multinomial per language.  A document is a mixture of
languages: expectation-maximisation estimates its proportions, and a penalised likelihood selects how
many languages it needs: sets of the likeliest languages grow until ``PATIENCE`` sizes in a row gain nothing.
The predicted language is the one with the largest share.

Trigrams run over code points of the lower-cased text with everything but letters as one space, hashed
into ``BUCKETS`` cells.  The whole text counts, whatever its length.

Defined results: a null text or one without a letter is ``und`` with score 0; so is any text when there
is nothing to learn from.  Rows with a null label are not learned from, but are predicted.  Repeated
rows count as often as they occur.  Equal shares go to the language that sorts first.  An empty table
gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded

BUCKETS = 1 << 14
MAX_LANGUAGES = 2000
ROUNDS = 12
REFITS = 8
PATIENCE = 2  # sizes in a row without gain that end the search
CELLS = 1 << 24  # numbers of trigrams times languages that are held at once, or those of one text
PENALTY = 3.0
SMOOTHING = 0.05
BLOCK_CHARS = 1 << 20
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


_LETTERS: list[np.ndarray] = []


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, buckets and counts of their trigrams, and which texts have a letter."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f"  {t} " for t in lowered).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t) + 3 for t in lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _LETTERS[0][codes]
    with_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | np.concatenate([[True], letter[:-1]])  # one space for a run of other characters
    keep[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    codes, owner = np.where(letter, codes, np.uint32(0x20))[keep], owner[keep]
    if len(codes) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none, with_letter
    with np.errstate(over="ignore"):
        cell = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
        cell = (cell * np.uint32(0x27D4EB2F)) >> np.uint32(18)
    same = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0x20)
    flat = np.bincount(owner[:-2][same] * BUCKETS + cell[same], minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(flat)
    return at // BUCKETS, at % BUCKETS, flat[at], with_letter


def _blocks(texts: list[str], languages: int = 1) -> Iterator[tuple[int, int]]:
    # a dense count table of one block stays below 64 x BUCKETS cells
    for a, b in bounded([len(t) for t in texts], min(BLOCK_CHARS, CELLS // max(1, languages))):
        for i in range(a, b, 64):
            yield i, min(i + 64, b)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """Trigram counts (lang, bucket, n) of the rows with a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in _blocks(texts):
                docs, cells, n, _ = trigram_counts(texts[a:b])
                of = labels[a:b][docs]
                for name in set(labels[a:b]):
                    mine = of == name
                    sums = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums += np.bincount(cells[mine], n[mine], BUCKETS).astype(np.int64)
        for name, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l"))
    partial = rows.dropna().mapInArrow(count, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """The languages' trigram probabilities and the inference over them."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy()  # bucket x language

    @classmethod
    def of(cls, counts: DataFrame) -> Mixture:
        """Collect the counts: at most MAX_LANGUAGES x BUCKETS cells, whatever the corpus."""
        names = [r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} labels; this is not a language column")
        names = sorted(names)
        table = np.zeros((len(names), BUCKETS))
        got = counts.toArrow()
        where = {name: i for i, name in enumerate(names)}
        rows = np.fromiter((where[x] for x in got.column("lang").to_pylist()), np.int64, got.num_rows)
        table[rows, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        return cls(names, table)

    def _fit(self, p, n, starts, total, shares, rounds):
        """EM for the shares of each document; returns the shares and the log-likelihoods."""
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
        for _ in range(rounds):
            weight = p * shares[owner]
            weight *= (n / weight.sum(axis=1))[:, None]
            shares = np.add.reduceat(weight, starts, axis=0) / total[:, None]
        return shares, np.add.reduceat(n * np.log((p * shares[owner]).sum(axis=1)), starts)

    def infer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages in each text (zero outside the selected set), texts with letters."""
        shares = np.zeros((len(texts), len(self.names)))
        known = np.zeros(len(texts), bool)
        if not self.names:
            return shares, known
        for a, b in _blocks(texts, len(self.names)):
            docs, cells, n, letters = trigram_counts(texts[a:b])
            known[a:b] = letters
            if len(docs):
                present, starts = np.unique(docs, return_index=True)
                shares[a + present] = self._select(self.p[cells], n.astype(float), starts)
        shares[~known] = 0
        return shares, known

    def _select(self, p: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        docs, langs = len(starts), p.shape[1]
        total = np.add.reduceat(n, starts)
        every, _ = self._fit(p, n, starts, total, np.full((docs, langs), 1 / langs), ROUNDS)
        rank = np.argsort(np.argsort(-every, axis=1, kind="stable"), axis=1, kind="stable")
        alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
        first = alone.argmax(axis=1)
        best = np.zeros((docs, langs))
        best[np.arange(docs), first] = 1
        score = alone.max(axis=1) - PENALTY * np.log1p(total)
        open_docs, idle = np.arange(docs), np.zeros(docs, np.int64)
        lengths = np.diff(np.append(starts, len(n)))
        for size in range(2, langs + 1):
            if not len(open_docs):
                break
            rows = np.isin(np.repeat(np.arange(docs), lengths), open_docs)
            begins = np.concatenate([[0], np.cumsum(lengths[open_docs])[:-1]])
            guess = np.where(rank[open_docs] < size, np.maximum(every[open_docs], 1e-6), 0)
            guess /= guess.sum(axis=1, keepdims=True)
            fitted, likely = self._fit(p[rows], n[rows], begins, total[open_docs], guess, REFITS)
            value = likely - PENALTY * size * np.log1p(total[open_docs])
            better = value > score[open_docs]
            best[open_docs[better]], score[open_docs[better]] = fitted[better], value[better]
            idle[open_docs] = np.where(better, 0, idle[open_docs] + 1)
            open_docs = open_docs[idle[open_docs] < PATIENCE]
        return best


def identify(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (share of that language) and lang_shares (language -> share).

    Columns of ``docs`` with these names are replaced, the text is left out.
    """
    names, shared = [*model.names], docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            shares, known = shared.value.infer(texts)
            top = shares.argmax(axis=1) if names else np.zeros(len(texts), int)
            label = [names[i] if k and names else UNDETERMINED for i, k in zip(top, known, strict=True)]
            score = shares.max(axis=1) if names else np.zeros(len(texts))
            held = [[(names[i], float(row[i])) for i in np.flatnonzero(row > 0)] for row in shares]
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(label, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(held, pa.map_(pa.string(), pa.float64()))],
                names=[batch.schema.names[c] for c in kept] + ["lang_pred", "score", "lang_shares"],
            )

    added = ("lang_pred", "score", "lang_shares")
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, *added)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep.columns], F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(predict, f"{schema}{', ' if schema else ''}lang_pred string, score double, lang_shares map<string,double>")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_query(documents: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    docs = documents.select("doc_id", held_out().alias("held_out"), "lang", "text")
    model = Mixture.of(learn(docs.filter(~F.col("held_out"))))
    return identify(docs.drop("lang"), model)
