"""Quality by weak supervision: rules vote or abstain, and their votes are weighed by estimated accuracy.

No rule decides alone.  Each says good (1), bad (-1) or abstains (0).  Expectation-maximisation over the
votes of all documents estimates how often each rule is right without any label, and a document is kept
when its posterior probability of being good reaches ``KEEP_FROM``.

Words are maximal runs without space or \\x09-\\x0D.  Everything is computed by Spark expressions from
whole texts; the documents are summed up as counts per vote pattern (at most 3 ** rules rows).

Defined results: a null text counts as empty: no words, all counts 0, base_failed, not kept.  Repeated
rows give repeated rows.  An empty table gives an empty table.  A posterior equal to ``KEEP_FROM`` keeps.
Columns of the input that share a name with an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty, written

ROUNDS = 30
# vote: its probability for a good and for a bad document before any estimate
START = {1: (0.97, 0.8), 0: (0.025, 0.05), -1: (0.005, 0.15)}
PRIOR_GOOD = 0.8
PRIOR_WEIGHT = 0.25  # of START, as a share of the documents
KEEP_FROM = 0.05  # a single bad vote is not enough
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_closed")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules read."""
    spare = [c for c in docs.columns if c not in (*COUNTS, "__t", "__w", "__l", "__h")]
    step = docs.select(*[F.col(f"`{c}`") for c in spare], text_or_empty(text).alias("__t"))
    step = step.withColumns(
        {
            "__w": F.expr(r"array_remove(split(__t, '[ \\t\\n\\x0B\\f\\r]+'), '')"),
            "__l": F.expr(r"filter(split(__t, '\n'), x -> x rlike '[^ \\t\\n\\x0B\\f\\r]')"),
        }
    )
    step = step.withColumn(
        "__h",
        F.expr(
            "transform(slice(__w, 1, greatest(size(__w) - 2, 0)),"
            " (w, i) -> xxhash64(w, __w[i + 1], __w[i + 2]))"
        ),
    )
    # the low bits of a key hold the position, the others the hash of the window that starts there
    step = step.withColumn("__b", F.length(F.bin(F.size("__h"))))
    step = step.withColumn(
        "__k",
        F.expr(
            "CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h,"
            " (h, i) -> shiftleft(shiftright(h, __b), __b) + i)) ELSE cast(array() AS array<bigint>) END"
        ),
    )
    same = (
        "(shiftright(k, __b) = shiftright(get(__k, {j}), __b)"
        " AND get(__h, cast(k & (shiftleft(1L, __b) - 1) AS int))"
        " = get(__h, cast(get(__k, {j}) & (shiftleft(1L, __b) - 1) AS int)))"
    )
    step = step.withColumn(
        "__p",
        F.expr(
            f"sort_array(transform(filter(__k, (k, i) -> coalesce({same.format(j='i - 1')}, false)"
            f" OR coalesce({same.format(j='i + 1')}, false)), k -> k & (shiftleft(1L, __b) - 1)))"
        ),
    )
    counted = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.expr(
            "aggregate(transform(__p, (p, i) -> CASE WHEN i = 0 THEN 3L ELSE least(3L, p - __p[i - 1]) END),"
            " 0L, (a, x) -> a + x)"
        ),
        "n_lines": F.size("__l"),
        "n_upper": F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")),
        "n_digits": F.length(F.regexp_replace("__t", r"[^0-9]+", "")),
        "n_letters": F.length(F.regexp_replace("__t", r"[^\p{L}\p{M}]+", "")),
        "n_closed": F.size(F.filter("__l", lambda x: x.rlike("[.!?:;\"'’”)][ \\t\\x0B\\f\\r]*$"))),
    }
    return step.select(*[F.col(f"`{c}`") for c in spare], *[v.cast("long").alias(k) for k, v in counted.items()])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name: -1 bad, 0 abstains, 1 good."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "enough_words": _vote(n < 20, n >= 50),
        "few_symbols": _vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "few_repeats": _vote(100 * F.col("n_repeat_words") > 50 * n, 100 * F.col("n_repeat_words") <= 20 * n),
        "own_lines": _vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "word_length": _vote((chars > 12 * n) | (2 * chars < 5 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "mostly_lower": _vote(5 * F.col("n_upper") > chars, 10 * F.col("n_upper") <= chars),
        "few_digits": _vote(5 * F.col("n_digits") > chars, 20 * F.col("n_digits") <= chars),
        "mostly_letters": _vote(10 * F.col("n_letters") < 9 * chars, 100 * F.col("n_letters") >= 93 * chars),
        "closed_lines": _vote(5 * F.col("n_closed") < F.col("n_lines"), 2 * F.col("n_closed") >= F.col("n_lines")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class VoteModel:
    """The share of good documents, and how often each rule says what about good and about bad ones.

    ``says[rule][vote]`` holds the probabilities of the vote for a good and for a bad document.  A rule's
    accuracy on a class is the probability of its right vote among the votes it casts there.
    """

    def __init__(self, prior: float, says: dict[str, dict[int, tuple[float, float]]]):
        self.prior, self.says = prior, says

    @classmethod
    def start(cls) -> VoteModel:
        return cls(PRIOR_GOOD, {name: dict(START) for name in rules()})

    @classmethod
    def fit(cls, counted: DataFrame) -> VoteModel:
        """Estimate from ``features`` output; only counts per vote pattern reach the driver."""
        names = list(rules())
        rows = counted.select(*[v.alias(k) for k, v in rules().items()]).groupBy(*names).count().collect()
        patterns = sorted((tuple(r[k] for k in names), r["count"]) for r in rows)
        total, model = sum(c for _, c in patterns), cls.start()
        for _ in range(ROUNDS if total else 0):
            good = 0.0
            # the start counts as further documents of either class: rules stay better than chance
            weight = PRIOR_WEIGHT * total
            mass = [{v: [weight * x for x in START[v]] for v in START} for _ in names]
            for votes, count in patterns:
                p = model.of(votes)
                good += p * count
                for held, v in zip(mass, votes, strict=True):
                    held[v][0] += count * p
                    held[v][1] += count * (1 - p)
            sums = (good + weight, total - good + weight)
            model = cls(
                (good + weight * PRIOR_GOOD) / (total + weight),
                {
                    name: {v: (held[v][0] / sums[0], held[v][1] / sums[1]) for v in START}
                    for name, held in zip(names, mass, strict=True)
                },
            )
        return model

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """For each rule, how often its votes are right on good and on bad documents."""
        return {
            k: (s[1][0] / (s[1][0] + s[-1][0]), s[-1][1] / (s[1][1] + s[-1][1])) for k, s in self.says.items()
        }

    def _weight(self, name: str, vote: int) -> float:
        # an abstention is no evidence
        return math.log(self.says[name][vote][0] / self.says[name][vote][1]) if vote else 0.0

    def of(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        odds += sum(self._weight(name, v) for name, v in zip(self.says, votes, strict=True))
        return 1 / (1 + math.exp(-odds))

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in rules().items():
            odds = odds + F.when(vote > 0, self._weight(name, 1)).when(vote < 0, self._weight(name, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def judged(counted: DataFrame, model: VoteModel) -> DataFrame:
    """``features`` output with base_failed, probability and kept."""
    return counted.withColumns({"base_failed": base_failed(), "probability": model.posterior()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_FROM)
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the votes keep, with their columns."""
    # the row travels as one column, since features() replaces columns named like its counts
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    # written once: the model reads all votes before any document can be judged
    counted = written(features(rows, "__text").drop("__text"), "quality")
    verdict = judged(counted, VoteModel.fit(counted))
    return verdict.filter("kept").select(*[F.col(f"__row.`{c}`") for c in docs.columns])


def quality_query(documents: DataFrame) -> DataFrame:
    counted = written(features(documents.select("doc_id", "text")).drop("text"), "quality")
    kept = judged(counted, VoteModel.fit(counted))
    return kept.select("doc_id", *COUNTS[:5], "base_failed", "kept", "probability")
