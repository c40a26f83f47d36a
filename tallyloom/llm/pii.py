"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap: everything of the form of an email address,
an ip address, a card number or a phone number, whether or not its digits are valid, obfuscated email
addresses, other long numbers, and long strings of letters and digits.  Boosted trees score each
candidate by its format and by the words before it.  A threshold per kind, calibrated on candidates that
the trees did not learn from, selects the spans that are redacted.  Of the kinds ``BASE_KINDS`` the contract's
rules decide; of all other kinds the calibrated score alone does.

All documents are summed up as counts per distinct feature vector.  The trees learn from at most ``VECTORS``
of these, the most frequent; the thresholds rest on all candidates that were held out.  The labels come from
proofs that the trees do not see: check digits, and names such as "password=" before a string.  As the words
before a candidate tell some of that, every vector is learned twice, once with its context held out: on that
copy the trees can only judge the format, and learn which formats are those of proven secrets.  A candidate's
score is the higher of the two, so a key without a name before it is found by its form.

Estimates from few candidates lean on priors, so no count switches a kind on or off.  A score is the mean of
the trees' judgement, weighed by the candidates of the kind that they learned from, and of the proof, weighed
by ``PRIOR``.  The precision at a score is estimated per kind with ``PRIOR`` candidates of the precision that all
kinds together have there.

Everything is Spark expressions in one pass per use of the texts: spans stay inside their row, the
trees become an expression, and no text is shuffled.  Positions count code points, from 0, end exclusive.

Defined results: a null text counts as empty and has no span; it stays null when texts are redacted.
Repeated rows give repeated rows, whatever their ids.  An empty table, or one without candidates, gives
no method spans.  Where all candidates are proven or none is, there is nothing to learn, and the proof is the score.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_or_empty, written

VECTORS = 20_000
TREES, DEPTH = 8, 3
PRECISION = 0.9  # wanted on the calibration candidates
LIKELY = 0.5  # no lower score selects, however precise
PRIOR = 4.0  # candidates that a proof stands for in a score, and that the other kinds stand for in a precision
TRUST = 20.0  # right candidates that stand for the proofs' precision before any are seen
HIDDEN = -1  # a context feature that is held out
CONTEXT = 24

BASE_KINDS = ("email", "ip", "card", "phone")
# kind: pattern and a cheap test without which a text has no match.  Possessive quantifiers and the starts
# (not after a character of the run, or right after the last match) keep the search linear.
GENERATORS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit AND instr(t, '.') > 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "digit"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "digit AND instr(t, '+') > 0"),
    ("mail", r"[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]++)++", "t rlike '[(\\\\[{]at[)\\\\]}]'"),
    ("number", r"(?<![0-9A-Za-z])[0-9](?:[ ()./-]{0,2}+[0-9]){6,}+", "digit"),
    ("secret", r"(?<![\p{L}0-9_])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}+", "digit"),
)
CUES = {
    "mail": "mail|write|contact",
    "call": "phone|tel|call|fax|mobile",
    "pay": "card|visa|credit|account|iban",
    "net": "ip|host|server|addr",
    "key": "pass(?:word|wd)?|pwd|token|secret|key|auth",
}
FEATURES = (
    "kind_no", "size", "digits", "upper", "lower", "dots", "dashes", "blanks", "brackets", "groups", "longest",
    *(f"cue_{c}" for c in CUES), "assigned", "quoted", "after_word",
)


CONTEXT_FEATURES = (*(f"cue_{c}" for c in CUES), "assigned", "quoted", "after_word")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: str, pattern: str, guard: str) -> str:
    """An array of (kind, s, e, m, left) of the pattern's matches in t."""
    p = _quoted(pattern)
    return f"""CASE WHEN {guard} THEN aggregate(
        zip_with(split(t, {p}), regexp_extract_all(t, {p}, 0), (g, m) -> named_struct('g', length(g), 'l', right(g, {CONTEXT}), 'm', m)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<kind:string,s:int,e:int,m:string,left:string>>)),
        (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct('at', a.at + x.g + length(x.m), 'out',
            concat(a.out, array(named_struct('kind', '{kind}', 's', a.at + x.g, 'e', a.at + x.g + length(x.m), 'm', x.m, 'left', x.l)))) END,
        a -> a.out) ELSE cast(array() AS array<struct<kind:string,s:int,e:int,m:string,left:string>>) END"""


def _luhn(digits: str) -> str:
    one = f"substring({digits}, length({digits}) + 1 - i, 1)"
    doubled = f"translate({one}, '0123456789', '0246813579')"  # sum of the digits of twice the digit
    each = f"cast(CASE WHEN i % 2 = 1 THEN {one} ELSE {doubled} END AS int)"
    return f"(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + {each}) % 10 = 0)"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__c``: candidates (kind, s, e, valid, f), f being the feature values."""
    step = docs.withColumn("t", text_or_empty(text)).withColumn("digit", F.col("t").rlike("[0-9]"))
    # single digits are no candidates, whichever generator met them
    step = step.withColumn("__m", F.expr("concat(" + ", ".join(_found(*g) for g in GENERATORS) + ")"))
    plain = "regexp_replace(c.m, '[^0-9]+', '')"
    step = step.withColumn(
        "__d", F.expr(f"transform(filter(__m, c -> c.kind <> 'card' OR length(c.m) >= 7), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'm', c.m, 'left', c.left, 'd', {plain}))")
    )
    n = "length(c.d)"
    octets = "forall(split(c.m, '[.]'), x -> x rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$')"
    card = f"(CASE WHEN {n} BETWEEN 12 AND 19 THEN {_luhn('c.d')} ELSE false END)"
    named = f"c.left rlike '(?i)(?:{CUES['key']})[\\\\x20]*[=:][\\\\x20]*\\\"?$'"
    valid = f"""CASE c.kind WHEN 'email' THEN true WHEN 'ip' THEN {octets} WHEN 'card' THEN {card}
        WHEN 'phone' THEN {n} BETWEEN 9 AND 15 WHEN 'mail' THEN true WHEN 'number' THEN {card}
        ELSE c.m rlike '^AKIA[0-9A-Z]{{16}}$' OR {named} END"""
    # numbers of random characters vary from key to key, so only their order of size counts
    level = lambda x: f"(CASE WHEN {x} = 0 THEN 0 WHEN {x} < 4 THEN 1 WHEN {x} < 9 THEN 2 ELSE 3 END)"
    count = lambda chars: level(f"length(regexp_replace(c.m, '[^{chars}]+', ''))")
    order = "CASE c.kind " + " ".join(f"WHEN '{g[0]}' THEN {i}" for i, g in enumerate(GENERATORS)) + " END"
    values = {
        "kind_no": order,
        "size": "least(48, length(c.m))",
        "digits": level(n),
        "upper": count("A-Z"),
        "lower": count("a-z"),
        "dots": "least(4, length(regexp_replace(c.m, '[^.]+', '')))",
        "dashes": "least(4, length(regexp_replace(c.m, '[^-]+', '')))",
        "blanks": "least(4, length(regexp_replace(c.m, '[^ ]+', '')))",
        "brackets": "least(2, length(regexp_replace(c.m, '[^()]+', '')))",
        "groups": "least(8, size(split(c.m, '[^A-Za-z0-9]+')))",
        "longest": level("array_max(transform(split(c.m, '[^0-9]+'), x -> length(x)))"),
        **{f"cue_{k}": f"cast(c.left rlike '(?i){p}' AS int)" for k, p in CUES.items()},
        "assigned": "cast(c.left rlike '[=:] ?\\\"?$' AS int)",
        "quoted": "cast(c.left rlike '\\\"$' AS int)",
        "after_word": "cast(c.left rlike '(?:^|[ \\\\n])$' AS int)",
    }
    struct = ", ".join(f"'{k}', cast({v} AS int)" for k, v in values.items())
    made = f"transform(__d, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'valid', {valid}, 'f', named_struct({struct})))"
    return step.withColumn("__c", F.expr(made)).drop("digit", "__m", "__d")


# -- the trees ------------------------------------------------------------------------------------


def _tree(node, hidden: bool) -> str:
    """A regression tree as an expression over the features ``c.f``, the context's perhaps held out."""
    if node.numDescendants() == 0:
        return repr(node.prediction())
    split = node.split()
    name = FEATURES[split.featureIndex()]
    if hidden and name in CONTEXT_FEATURES:
        return _tree(node.leftChild() if split.threshold() >= HIDDEN else node.rightChild(), hidden)
    return f"CASE WHEN c.f.{name} <= {split.threshold()!r} THEN {_tree(node.leftChild(), hidden)} ELSE {_tree(node.rightChild(), hidden)} END"


def as_expression(model: GBTClassificationModel) -> str:
    """The probability of a candidate ``c``: the higher one of those with and without its context."""
    margins = [
        " + ".join(f"({weight!r} * ({_tree(tree._java_obj.rootNode(), hidden)}))" for tree, weight in zip(model.trees, model.treeWeights, strict=True))
        for hidden in (False, True)
    ]
    return f"1 / (1 + exp(-2 * greatest({margins[0]}, {margins[1]})))"


def limits(bins: list[tuple[str, float, float, float]]) -> dict[str, float]:
    """The lowest score per kind from which on enough candidates are right, half way to the next score below.

    ``bins`` are kind, score, number of candidates and of right ones; scores that a kind has none at count too.
    """
    scores = sorted({b[1] for b in bins} | {0.0})
    found, sums, total, right = {}, {g[0]: (0.0, 0.0) for g in GENERATORS}, 0.0, 0.0
    for p in sorted({b[1] for b in bins if b[1] >= LIKELY} or {LIKELY}, reverse=True):
        for kind, _, n, good in (b for b in bins if b[1] == p):
            sums[kind] = (sums[kind][0] + n, sums[kind][1] + good)
            total, right = total + n, right + good
        shared = (right + TRUST) / (total + TRUST)
        for kind, (n, good) in sums.items():
            if (good + PRIOR * shared) / (n + PRIOR) >= PRECISION:
                below = max((s for s in scores if s < p), default=0.0)
                found[kind] = max(LIKELY, (p + below) / 2)
    return found


class Redactor:
    """Boosted trees and thresholds; without trees a proof is the score."""

    def __init__(self, score: str = "CASE WHEN c.valid THEN 1.0D ELSE 0.0D END", thresholds: dict[str, float] | None = None):
        self.score = score
        self.thresholds = {g[0]: 0.5 for g in GENERATORS} if thresholds is None else thresholds

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> Redactor:
        found = candidates(docs.select(F.col(f"`{text}`")), text).select(F.explode("__c").alias("c"))
        # the fold follows from the span's place, so that either fold has all forms
        fold = F.pmod(F.xxhash64("c.s", "c.e", "c.kind"), F.lit(4)) == 0
        vectors = found.groupBy("c.kind", "c.f", F.col("c.valid").cast("double").alias("label"), fold.alias("held")).count()
        vectors = written(vectors.select("kind", "f", "label", "held", "count"), "pii-vectors")
        # of equally frequent vectors, those of any kind have the same chance
        most = vectors.filter("NOT held").orderBy(F.desc("count"), F.xxhash64("f", "label"), "f", "label").limit(VECTORS)
        copies = [
            most.select(
                "label",
                F.col("count").cast("double").alias("w"),
                *[(F.lit(HIDDEN) if hidden and x in CONTEXT_FEATURES else F.col(f"f.{x}")).cast("double").alias(x) for x in FEATURES],
            )
            for hidden in (False, True)
        ]
        learn = copies[0].union(copies[1])
        seen = {r[0] for r in learn.select("label").distinct().collect()}
        if len(seen) < 2:
            return cls()
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(learn)
        trees = GBTClassifier(
            featuresCol="x", labelCol="label", weightCol="w", maxIter=TREES, maxDepth=DEPTH, stepSize=0.5, seed=7, minInstancesPerNode=1
        ).fit(rows.coalesce(1))
        # a kind learned from few candidates leans on the proof
        learned = {r["kind"]: float(r["n"]) for r in vectors.filter("NOT held").groupBy("kind").agg(F.sum("count").alias("n")).collect()}
        weight = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {n!r}D" for k, n in sorted(learned.items())) + " ELSE 0.0D END"
        proof = f"{PRIOR!r}D * CASE WHEN c.valid THEN 1 ELSE 0 END"
        score = f"(({weight}) * ({as_expression(trees)}) + {proof}) / (({weight}) + {PRIOR!r}D)"
        held = vectors.filter("held").select("kind", "label", "count", F.struct("kind", "f", (F.col("label") > 0).alias("valid")).alias("c"))
        scored = held.withColumn("p", F.round(F.expr(score), 4)).groupBy("kind", "p").agg(
            F.sum("count").alias("n"), F.sum(F.col("label") * F.col("count")).alias("good")
        )
        # a row per kind and rounded score
        return cls(score, limits([(r["kind"], r["p"], float(r["n"]), float(r["good"])) for r in scored.collect()]))

    def selected(self) -> Column:
        """All spans of ``__c`` as (s, no, e, kind, base), sorted: the base kinds' by rule, the others by score."""
        order = "CASE c.kind " + " ".join(f"WHEN '{g[0]}' THEN {i}" for i, g in enumerate(GENERATORS)) + " END"
        base = f"(c.valid AND c.kind IN ({', '.join(map(repr, BASE_KINDS))}))"
        least = {k: v for k, v in self.thresholds.items() if k not in BASE_KINDS}
        chosen = base
        if least:
            bounds = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in least.items()) + " END"
            chosen = f"({base} OR (c.kind IN ({', '.join(map(repr, least))}) AND round({self.score}, 4) >= {bounds}))"
        spans = f"transform(filter(__c, c -> {chosen}), c -> named_struct('s', c.s, 'no', {order}, 'e', c.e, 'kind', c.kind, 'base', {base}))"
        return F.expr(f"array_sort({spans})")


def spans(docs: DataFrame, model: Redactor, text: str = "text") -> DataFrame:
    """``docs`` with t (the text) and ``spans`` (s, no, e, kind, base), sorted.

    A method span of the same place as a base span is the same span, and is left out.
    """
    rows = candidates(docs, text).withColumn("__s", model.selected())
    places = F.expr("transform(filter(__s, c -> c.base), c -> concat(c.s, ':', c.e))")
    rows = rows.withColumn("__b", places)
    return rows.withColumn("spans", F.expr("filter(__s, c -> c.base OR NOT array_contains(__b, concat(c.s, ':', c.e)))")).drop("__c", "__s", "__b")


def redacted(docs: DataFrame, model: Redactor, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans are one."""
    # the row travels as one column, so its names cannot clash with those made here
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = spans(docs.select(held, F.col(f"`{text}`").alias("__text")), model, "__text")
    done = F.expr(
        """aggregate(spans, named_struct('at', 0, 'out', cast(array() AS array<string>)),
            (a, c) -> CASE WHEN c.e <= a.at THEN a
                WHEN c.s < a.at THEN named_struct('at', c.e, 'out', a.out)
                ELSE named_struct('at', c.e, 'out', concat(a.out, array(substring(t, a.at + 1, c.s - a.at), concat('[', upper(c.kind), ']')))) END,
            a -> concat(array_join(a.out, ''), substring(t, a.at + 1)))"""
    )
    rows = rows.withColumn("__new", F.when(F.col("__text").isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("t")).otherwise(done))
    return rows.select(*[F.col("__new").alias(c) if c == text else F.col(f"__row.`{c}`") for c in docs.columns])


def pii_query(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    rows = spans(docs, Redactor.fit(docs))
    count = lambda kind: F.expr(f"size(filter(spans, c -> c.base AND c.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    joined = lambda which: F.expr(f"array_join(transform({which}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')")
    return rows.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(joined("filter(spans, c -> c.base)"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.expr("size(filter(spans, c -> NOT c.base))").cast("long").alias("n_method"),
        F.size("spans").cast("long").alias("n_spans"),
    )
