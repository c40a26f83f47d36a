"""Classification scores.  All of them follow from one count per (truth, predicted) pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordered import Scan, prefix_scan, radix_chunks


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


# Labels whose full grid of pairs is made; more are refused.
MAX_LABELS = 1000


def confusion_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of labels that occur, with the totals of both sides: a sparse matrix for any number of labels.

    All four numbers come from the pair counts; pairs that do not occur are 0.
    """
    counts = pair_counts(pairs)
    truth = counts.groupBy("truth").agg(F.sum("n").alias("truth_total"))
    predicted = counts.groupBy("predicted").agg(F.sum("n").alias("predicted_total"))
    return counts.join(truth, "truth").join(predicted, "predicted").select("truth", "predicted", "n", "truth_total", "predicted_total")


def confusion_matrix(pairs: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Every truth label with every predicted label, also where the count is 0.

    The grid grows with the square of the labels, so it is refused beyond ``max_labels``; see
    ``confusion_pairs``.
    """
    counts = pair_counts(pairs)
    both = counts.select(F.explode(F.array("truth", "predicted")).alias("label")).distinct()
    # one more than allowed is enough to know
    labels = both.limit(max_labels + 1).agg(F.collect_list("label").alias("labels"))
    refused = F.raise_error(F.lit(f"more than {max_labels} labels")).cast("array<string>")
    kind = pairs.schema["truth"].dataType.simpleString()
    labels = labels.select(F.when(F.size("labels") <= max_labels, F.col("labels")).otherwise(refused.cast(f"array<{kind}>")).alias("labels"))
    grid = labels.select("labels", F.explode("labels").alias("truth")).select(
        "truth", F.explode("labels").alias("predicted")
    )
    return grid.join(counts, ["truth", "predicted"], "left").fillna(0, ["n"])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label that occurs on either side."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("predicted"), n).otherwise(none)

    def side(label: str, tp: Column, support: Column, said: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), support.alias("support"), said.alias("said"))

    sides = pair_counts(pairs).select(
        F.inline(F.array(side("truth", hit, n, none), side("predicted", none, none, n)))
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "said")])
    return sums.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("said")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("said") + F.col("support")),
        }
    )


def summary(pairs: DataFrame) -> DataFrame:
    """Accuracy and the unweighted means over all labels."""
    return class_scores(pairs).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def report(pairs: DataFrame) -> DataFrame:
    """One row per label, then accuracy and the macro and weighted averages."""
    scores = class_scores(pairs)
    cols = ("precision", "recall", "f1")
    weight, total = F.col("support"), F.sum("support")
    averages = scores.agg(
        F.struct(
            F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in cols], total.alias("support")
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[_ratio(F.sum(F.col(c) * weight), total).alias(c) for c in cols],
            total.alias("support"),
        ).alias("weighted"),
        F.struct(
            F.lit("accuracy").alias("label"),
            *[_ratio(F.sum("tp"), total).alias(c) for c in cols],
            total.alias("support"),
        ).alias("accuracy"),
    ).select(F.inline(F.array("macro", "weighted", "accuracy")))
    return scores.select(F.col("label").cast("string").alias("label"), *cols, "support").unionByName(averages)


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """Rows and percent of each class (documented only)."""
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("percent", 100 * F.col("n") / total)


def roc_auc(scored: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve (documented only): equal scores share their rank.

    Counts per distinct score first, then a running count of the negatives below it.
    """
    counts = scored.groupBy(F.col(score).alias("__s")).agg(
        F.count_if(positive).alias("__pos"), F.count_if(~F.col(positive)).alias("__neg")
    )
    ranked = prefix_scan(
        counts, [], "__s", {"__below": Scan("sum", F.col("__neg"), False)}, radix_chunks("__s", counts.schema["__s"].dataType)
    )
    wins = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2))
    pairs = F.nullif(F.sum("__pos") * F.sum("__neg"), F.lit(0))
    return ranked.agg(
        (wins / pairs).alias("auc"), F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives")
    )
