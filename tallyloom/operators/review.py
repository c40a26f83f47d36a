"""Scores of voted contract reviews: accuracy, contract roll-ups, costs, error breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.voting import vote_counts

# Fixed value: the assumed price of one vote.
COST_PER_VOTE = 0.03


def judge(voted: DataFrame) -> DataFrame:
    """Add whether the voted answer equals the truth."""
    return voted.withColumn("correct", F.col("answer") == F.col("truth"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy_by(judged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    right, total = F.count_if("correct"), F.count("*")
    return judged.groupBy(*keys).agg(
        right.alias("correct"), total.alias("total"), _ratio(right, total).alias("accuracy")
    )


def contract_results(judged: DataFrame) -> DataFrame:
    """One row per contract; its clause list has one entry per category, so its size is fixed."""
    clause = F.struct(
        "clause_category",
        F.col("truth").alias("ground_truth"),
        F.col("answer").alias("prediction"),
        "correct",
        vote_counts(judged).alias("votes"),
        "total_votes",
        "converged",
    )
    errors = F.count_if(~F.col("correct"))

    def by_category(a: Column, b: Column) -> Column:
        return F.when(a["clause_category"] < b["clause_category"], -1).otherwise(1)

    return judged.groupBy("contract_id").agg(
        F.array_sort(F.collect_list(clause), by_category).alias("clauses"),
        errors.alias("errors"),
        (errors == 0).alias("zero_errors"),
    )


def experiment_metrics(judged: DataFrame, k: int, cost_per_vote: float = COST_PER_VOTE) -> DataFrame:
    """One row with accuracy, zero-error rate, votes per converged decision and cost."""
    per_contract = judged.groupBy("contract_id").agg(
        F.count("*").alias("clauses"),
        F.count_if("correct").alias("right"),
        F.sum(F.when(F.col("converged"), F.col("total_votes"))).alias("votes"),
        F.count_if("converged").alias("converged"),
        F.sum("responses").alias("responses"),
        F.sum("red_flagged").alias("red_flagged"),
        F.sum("discarded").alias("discarded"),
    )
    clauses, right = F.sum("clauses"), F.sum("right")
    zero = F.count_if(F.col("right") == F.col("clauses"))
    avg_votes = F.coalesce(F.sum("votes") / F.nullif(F.sum("converged"), F.lit(0)), F.lit(float(k)))
    return per_contract.agg(
        F.count("*").alias("total_contracts"),
        F.coalesce(clauses, F.lit(0)).alias("total_clauses"),
        F.coalesce(right, F.lit(0)).alias("correct_clauses"),
        F.coalesce(_ratio(right, clauses), F.lit(0.0)).alias("accuracy"),
        zero.alias("zero_error_contracts"),
        _ratio(zero, F.count("*")).alias("zero_error_rate"),
        F.coalesce(F.sum("converged"), F.lit(0)).alias("converged"),
        avg_votes.alias("avg_votes_per_decision"),
        (F.coalesce(clauses, F.lit(0)) * avg_votes * cost_per_vote).alias("total_cost_estimate"),
        F.coalesce(F.sum("responses"), F.lit(0)).alias("total_responses"),
        F.coalesce(F.sum("red_flagged"), F.lit(0)).alias("red_flagged"),
        F.coalesce(F.sum("discarded"), F.lit(0)).alias("discarded"),
    )


def experiment_head(judged: DataFrame, k: int, sample_size: str, model: str) -> DataFrame:
    """The head of an experiment's document, one row: configuration, metrics and voter statistics.

    The results of its contracts are lines of their own, as there may be any number of them.
    """
    metrics = ("accuracy", "zero_error_rate", "total_contracts", "total_clauses", "correct_clauses", "avg_votes_per_decision")
    return experiment_metrics(judged, k).select(
        F.struct(F.lit(k).alias("k"), F.lit(sample_size).alias("sample_size"), F.lit(model).alias("model")).alias("config"),
        F.struct(*metrics).alias("metrics"),
        F.struct("total_responses", "red_flagged", "discarded").alias("voter_stats"),
    )


def voter_statistics(voted: DataFrame) -> DataFrame:
    """Totals over all votes: unreadable answers are discarded but are not red flags."""
    return voted.agg(
        F.sum("responses").alias("total_responses"),
        F.sum("red_flagged").alias("red_flagged"),
        F.sum("discarded").alias("discarded"),
    )


def clause_confusion(judged: DataFrame, keys: Sequence[str] = ("clause_category",)) -> DataFrame:
    """Error rates of the YES answer (documented in the experiment plan only)."""
    said, true = F.col("answer") == "YES", F.col("truth") == "YES"
    counts = judged.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"),
        F.count_if(~said & ~true).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "fp_rate": _ratio(fp, fp + tn),
            "fn_rate": _ratio(fn, fn + tp),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def length_band(text_length: Column) -> Column:
    """short below 2,000 characters, medium up to 5,000, long above (documented only)."""
    return F.when(text_length < 2000, "short").when(text_length <= 5000, "medium").otherwise("long")


def flag_histogram(read: DataFrame) -> DataFrame:
    """How many responses each rule discards; the detail in brackets is left out."""
    kind = F.regexp_replace(F.coalesce("reason", F.lit("kept")), r" \(.*$", "")
    return read.groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


def scaling_laws(
    rates: DataFrame, ks: Sequence[int], targets: Sequence[float], p: str = "p", s: str = "s", v: str = "v"
) -> DataFrame:
    """What voting should reach for each measured rate (from the cited paper; documented only).

    ``p`` is the success rate of one answer, ``s`` the number of decisions that must all be right,
    ``v`` the share of usable responses.  Below one half more votes do not help: k_min is NULL.
    """
    grid = rates.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn(
        "target", F.explode(F.array(*[F.lit(t) for t in targets]))
    )
    odds = (1 - F.col(p)) / F.col(p)
    p_sub = F.when(F.col(p) <= 0, F.lit(0.0)).otherwise(1 / (1 + F.pow(odds, F.col("k"))))
    usable = (F.col(p) > 0.5) & (F.col(p) < 1)
    k_min = F.when(
        usable, F.ceil(F.log(F.pow(F.col("target"), -1.0 / F.col(s)) - 1) / F.log(odds))
    ).when(F.col(p) >= 1, F.lit(1))
    cost = F.when(
        (F.col(p) > 0.5) & (F.col(v) > 0),
        F.col(s) * F.log(F.col(s).cast("double")) / (F.col(v) * (2 * F.col(p) - 1)),
    )
    return (
        grid.withColumn("p_sub", p_sub)
        .withColumn("p_full", F.pow(F.col("p_sub"), F.col(s)))
        .withColumn("k_min", k_min.cast("long"))
        .withColumn("relative_cost", cost)
    )


def best_threshold(laws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest k of the grid whose expected full success reaches the target."""
    enough = laws.where(F.col("p_full") >= F.col("target"))
    return enough.groupBy(*keys).agg(F.min("k").alias("k"))
