"""First-to-ahead-by-k voting over a log of responses.

A task is decided by its responses in order.  Responses that are flagged or cannot be read do not
vote.  The vote stops as soon as one answer leads the other by k (with two answers this is also
the rule "one answer alone has k votes"), or after ``max_votes`` votes.  Then the answer with more
votes wins; at a tie the one seen first; without any vote the answer is NO.

The log is read once.  Each response becomes a few small numbers, and their running sums along the
log give the state of the vote after every response; the end of a vote is then the first row where
a stop rule holds.  The sums are made in chunks, so a task may have any number of responses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators.ordered import Scan, prefix_scan

TASK = ("contract_id", "clause_category")
MAX_VOTES = 20

# Responses that one task is to sort.
RESPONSES_AT_ONCE = 1 << 18

COUNTS = ("yes_votes", "no_votes", "responses", "red_flagged", "discarded")


def read_responses(
    log: DataFrame, max_words: int = tx.MAX_RESPONSE_WORDS, failed: str | None = None
) -> DataFrame:
    """The log with ``reason`` (why a response is discarded) and ``answer`` (its vote).

    ``failed`` names a flag of calls that gave no response; such a row has neither.
    """
    text = F.col("response")
    marked = log.withColumns({"__upper": F.upper(text), "__lower": F.lower(text)})
    reason = tx.flag_reason(text, F.col("__upper"), F.col("__lower"), max_words)
    if failed:
        reason = F.when(~F.col(failed), reason)
    answer = F.when(F.col("reason").isNull(), tx.parse_answer(F.col("__upper")))
    if failed:
        answer = F.when(~F.col(failed), answer)
    return marked.withColumn("reason", reason).withColumn("answer", answer).drop("__upper", "__lower")


def _ballots(
    log: DataFrame, task: Sequence[str], failed: str | None, max_words: int
) -> DataFrame:
    """Each response as numbers: its votes, flags and failures."""
    read = read_responses(log, max_words, failed)
    return read.select(
        *task,
        F.col("seq").cast("long").alias("seq"),
        *[
            F.coalesce(mark.cast("long"), F.lit(0)).alias(name)
            for name, mark in {
                "yes": F.col("answer") == "YES",
                "no": F.col("answer") == "NO",
                "drawn": F.col("seq").isNotNull(),
                "flag": F.col("reason").isNotNull(),
                "none": F.col("answer").isNull(),
                "fail": F.col(failed) if failed else F.col("seq").isNull(),
            }.items()
        ],
    )


def _running(ballots: DataFrame, task: Sequence[str], k: int, max_votes: int) -> DataFrame:
    """The state of the vote after each ballot, and whether the vote ends there."""
    sums = ("yes", "no", "drawn", "flag", "none", "fail")
    # a long log is dealt to more tasks than the session's number, so that what one sorts does not grow with it
    parts = -(-ballots.count() // RESPONSES_AT_ONCE)
    usual = int(ballots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = prefix_scan(
        ballots, task, "seq", {f"n_{c}": Scan("sum", c) for c in sums}, costly=True, parts=parts if parts > usual else None
    ).where(F.col("n_fail") == 0)  # a failed call ends the vote of its task
    votes = F.col("n_yes") + F.col("n_no")
    is_vote = F.col("yes") + F.col("no") > 0
    ahead = is_vote & (votes <= max_votes) & (F.abs(F.col("n_yes") - F.col("n_no")) >= k)
    return state.withColumns({"ahead": ahead, "closes": ahead | (is_vote & (votes == max_votes))})


def decide(
    log: DataFrame,
    k: int = 3,
    max_votes: int = MAX_VOTES,
    task: Sequence[str] = TASK,
    failed: str | None = None,
    max_words: int = tx.MAX_RESPONSE_WORDS,
) -> DataFrame:
    """One decision per task that has a response.

    ``responses`` counts all responses drawn, ``red_flagged`` the flagged ones among them and
    ``discarded`` the flagged and the unreadable ones.  ``closed`` tells whether a stop rule ended
    the vote.
    """
    task = list(task)
    state = _running(_ballots(log, task, failed, max_words), task, k, max_votes)
    after = F.struct("seq", "n_yes", "n_no", "n_drawn", "n_flag", "n_none", "ahead")
    real_vote = F.col("yes") + F.col("no") > 0
    ends = state.groupBy(*task).agg(
        F.min(F.when(F.col("closes"), after)).alias("__end"),
        F.max(after).alias("__last"),
        F.min(F.when(real_vote, F.struct("seq", F.when(F.col("yes") > 0, "YES").otherwise("NO").alias("a")))).alias(
            "__first"
        ),
    )
    at = F.coalesce("__end", "__last")
    first = F.col("__first.a")
    return ends.select(
        *task,
        at["n_yes"].alias("yes_votes"),
        at["n_no"].alias("no_votes"),
        (at["n_yes"] + at["n_no"]).alias("total_votes"),
        F.coalesce(F.col("__end.ahead"), F.lit(False)).alias("converged"),
        F.col("__end").isNotNull().alias("closed"),
        at["n_drawn"].alias("responses"),
        at["n_flag"].alias("red_flagged"),
        at["n_none"].alias("discarded"),
        first.alias("first_answer"),
    ).withColumn("answer", leading_answer())


def leading_answer() -> Column:
    """The answer with more votes; at a tie the one seen first; without votes NO."""
    return (
        F.when(F.col("yes_votes") > F.col("no_votes"), "YES")
        .when(F.col("no_votes") > F.col("yes_votes"), "NO")
        .otherwise(F.coalesce("first_answer", F.lit("NO")))
    )


def vote(
    tasks: DataFrame,
    log: DataFrame,
    k: int = 3,
    max_votes: int = MAX_VOTES,
    task: Sequence[str] = TASK,
    failed: str | None = None,
    max_words: int = tx.MAX_RESPONSE_WORDS,
) -> DataFrame:
    """Decide every task, also those without any response (NO, not converged)."""
    decisions = decide(log, k, max_votes, task, failed, max_words).drop("first_answer", "closed")
    return tasks.join(decisions, on=list(task), how="left").fillna(
        {"answer": "NO", "converged": False, "total_votes": 0, **{c: 0 for c in COUNTS}}
    )


def drawn_responses(
    log: DataFrame,
    k: int = 3,
    max_votes: int = MAX_VOTES,
    task: Sequence[str] = TASK,
    failed: str | None = None,
    max_words: int = tx.MAX_RESPONSE_WORDS,
) -> DataFrame:
    """The responses a vote draws, up to its end, with the number of votes before each."""
    state = _running(_ballots(log, list(task), failed, max_words), task, k, max_votes)
    closed = {"__closed": Scan("max", F.col("closes").cast("int"), inclusive=False)}
    kept = prefix_scan(state, task, "seq", closed).where(F.coalesce("__closed", F.lit(0)) == 0)
    before = F.col("n_yes") + F.col("n_no") - F.col("yes") - F.col("no")
    return kept.select(*task, "seq", before.alias("votes_before"))


def sampling_temperature(drawn: DataFrame, first: float = 0.0, later: float = 0.1) -> DataFrame:
    """The temperature each drawn response was asked with: ``first`` up to the first valid vote."""
    return drawn.withColumn("temperature", F.when(F.col("votes_before") == 0, F.lit(first)).otherwise(F.lit(later)))


def vote_counts(decided: DataFrame) -> Column:
    """The votes of a decision as a map; an answer without votes has no entry."""
    entries = F.array(
        F.struct(F.lit("YES").alias("key"), F.col("yes_votes").alias("value")),
        F.struct(F.lit("NO").alias("key"), F.col("no_votes").alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
