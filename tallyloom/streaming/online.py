"""Voting while responses arrive, on the engine's keyed state.

Responses become a few small numbers where they lie; per task the state holds the vote so far.  A batch
moves a task's vote on with the same rules as a whole log, and emits the tasks it touched.  The state store
and its recovery are the stream's own; the emitted rows of a batch replace those of a repeated batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.voting import MAX_VOTES, TASK, leading_answer, read_responses

STATE = (
    "yes_votes long, no_votes long, responses long, red_flagged long, discarded long, first_answer string,"
    " converged boolean, closed boolean, last_seq long"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
DECISIONS = f"contract_id long, clause_category string, {STATE}"


def advanced(state: tuple, rows: Iterable[tuple], k: int, max_votes: int) -> tuple:
    """The state of a task's vote after further responses, in order: seq, flagged, answer (null: unreadable)."""
    yes, no, drawn, flagged, unread, first, converged, closed, last = state
    for seq, is_flagged, answer in rows:
        if seq <= last:
            raise ValueError(f"response {seq} of a task came after response {last}")
        last = seq
        if closed:
            continue
        drawn, flagged, unread = drawn + 1, flagged + bool(is_flagged), unread + (answer is None)
        if answer is None:
            continue
        yes, no = yes + (answer == "YES"), no + (answer == "NO")
        first = first or answer
        converged = abs(yes - no) >= k
        closed = converged or yes + no >= max_votes
    return yes, no, drawn, flagged, unread, first, converged, closed, last


def vote_online(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    k: int = 3,
    max_votes: int = MAX_VOTES,
    interval: str | None = None,
) -> StreamingQuery:
    """Start deciding the tasks of a response stream (contract_id, clause_category, seq, response).

    Inside a batch a task's responses may come in any order; from batch to batch their ``seq`` must
    rise, and one that comes late stops the stream with an error.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # plain lists: a task has few responses in a batch, and a data frame of its own costs more than its vote
        rows = [r for part in parts for r in zip(*(part[c].tolist() for c in ("seq", "flagged", "answer")), strict=True)]
        rows = sorted(((seq, flagged, answer if isinstance(answer, str) else None) for seq, flagged, answer in rows), key=lambda r: r[0])
        now = advanced(state.get if state.exists else (0, 0, 0, 0, 0, None, False, False, -(1 << 62)), rows, k, max_votes)
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=[*TASK, *FIELDS])

    read = read_responses(stream).select(*TASK, F.col("seq").cast("long").alias("seq"), F.col("reason").isNotNull().alias("flagged"), "answer")
    decided = read.groupBy(*TASK).applyInPandasWithState(step, DECISIONS, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        decided.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def online_decisions(spark: SparkSession, out: str) -> DataFrame:
    """The decisions so far: of each task the rows of the latest batch that touched it."""
    rows = spark.read.schema(DECISIONS).parquet(out)
    latest = rows.groupBy(*TASK).agg(F.max_by(F.struct(*FIELDS), "last_seq").alias("s")).select(*TASK, "s.*")
    return latest.select(
        *TASK,
        leading_answer().alias("answer"),
        "yes_votes",
        "no_votes",
        (F.col("yes_votes") + F.col("no_votes")).alias("total_votes"),
        "converged",
        "responses",
        "red_flagged",
        "discarded",
    )
