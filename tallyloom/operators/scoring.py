"""Hooks for user models: score rows in batches, and answer tasks round by round."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.voting import MAX_VOTES, TASK, read_responses


def halved(model: Callable[[list], Sequence], items: list) -> list[tuple]:
    """(result, error) of each item: the model gets all items at once, and on an error each half by itself.

    An item stands alone before its error counts, so one bad item costs two calls per halving.
    """
    if not items:
        return []
    try:
        results = list(model(items))
        if len(results) != len(items):
            raise ValueError(f"{len(results)} results for {len(items)} rows")
        return [(None if r is None else str(r), None) for r in results]
    except Exception as problem:  # the row is reported, the job goes on
        if len(items) == 1:
            return [(None, str(problem))]
        middle = len(items) // 2
        return halved(model, items[:middle]) + halved(model, items[middle:])


def score_rows(df: DataFrame, key: str, value: str, load_model: Callable[[], Callable[[list], Sequence]], batch: int = 1024) -> DataFrame:
    """Apply a user model to batches of rows; a row it fails on gets an ``error`` instead of a result.

    ``load_model`` runs once per task and returns a function from a list of values to a list of results.
    """
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                scored = halved(model, part[value].tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), "result": [r for r, _ in scored], "error": [e for _, e in scored]})

    return df.select(key, value).mapInPandas(run, f"{key} {key_type}, result string, error string")


def answer_tasks(
    tasks: DataFrame,
    load_responder: Callable[[], Callable[[int, str, int], str]],
    rounds: int,
    first_round: int = 1,
) -> DataFrame:
    """Ask a responder ``rounds`` times per task; gives a response log for ``voting``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = load_responder()
        for batch in batches:
            texts, failed = [], []
            for row in batch.itertuples(index=False):
                try:
                    texts.append(responder(row.contract_id, row.clause_category, row.seq))
                    failed.append(False)
                except Exception:  # a failed call ends the vote of its task
                    texts.append(None)
                    failed.append(True)
            yield batch.assign(response=texts, failed=failed)

    asked = tasks.select(
        *TASK, F.explode(F.array(*[F.lit(n).cast("long") for n in range(first_round, first_round + rounds)])).alias("seq")
    )
    schema = "contract_id long, clause_category string, seq long, response string, failed boolean"
    return asked.withColumn("contract_id", F.col("contract_id").cast("long")).mapInPandas(run, schema)


# What is known of a task after some blocks of answers.
COUNTED = "yes long, no long, asked long, first string, state string"
OPEN, DECIDED, OUT_OF_VOTES, BROKEN, NO_ANSWER = "open", "decided", "out of votes", "broken", "no valid answer"


def counted(before: DataFrame, answers: DataFrame, k: int, max_votes: int, max_asked: int) -> DataFrame:
    """The states of tasks after one more block of answers, from their states before it.

    A block has a fixed number of answers per task, so they are folded in order as one short array.
    """
    read = read_responses(answers, failed="failed")
    answer = F.struct(F.col("seq").alias("seq"), F.col("answer").alias("answer"), F.coalesce("failed", F.lit(False)).alias("failed"))
    blocks = read.groupBy(*TASK).agg(F.sort_array(F.collect_list(answer)).alias("block"))

    def step(s: Column, x: Column) -> Column:
        yes = s["yes"] + F.when(x["answer"] == "YES", 1).otherwise(0)
        no = s["no"] + F.when(x["answer"] == "NO", 1).otherwise(0)
        state = (
            F.when(x["failed"], BROKEN)
            .when(x["answer"].isNotNull() & (F.abs(yes - no) >= k), DECIDED)
            .when(yes + no >= max_votes, OUT_OF_VOTES)
            .when((s["asked"] + 1 >= max_asked) & (yes + no == 0), NO_ANSWER)
            .when(s["asked"] + 1 >= max_asked, OUT_OF_VOTES)
            .otherwise(OPEN)
        )
        after = F.struct(
            yes.cast("long").alias("yes"),
            no.cast("long").alias("no"),
            (s["asked"] + 1).alias("asked"),
            F.coalesce(s["first"], x["answer"]).alias("first"),
            state.alias("state"),
        )
        return F.when(s["state"] == OPEN, after).otherwise(s)

    folded = before.join(blocks, list(TASK)).withColumn("s", F.aggregate("block", F.struct("yes", "no", "asked", "first", "state"), step))
    return folded.select(*TASK, "s.*")


def answer_until_decided(
    tasks: DataFrame,
    load_responder: Callable[[], Callable[[int, str, int], str]],
    path: str,
    k: int = 3,
    max_votes: int = MAX_VOTES,
    block: int = 5,
    max_asked: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ask in blocks of rounds until no task is open; gives the log and the last state of each task.

    A task is decided, out of votes, broken by an error, or, after ``max_asked`` questions (ten times the
    votes) without one, left with the state "no valid answer".  Counts per task are carried from block to
    block, so each answer is read once.  Answers and states are written below ``path``, so no call is made
    twice, and a task stops costing calls at most one block after its end.
    """
    spark, limit = tasks.sparkSession, max_asked or 10 * max_votes
    task_schema = "contract_id long, clause_category string"
    log_schema = f"{task_schema}, seq long, response string, failed boolean"

    def states(start: int | None = None) -> DataFrame:
        at = path + "/states" + ("" if start is None else f"/start={start}")
        return spark.read.schema(f"{task_schema}, {COUNTED}").parquet(at)

    first = tasks.select(F.col("contract_id").cast("long").alias("contract_id"), "clause_category").distinct()
    zero = F.lit(0).cast("long")
    first = first.select(*TASK, zero.alias("yes"), zero.alias("no"), zero.alias("asked"), F.lit(None).cast("string").alias("first"), F.lit(OPEN).alias("state"))
    first.write.mode("overwrite").parquet(f"{path}/states/start=1")
    for start in itertools.count(1, block):
        still_open = states(start).where(F.col("state") == OPEN)
        if still_open.isEmpty():
            break
        log = f"{path}/log/start={start}"
        answer_tasks(still_open.select(*TASK), load_responder, block, start).write.mode("overwrite").parquet(log)
        answers = spark.read.schema(log_schema).parquet(log)
        counted(still_open, answers, k, max_votes, limit).write.mode("overwrite").parquet(f"{path}/states/start={start + block}")
    ended = states().where(F.col("state") != OPEN)
    return spark.read.schema(log_schema).parquet(f"{path}/log"), ended
