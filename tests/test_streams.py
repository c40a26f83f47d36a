import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import voting
from tallyloom.plans import QUERIES
from tallyloom.session import shared_dir
from tallyloom.sources.tables import vote_log_of
from tallyloom.streaming import online, watch
from tests.test_voting import SCHEMA, frames, random_logs


def write_parts(log, spark, n):
    """The log as files, in rising seq; inside a file rows are in any order."""
    path = shared_dir(spark, "log")
    rows = sorted(log.drop("failed").collect(), key=lambda r: r["seq"])
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA.replace(", failed boolean", "")).coalesce(1).write.mode("append").parquet(path)
    return path


def test_online_vote_equals_batch(spark):
    logs = {t: c.replace("E", "m") for t, c in random_logs(40, seed=9).items() if c}
    _, log = frames(spark, logs)
    path = write_parts(log, spark, 7)
    schema = "contract_id long, clause_category string, seq long, response string"
    stream = watch.new_files(spark, path, schema, per_check=1)
    state, checkpoint = shared_dir(spark, "state"), shared_dir(spark, "check")
    running = online.vote_online(stream, state, checkpoint, 3, 20)
    watch.run_once(running)
    batches = running.lastProgress["batchId"] + 1
    assert batches == 7
    got = online.online_decisions(spark, state)
    want = voting.decide(log, 3, 20).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_response_is_an_error(spark):
    schema = "contract_id long, clause_category string, seq long, response string"
    path = shared_dir(spark, "log")
    for seq in (5, 3):
        spark.createDataFrame([(1, "a", seq, "Yes")], schema).coalesce(1).write.mode("append").parquet(path)
    running = online.vote_online(watch.new_files(spark, path, schema, per_check=1), shared_dir(spark, "state"), shared_dir(spark, "check"))
    with pytest.raises(Exception, match="came after response 5"):
        watch.run_once(running)


def test_each_item_once(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    schema = "id long"
    for batch in range(3):
        spark.range(batch * 10, batch * 10 + 10).write.mode("append").parquet(path)
        stream = watch.new_files(spark, path, schema)
        watch.run_once(watch.collect_new(stream, out, checkpoint))
        assert spark.read.parquet(out).count() == 10 * (batch + 1)
    assert spark.read.parquet(out).distinct().count() == 30


def test_bad_rows_go_to_the_rejects(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    spark.range(20).write.parquet(path)
    stream = watch.new_files(spark, path, "id long")
    query = watch.sync_sources(stream, F.col("id") % 4 != 0, {"kept": lambda d: d}, out, checkpoint)
    watch.run_once(query)
    assert spark.read.parquet(f"{out}/kept").count() == 15
    assert spark.read.parquet(f"{out}/rejected").count() == 5


def test_daemon_and_baseline(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    spark.range(10).write.parquet(path)
    fresh = watch.after_baseline(watch.new_files(spark, path, "id long"), spark.range(5), "id")
    query = watch.collect_new(fresh, out, checkpoint, interval="1 second")
    try:
        query.processAllAvailable()
        spark.range(10, 12).write.mode("append").parquet(path)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [5, 6, 7, 8, 9, 10, 11]


def test_repeats_are_dropped(spark):
    path = shared_dir(spark, "in")
    rows = spark.range(30).selectExpr("id % 7 AS k", "timestamp_seconds(1700000000 + id) AS ts")
    rows.coalesce(1).write.parquet(path)
    stream = watch.first_of_key(watch.new_files(spark, path, "k long, ts timestamp"), ["k"], "ts", "1 hour")
    out = shared_dir(spark, "out")
    watch.run_once(watch.collect_new(stream, out, shared_dir(spark, "check")))
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(7))


def test_online_votes_over_a_table_of_many_files(spark, tmp_path):
    """Each of the four quarters is several files then, and no file of a quarter is earlier than another."""
    data = str(tmp_path / "data")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(8).write.parquet(f"{data}/events.parquet")
    log = vote_log_of(spark.read.parquet(f"{data}/events.parquet"))
    columns = ["contract_id", "clause_category", "answer", "yes_votes", "no_votes", "total_votes", "converged", "responses", "red_flagged", "discarded"]
    want = {tuple(r) for r in voting.decide(log).select(*columns).collect()}
    assert {tuple(r) for r in QUERIES["online_votes"](spark, data).select(*columns).collect()} == want
