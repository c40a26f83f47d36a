"""Streaming queries: each reads the event files as a stream until nothing new is left."""

from pyspark.sql import functions as F

from tallyloom.plans.catalog import Tables, query, r6
from tallyloom.plans.oracle_parts import vote_ctes
from tallyloom.session import shared_dir
from tallyloom.sources.tables import vote_log_of
from tallyloom.streaming import online, watch


def shuffled_stream(t: Tables):
    """The events out of order in several files, one per batch."""
    parts = shared_dir(t.spark, "events")
    t.events.repartition(4, F.xxhash64("event_id")).write.parquet(parts)
    stream = watch.new_files(t.spark, parts, t.events.schema, per_check=1)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def collected(t: Tables, stream, schema: str, out: str | None = None, checkpoint: str | None = None):
    """Run a stream once into a table and read that table."""
    out = out or shared_dir(t.spark, "out")
    watch.run_once(watch.collect_new(stream, out, checkpoint or shared_dir(t.spark, "checkpoint")))
    return t.spark.read.schema(schema).parquet(out)


@query(
    "watch_new_items",
    "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS items FROM events GROUP BY 1",
)
def watch_new_items(t):
    """Two checks with one checkpoint: the second finds nothing new."""
    out, checkpoint = shared_dir(t.spark, "out"), shared_dir(t.spark, "checkpoint")
    stream = shuffled_stream(t).select("event_id", "event_type")
    collected(t, stream, "event_id long, event_type string", out, checkpoint)
    seen = collected(t, stream, "event_id long, event_type string", out, checkpoint)
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("items"))


@query(
    "watch_after_reset",
    "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1",
)
def watch_after_reset(t):
    """A fresh checkpoint with a fresh output starts over and gets every item again."""
    stream = shuffled_stream(t).select("event_id", "event_type")
    first = collected(t, stream, "event_id long, event_type string")
    again = collected(t, stream, "event_id long, event_type string")
    return first.unionByName(again).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "watch_after_baseline",
    """SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def watch_after_baseline(t):
    known = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("user_id"))
    stream = watch.after_baseline(shuffled_stream(t), known, "user_id").select("event_id", "user_id")
    return collected(t, stream, "event_id long, user_id long")


@query(
    "watch_distinct_users",
    "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, event_type FROM events)",
)
def watch_distinct_users(t):
    stream = watch.first_of_key(shuffled_stream(t), ["user_id", "event_type"])
    seen = collected(t, stream.select("user_id", "event_type"), "user_id long, event_type string")
    return seen.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "synced_sources",
    """SELECT 'metrics' AS target, count(*) FILTER (event_id % 17 <> 0) AS n FROM events
       UNION ALL SELECT 'users', count(DISTINCT user_id) FILTER (event_id % 17 <> 0) FROM events
       UNION ALL SELECT 'rejected', count(*) FILTER (event_id % 17 = 0) FROM events""",
)
def synced_sources(t):
    """Events with broken JSON go to the reject table, the others to two targets."""
    out = shared_dir(t.spark, "sync")
    text = F.when(F.col("event_id") % 17 == 0, "{bad").otherwise(F.col("props"))
    stream = shuffled_stream(t).withColumn("props", text)
    writers = {
        "metrics": lambda good: good.select("event_id", "value"),
        "users": lambda good: good.select("user_id").distinct(),
    }
    good = F.try_parse_json("props").isNotNull()
    watch.run_once(watch.sync_sources(stream, good, writers, out, shared_dir(t.spark, "checkpoint")))
    schemas = {"metrics": "event_id long, value double", "users": "user_id long", "rejected": "event_id long"}
    # a user may come in several batches: the keyed target is merged on its key when it is read
    keys = {"users": ["user_id"]}
    parts = []
    for name, schema in schemas.items():
        rows = t.spark.read.schema(schema).parquet(f"{out}/{name}")
        rows = rows.dropDuplicates(keys[name]) if name in keys else rows
        parts.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "live_metrics",
    """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, round(avg(value), 6) AS mean,
              round(max(value), 6) AS max, count(value) AS n,
              d + interval 1 day <= (SELECT max(ts) - interval 1 hour FROM events) AS closed
       FROM (SELECT *, date_trunc('day', ts) AS d FROM events) GROUP BY ALL""",
)
def live_metrics(t):
    """Daily values of each kind, whatever the order of the files; days near the latest event are open."""
    out = shared_dir(t.spark, "metrics")
    running = watch.metric_parts(shuffled_stream(t), "ts", ["event_type"], "value", "1 day", out, shared_dir(t.spark, "checkpoint"))
    watch.run_once(running)
    schema = "start timestamp, end timestamp, event_type string, sum double, max double, n long, latest timestamp"
    done = watch.merged_metrics(t.spark.read.schema(schema).parquet(out), ["event_type"], "1 hour")
    return r6(done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "mean", "max", "n", "closed"))


@query(
    "online_votes",
    """SELECT contract_id, clause_category, answer, yes_votes, no_votes, total_votes, converged, responses,
              red_flagged, discarded FROM decided""",
    ("vote_log",),
    vote_ctes(3, 20),
)
def online_votes(t):
    """Votes decided as the responses arrive, in four batches; equal to the vote over the whole log.

    A quarter may be any number of files, of which none is earlier than another: a check takes all of them.
    """
    out, parts, checkpoint = (shared_dir(t.spark, purpose) for purpose in ("votes", "events", "checkpoint"))
    cuts = t.events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.01)
    piece = sum((F.col("event_id") > cut).cast("int") for cut in cuts) if cuts else F.lit(0)
    for n in range(4):
        t.events.where(piece == n).write.mode("append").parquet(parts)
        stream = watch.new_files(t.spark, parts, t.events.schema, per_check=None).withColumn("ts", F.col("ts").cast("timestamp"))
        watch.run_once(online.vote_online(vote_log_of(stream), out, checkpoint))
    return online.online_decisions(t.spark, out)
