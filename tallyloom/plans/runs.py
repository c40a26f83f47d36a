"""Queries over tracked runs and their metric series."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.operators import provenance, runs, similarity
from tallyloom.plans.catalog import query, r6
from tallyloom.session import shared_dir
from tallyloom.sources import sinks

M, U = ("run_metrics",), ("runs",)
EXP = "coalesce(nullif(experiment, ''), 'default')"


def as_of():
    """The fixed time of the check, so that results can be repeated."""
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@query(
    "run_by_hash",
    "SELECT run_hash, name, experiment FROM runs WHERE run_hash = md5('7')",
    U,
)
def run_by_hash(t):
    return t.runs.where(F.col("run_hash") == F.md5(F.lit("7"))).select("run_hash", "name", "experiment")


@query("latest_run", "SELECT run_hash, name FROM runs ORDER BY created_at DESC, run_hash DESC LIMIT 1", U)
def latest_run(t):
    return t.runs.agg(F.max(F.struct("created_at", "run_hash", "name")).alias("r")).select("r.run_hash", "r.name")


@query(
    "durations",
    """SELECT event_id, (json_extract_string(props, '$.k'))::bigint
              * CASE event_id % 3 WHEN 0 THEN 86400 WHEN 1 THEN 3600 ELSE 60 END AS seconds FROM events""",
)
def durations(t):
    unit = F.when(F.col("event_id") % 3 == 0, "d").when(F.col("event_id") % 3 == 1, "H").otherwise("m")
    text = F.concat(F.get_json_object("props", "$.k"), unit)
    return t.events.select("event_id", tx.duration_seconds(text).alias("seconds"))


@query(
    "runs_since",
    """SELECT run_hash FROM runs
       WHERE created_at >= timestamp '2024-03-01 00:00:00' - interval '7' day""",
    U,
)
def runs_since(t):
    return runs.since(t.runs, "7d", as_of()).select("run_hash")


@query(
    "run_keys",
    f"SELECT run_hash, substr(run_hash, 1, 8) AS hash8, {EXP} AS experiment FROM runs",
    U,
)
def run_keys(t):
    return t.runs.select(
        "run_hash",
        runs.run_key(F.col("run_hash")).alias("hash8"),
        runs.experiment_name(F.col("experiment")).alias("experiment"),
    )


@query(
    "run_filenames",
    f"""SELECT run_hash, strftime(created_at, '%Y%m%d') || '-' || {EXP} || '-' || substr(run_hash, 1, 8) || '.md'
                AS export_name,
              strftime(created_at, '%Y%m%d') || '-' || lower({EXP}) || '-' || substr(run_hash, 1, 8) || '.md'
                AS sync_name,
              '2024-03-01-' || {EXP} || '-' || substr(run_hash, 1, 8) || '.md' AS watch_name FROM runs""",
    U,
)
def run_filenames(t):
    return runs.run_filenames(t.runs, as_of())


_LAST = """last AS (SELECT run_hash, name, max_by(value, step) AS value FROM run_metrics GROUP BY ALL)"""


@query("last_metric_values", "SELECT run_hash, name, round(value, 6) AS value FROM last", M, _LAST)
def last_metric_values(t):
    return r6(runs.last_values(t.run_metrics))


@query(
    "epoch_loss",
    """SELECT run_hash, name, cast(floor((step - 1) / 5) AS bigint) AS epoch, round(avg(value), 6) AS loss,
              count(*) AS batches FROM run_metrics GROUP BY ALL""",
    M,
)
def epoch_loss(t):
    return r6(runs.epoch_loss(t.run_metrics, 5))


@query(
    "run_summaries",
    """SELECT run_hash, name, round(min(value), 6) AS best, round(max_by(value, step), 6) AS final,
              count(*) AS steps FROM run_metrics GROUP BY ALL""",
    M,
)
def run_summaries(t):
    return r6(runs.run_summary(t.run_metrics))


_BEST = """best AS (SELECT *, min(value) OVER (PARTITION BY run_hash, name ORDER BY step
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM run_metrics)"""


@query(
    "best_checkpoints",
    """SELECT run_hash, name, step, round(value, 6) AS value FROM best
       WHERE best_before IS NULL OR value < best_before""",
    M,
    _BEST,
)
def best_checkpoints(t):
    best = runs.best_so_far(t.run_metrics).where("improved")
    return r6(best.select("run_hash", "name", "step", "value"))


@query(
    "early_stops",
    """SELECT run_hash, name, min(step) FILTER (step - last_better >= 5) AS stop_step FROM (
         SELECT *, max(CASE WHEN best_before IS NULL OR value < best_before - 0.001e0 THEN step END)
                   OVER (PARTITION BY run_hash, name ORDER BY step
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_better FROM best)
       GROUP BY ALL""",
    M,
    _BEST,
)
def early_stops(t):
    return runs.early_stop(t.run_metrics)


@query(
    "loss_curves",
    """SELECT run_hash, name, step, round(value, 6) AS value FROM run_metrics WHERE contains(lower(name), 'err')""",
    M,
)
def loss_curves(t):
    return r6(runs.loss_curves(t.run_metrics, "err").select("run_hash", "name", "step", "value"))


@query("history_samples", "SELECT run_hash, name, tracked FROM run_metrics WHERE tracked % 50 = 0", M)
def history_samples(t):
    return runs.every_nth(t.run_metrics, 50, "tracked").select("run_hash", "name", "tracked")


@query("thinned_metrics", "SELECT run_hash, name, step FROM run_metrics WHERE step % 10 = 0", M)
def thinned_metrics(t):
    return runs.every_nth(t.run_metrics, 10).select("run_hash", "name", "step")


@query(
    "metric_contexts",
    """SELECT tracked, CASE WHEN name = 'view' THEN 'val' ELSE 'train' END AS subset,
              CASE WHEN name = 'view' THEN 1 WHEN name = 'click' THEN 2 ELSE 1 END AS entries FROM run_metrics""",
    M,
)
def metric_contexts(t):
    given = F.when(F.col("name") == "view", F.create_map(F.lit("subset"), F.lit("val"))).when(
        F.col("name") == "click", F.create_map(F.lit("device"), F.lit("cpu"))
    )
    context = runs.with_subset(given)
    return t.run_metrics.select(
        "tracked", context["subset"].alias("subset"), F.size(context).alias("entries")
    )


@query(
    "run_comparison",
    """SELECT u.name, substr(u.run_hash, 1, 8) AS hash8, strftime(created_at, '%Y-%m-%d %H:%M') AS created,
              cast(epochs AS string) AS epochs,
              CASE WHEN learning_rate = 0.0001e0 THEN '1.0E-4' WHEN learning_rate = 0.0002e0 THEN '2.0E-4'
                   ELSE '5.0E-4' END AS learning_rate,
              coalesce(printf('%.4f', b.best), 'N/A') AS best_loss
       FROM runs u LEFT JOIN (SELECT run_hash, min(value) AS best FROM run_metrics GROUP BY 1) b USING (run_hash)""",
    ("runs", "run_metrics"),
)
def run_comparison(t):
    return runs.compare_runs(t.runs, runs.run_summary(t.run_metrics))


@query(
    "selected_runs",
    """SELECT run_hash, name FROM runs WHERE run_hash IN (SELECT run_hash FROM run_metrics WHERE value > 400)""",
    ("runs", "run_metrics"),
)
def selected_runs(t):
    high = t.run_metrics.where(F.col("value") > 400).select("run_hash").distinct()
    return t.runs.join(high, "run_hash", "left_semi").select("run_hash", "name")


@query(
    "new_runs",
    "SELECT run_hash FROM runs WHERE run_hash NOT IN (SELECT md5(cast(user_id AS string)) FROM events)",
    U,
)
def new_runs(t):
    seen = t.events.select(F.md5(F.col("user_id").cast("string")).alias("run_hash")).distinct()
    return runs.unseen(t.runs, seen, "run_hash").select("run_hash")


_CORR_COLS = ("epochs", "learning_rate", "lora_rank", "best_loss")


@query(
    "hyperparameter_correlation",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS r FROM j"
        for a in _CORR_COLS
        for b in _CORR_COLS
    ),
    ("runs", "run_metrics"),
    """j AS (SELECT u.*, b.best_loss FROM runs u LEFT JOIN
             (SELECT run_hash, min(value) AS best_loss FROM run_metrics GROUP BY 1) b USING (run_hash))""",
)
def hyperparameter_correlation(t):
    best = runs.run_summary(t.run_metrics).groupBy("run_hash").agg(F.min("best").alias("best_loss"))
    return runs.correlations(t.runs.join(best, "run_hash", "left"), _CORR_COLS)


@query(
    "experiment_index",
    f"""SELECT name, (SELECT count(*) FROM runs) AS total FROM (
          SELECT strftime(created_at, '%Y%m%d') || '-' || {EXP} || '-' || substr(run_hash, 1, 8) AS name FROM runs)
        ORDER BY name DESC LIMIT 20""",
    U,
)
def experiment_index(t):
    names = runs.run_filenames(t.runs, as_of()).select(F.regexp_replace("export_name", r"\.md$", "").alias("name"))
    return runs.experiment_index(names)


_PARAMS = {"epochs": T.IntegerType(), "learning_rate": T.DoubleType(), "lora_rank": T.IntegerType()}


@query(
    "metric_tables",
    """SELECT run_hash, md5('| Key | Value |\n|-----|-------|\n' || string_agg('| ' || name || ' | '
              || printf('%.4f', value) || ' |', '\n' ORDER BY name)) AS table_md5 FROM last GROUP BY 1""",
    M,
    _LAST,
)
def metric_tables(t):
    entries = runs.metric_entries(runs.last_values(t.run_metrics))
    return entries.select("run_hash", F.md5(tx.markdown_table(F.col("metrics"), "*None*")).alias("table_md5"))


@query(
    "shown_values",
    """SELECT event_id, printf('%.4f', value) AS number, substr(props || props || props || props || props || props, 1, 50)
         AS text FROM events""",
)
def shown_values(t):
    long = F.concat(*["props"] * 6)
    return t.events.select(
        "event_id",
        tx.show_value(F.col("value"), T.DoubleType(), 50).alias("number"),
        tx.show_value(long, T.StringType(), 50).alias("text"),
    )


def _notes(t):
    return runs.run_notes(t.runs, runs.last_values(t.run_metrics), _PARAMS, as_of())


_NOTE_SQL = f"""SELECT '2024-03-01-' || {EXP} || '-' || substr(u.run_hash, 1, 8) || '.md' AS filename, md5(
      '---\ntype: run-summary\nrun_id: "' || substr(u.run_hash, 1, 8) || '"\nexp_id: "' || {EXP}
      || '"\ncreated: "2024-03-01"\n---\n\n# Run: ' || substr(u.run_hash, 1, 8) || '\n\n**Experiment:** ' || {EXP}
      || ' | **Created:** ' || strftime(created_at, '%Y-%m-%d %H:%M') || '\n\n## Metrics\n'
      || coalesce('| Key | Value |\n|-----|-------|\n' || m.rows, '*None*')
      || '\n\n## Parameters\n| Key | Value |\n|-----|-------|\n| epochs | ' || epochs || ' |\n| learning_rate | '
      || printf('%.4f', learning_rate) || ' |\n| lora_rank | ' || lora_rank
      || ' |\n\n## Observations\n\n## Next Steps\n- [ ]\n') AS content_md5
    FROM runs u LEFT JOIN (SELECT run_hash, string_agg('| ' || name || ' | ' || printf('%.4f', value) || ' |', '\n'
                                  ORDER BY name) AS rows FROM last GROUP BY 1) m USING (run_hash)"""


@query("run_notes", _NOTE_SQL, ("runs", "run_metrics"), _LAST)
def run_notes(t):
    return _notes(t).select("filename", F.md5("content").alias("content_md5"))


_SLUG = f"trim(regexp_replace(lower({EXP}), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '-')"


@query(
    "experiment_notes",
    f"""SELECT strftime(created_at, '%Y%m%d') || '-' || {_SLUG} || '-' || substr(run_hash, 1, 8) || '.md' AS filename, md5(
      '---\ntype: experiment\nname: "' || {EXP} || '"\nrun_hash: "' || run_hash || '"\ndate: ' || strftime(created_at, '%Y-%m-%d')
      || '\ngit:\n  commit: "' || com || '"\n  commit_short: "' || substr(com, 1, 7) || '"\n  branch: "' || coalesce(branch, 'unknown')
      || '"\n  commit_url: "' || url || com || '"\n  commit_message: "' || coalesce(message, 'unknown')
      || '"\ntags: [experiment]\n---\n\n# ' || {EXP} || '\n\n## Metrics\n'
      || coalesce('| Key | Value |\n|-----|-------|\n' || m.rows, '*None*')
      || '\n\n## Parameters\n| Key | Value |\n|-----|-------|\n| epochs | ' || epochs || ' |\n| learning_rate | '
      || printf('%.4f', learning_rate) || ' |\n| lora_rank | ' || lora_rank || ' |\n\n## Code\n[' || substr(com, 1, 7) || '](' || url || com
      || ') on ' || coalesce(branch, 'unknown') || ': ' || coalesce(message, 'unknown') || '\n'
      || CASE WHEN commit_hash IS NULL THEN 'current state' ELSE '' END || '\n') AS content_md5
    FROM (SELECT *, coalesce(commit_hash, 'HEAD') AS com, 'https://code.example.com/team/app/commit/' AS url
          FROM runs LEFT JOIN commits ON commit_hash = md5(cast(seq AS string)))
    LEFT JOIN (SELECT run_hash, string_agg('| ' || name || ' | ' || printf('%.4f', value) || ' |', '\n'
                                  ORDER BY name) AS rows FROM last GROUP BY 1) m USING (run_hash)""",
    ("runs", "run_metrics", "commits"),
    _LAST,
)
def experiment_notes(t):
    """Notes of runs with the state of their code."""
    known = t.runs.select("run_hash", F.md5(F.col("seq").cast("string")).alias("git_hash"), F.lit(None).cast("string").alias("stored_commit"))
    code = provenance.code_state(known, t.commits, "HEAD", "current state").select("run_hash", "commit", "branch", "message", "note")
    made = runs.experiment_notes(t.runs, runs.last_values(t.run_metrics), _PARAMS, code, F.lit("git@code.example.com:team/app.git"))
    return made.select("filename", F.md5("content").alias("content_md5"))


@query("written_notes", _NOTE_SQL, ("runs", "run_metrics"), _LAST)
def written_notes(t):
    """Notes written in two steps; the second finds some there already and leaves them."""
    path = shared_dir(t.spark, "notes")
    made = _notes(t)
    sinks.notes(made.where(F.contains("filename", F.lit("BUILDING"))), path)
    sinks.notes(made, path)
    back = t.spark.read.schema("filename string, content string").parquet(path)
    return back.select("filename", F.md5("content").alias("content_md5"))


@query(
    "notes_to_write",
    f"""SELECT '2024-03-01-' || {EXP} || '-' || substr(run_hash, 1, 8) || '.md' AS filename FROM runs
        WHERE run_hash NOT IN (SELECT md5(cast(user_id AS string)) FROM events)""",
    U,
)
def notes_to_write(t):
    names = runs.run_filenames(t.runs, as_of()).select("run_hash", F.col("watch_name").alias("filename"))
    tracked = t.events.select(F.md5(F.col("user_id").cast("string")).alias("run_hash")).distinct()
    existing = names.join(tracked, "run_hash", "left_semi")
    return runs.write_if_absent(names, existing).select("filename")


@query(
    "baseline_comparison",
    """SELECT u.experiment, m.name, count(m.value) AS n, round(avg(m.value), 6) AS mean,
              round(stddev_samp(m.value), 6) AS std,
              round(avg(m.value) - 1.96 * stddev_samp(m.value) / sqrt(count(m.value)), 6) AS low,
              round(avg(m.value) + 1.96 * stddev_samp(m.value) / sqrt(count(m.value)), 6) AS high,
              round(100 * (avg(m.value) - any_value(b.baseline)) / abs(any_value(b.baseline)), 6) AS improvement
       FROM last m JOIN runs u USING (run_hash)
       JOIN (SELECT m.name, avg(m.value) AS baseline FROM last m JOIN runs u USING (run_hash)
             WHERE u.experiment = 'BUILDING' GROUP BY 1) b ON b.name = m.name
       GROUP BY ALL""",
    ("runs", "run_metrics"),
    _LAST,
)
def baseline_comparison(t):
    last = runs.last_values(t.run_metrics).join(t.runs.select("run_hash", "experiment"), "run_hash")
    base = last.where(F.col("experiment") == "BUILDING").groupBy("name").agg(F.avg("value").alias("baseline"))
    keys = last.select("experiment", "name").distinct()
    return r6(runs.against_baseline(last, keys.join(base, "name"), ["experiment", "name"]))


@query(
    "weighted_losses",
    """SELECT run_hash, round(1.0 * coalesce(max(value) FILTER (name = 'click'), 0)
              + 0.5 * coalesce(max(value) FILTER (name = 'view'), 0)
              + 0.1 * coalesce(max(value) FILTER (name = 'error'), 0), 6) AS total_loss FROM last GROUP BY 1""",
    M,
    _LAST,
)
def weighted_losses(t):
    parts = {"click": 1.0, "view": 0.5, "error": 0.1}
    wide = runs.last_values(t.run_metrics).groupBy("run_hash").pivot("name", list(parts)).agg(F.max("value"))
    return r6(wide.select("run_hash", similarity.combine(parts).alias("total_loss")))


@query(
    "mean_over_measurements",
    """SELECT l_partkey AS image_id, round(avg(l_discount), 6) AS loss, count(*) AS measurements
       FROM lineitem GROUP BY 1""",
)
def mean_over_measurements(t):
    measured = t.lineitem.select(F.col("l_partkey").alias("image_id"), F.col("l_discount").alias("loss"))
    return r6(
        measured.groupBy("image_id").agg(F.avg("loss").alias("loss"), F.count("*").alias("measurements"))
    )
