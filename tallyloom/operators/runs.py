"""Tracked runs: last values, loss curves, best-so-far, comparison, correlation, notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.operators.ordered import Scan, last_improvement, prefix_scan

SERIES = ("run_hash", "name")


def run_key(run_hash: Column) -> Column:
    return F.substring(run_hash, 1, 8)


def experiment_name(experiment: Column) -> Column:
    return F.coalesce(F.nullif(experiment, F.lit("")), F.lit("default"))


def since(runs: DataFrame, duration: str, as_of: Column) -> DataFrame:
    """Runs created within a duration such as 7d before ``as_of``."""
    back = tx.duration_seconds(F.lit(duration))
    return runs.where(F.unix_micros("created_at") >= F.unix_micros(as_of) - back * 1000000)


def last_values(metrics: DataFrame) -> DataFrame:
    """The last tracked value of each metric of each run; of several at the last step, the largest."""
    return metrics.groupBy(*SERIES).agg(F.max_by("value", F.struct("step", "value")).alias("value"))


def epoch_loss(metrics: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Mean of the batch values of each epoch; steps count from 1."""
    epoch = F.floor((F.col("step") - 1) / steps_per_epoch).alias("epoch")
    return metrics.groupBy(*SERIES, epoch).agg(F.avg("value").alias("loss"), F.count("*").alias("batches"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """Best and final value of each series; of several at the last step, the largest."""
    return metrics.groupBy(*SERIES).agg(
        F.min("value").alias("best"),
        F.max_by("value", F.struct("step", "value")).alias("final"),
        F.count("*").alias("steps"),
    )


def best_so_far(metrics: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """Every step with the best earlier value and whether the step improves on it."""
    scanned = prefix_scan(metrics, SERIES, "step", {"best_before": Scan("min", F.col("value"), False)})
    better = F.col("best_before").isNull() | (F.col("value") < F.col("best_before") - min_delta)
    return scanned.withColumn("improved", better)


def early_stop(metrics: DataFrame, patience: int = 5, min_delta: float = 0.001) -> DataFrame:
    """The first step of each series with ``patience`` steps in a row without improvement.

    A step improves if it is below the lowest earlier value by more than ``min_delta``.  Series that never
    stop have NULL.  Best value and last improvement are one scan over one read of the metrics.
    """
    last = last_improvement(metrics, SERIES, "step", "value", min_delta)
    waited = F.col("step") - F.col("last_improved")
    return last.groupBy(*SERIES).agg(F.min(F.when(waited >= patience, F.col("step"))).alias("stop_step"))


def loss_curves(metrics: DataFrame, part: str = "loss") -> DataFrame:
    """The points of all series whose name contains a word."""
    return metrics.where(F.contains(F.lower("name"), F.lit(part)))


def every_nth(metrics: DataFrame, n: int, step: str = "step") -> DataFrame:
    return metrics.where(F.col(step) % n == 0)


def with_subset(context: Column, subset: str = "train") -> Column:
    """A metric context with the ``subset`` entry filled in when it is missing."""
    given = F.coalesce(context, F.create_map().cast("map<string,string>"))
    return F.when(F.map_contains_key(given, "subset"), given).otherwise(
        F.map_concat(given, F.create_map(F.lit("subset"), F.lit(subset)))
    )


def compare_runs(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """The comparison table; a missing value shows as N/A."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A")).alias(name)

    best = summaries.groupBy("run_hash").agg(F.min("best").alias("best_loss"))
    return runs.join(best, "run_hash", "left").select(
        "name",
        run_key(F.col("run_hash")).alias("hash8"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        shown("epochs"),
        shown("learning_rate"),
        F.coalesce(tx.show_value(F.col("best_loss"), T.DoubleType()), F.lit("N/A")).alias("best_loss"),
    )


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Correlation of each pair of columns over the rows where both are given, in long form."""
    pairs = list(combinations_with_replacement(columns, 2))

    def corr(a: str, b: str) -> Column:
        # a constant column has no correlation; NaN becomes NULL
        r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        return F.nullif(r, F.lit(float("nan")))

    wide = df.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        r = F.round(f"r{i}", digits).alias("r")
        cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), r))
    return wide.select(F.inline(F.array(*cells)))


def metric_entries(last: DataFrame, cut: int | None = None) -> DataFrame:
    """The last values of each run as (key, text) pairs; a run has one pair per metric name."""
    text = tx.show_value(F.col("value"), T.DoubleType(), cut)
    return last.groupBy("run_hash").agg(
        F.collect_list(F.struct(F.col("name").alias("key"), text.alias("text"))).alias("metrics")
    )


def param_entries(params: Mapping[str, T.DataType]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("key"), F.coalesce(tx.show_value(F.col(n), t), F.lit("None")).alias("text"))
            for n, t in params.items()
        ]
    )


# The layout of a run note.
RUN_NOTE = """---
type: run-summary
run_id: "{{run_id}}"
exp_id: "{{exp_id}}"
created: "{{date}}"
---

# Run: {{run_id}}

**Experiment:** {{exp_id}} | **Created:** {{created}}

## Metrics
{{metrics}}

## Parameters
{{params}}

## Observations

## Next Steps
- [ ]
"""


def run_notes(runs: DataFrame, last: DataFrame, params: Mapping[str, T.DataType], as_of: Column) -> DataFrame:
    """One markdown note per run as (filename, content)."""
    full = runs.join(metric_entries(last), "run_hash", "left")
    exp = experiment_name(F.col("experiment"))
    day = F.date_format(as_of, "yyyy-MM-dd")
    content = tx.fill_template(
        RUN_NOTE,
        {
            "run_id": run_key(F.col("run_hash")),
            "exp_id": exp,
            "date": day,
            "created": F.date_format("created_at", "yyyy-MM-dd HH:mm"),
            "metrics": tx.markdown_table(F.col("metrics"), "*None*"),
            "params": tx.markdown_table(param_entries(params), "*None*"),
        },
    )
    name = F.concat(day, F.lit("-"), exp, F.lit("-"), run_key(F.col("run_hash")), F.lit(".md"))
    return full.select(name.alias("filename"), content.alias("content"))


# The keys of an experiment note's head.
EXPERIMENT_NOTE = """---
type: experiment
name: "{{name}}"
run_hash: "{{run_hash}}"
date: {{date}}
git:
  commit: "{{commit}}"
  commit_short: "{{short}}"
  branch: "{{branch}}"
  commit_url: "{{url}}"
  commit_message: "{{message}}"
tags: [experiment]
---

# {{name}}

## Metrics
{{metrics}}

## Parameters
{{params}}

## Code
[{{short}}]({{url}}) on {{branch}}: {{message}}
{{note}}
"""


def experiment_notes(
    runs: DataFrame, last: DataFrame, params: Mapping[str, T.DataType], code: DataFrame, repository: Column
) -> DataFrame:
    """One note per run with the code it ran with, as (filename, content).

    ``code`` has run_hash, commit, branch, message and note, as ``provenance.code_state`` gives them.
    """
    full = runs.join(metric_entries(last), "run_hash", "left").join(code, "run_hash", "left")
    exp, unknown = experiment_name(F.col("experiment")), F.lit("unknown")
    content = tx.fill_template(
        EXPERIMENT_NOTE,
        {
            "name": exp,
            "run_hash": F.col("run_hash"),
            "date": F.date_format("created_at", "yyyy-MM-dd"),
            "commit": F.col("commit"),
            "short": F.substring("commit", 1, 7),
            "branch": F.coalesce("branch", unknown),
            "url": F.concat(tx.web_url(repository), F.lit("/commit/"), "commit"),
            "message": F.coalesce("message", unknown),
            "metrics": tx.markdown_table(F.col("metrics"), "*None*"),
            "params": tx.markdown_table(param_entries(params), "*None*"),
            "note": F.coalesce("note", F.lit("")),
        },
    )
    name = F.concat_ws("-", F.date_format("created_at", "yyyyMMdd"), tx.slug(exp), F.concat(run_key(F.col("run_hash")), F.lit(".md")))
    return full.select(name.alias("filename"), content.alias("content"))


def run_filenames(runs: DataFrame, as_of: Column) -> DataFrame:
    """The three note names in use: plain, with slug, and by the day of the export."""
    exp, key = experiment_name(F.col("experiment")), run_key(F.col("run_hash"))
    day = F.date_format("created_at", "yyyyMMdd")
    end = F.concat(key, F.lit(".md"))
    return runs.select(
        "run_hash",
        F.concat_ws("-", day, exp, end).alias("export_name"),
        F.concat_ws("-", day, tx.slug(exp), end).alias("sync_name"),
        F.concat_ws("-", F.date_format(as_of, "yyyy-MM-dd"), exp, end).alias("watch_name"),
    )


def write_if_absent(notes: DataFrame, existing: DataFrame) -> DataFrame:
    """Only the notes whose file name does not exist yet."""
    return notes.join(existing.select("filename"), "filename", "left_anti")


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")


def experiment_index(names: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` note names, with the total number of notes on each row."""
    total = names.agg(F.count("*")).scalar()
    return names.orderBy(F.desc("name")).limit(n).select("name", total.alias("total"))


def against_baseline(metrics: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, spread and 95 % interval over repeated runs, and the change against a baseline value.

    Documented only; the interval is the normal one.
    """
    spread = metrics.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    half = 1.96 * F.col("std") / F.sqrt("n")
    return spread.join(baseline, list(keys)).select(
        *keys,
        "n",
        "mean",
        "std",
        (F.col("mean") - half).alias("low"),
        (F.col("mean") + half).alias("high"),
        (100 * (F.col("mean") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0))).alias("improvement"),
    )


def numeric_entries(df: DataFrame, key: str, json: str) -> DataFrame:
    """The entries of a JSON object that are numbers; others cannot be tracked as metrics."""
    entries = F.from_json(F.when(F.startswith(F.ltrim(json), F.lit("{")), F.col(json)), "map<string,variant>")
    readable = df.where(F.try_parse_json(json).isNotNull())
    rows = readable.select(key, F.explode(entries).alias("key", "__v"))
    number = F.schema_of_variant("__v").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return rows.where(number).select(key, "key", F.try_variant_get("__v", "$", "double").alias("value"))
