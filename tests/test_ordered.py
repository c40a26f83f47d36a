import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered, timing
from tallyloom.operators.joins import bounded_rows, salted_join


@pytest.fixture
def skewed(spark):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else f"g{i % 10}", i * 7, rng.choice([1.0, 2.5, -3.0, rng.random() * 1e6])) for i in range(3000)]
    return pd.DataFrame(rows, columns=["g", "o", "v"]), spark.createDataFrame(rows, "g string, o long, v double")


def test_dense_position(monkeypatch, skewed):
    monkeypatch.setattr(ordered, "CHUNK", 500)
    pdf, df = skewed
    got = ordered.dense_position(df, ["g"], "o", "p").toPandas().sort_values("o")
    assert list(got["p"]) == list(pdf.groupby("g").cumcount() + 1)
    whole = ordered.dense_position(df, [], "o", "p").toPandas().sort_values("o")
    assert list(whole["p"]) == list(range(1, len(pdf) + 1))


def test_prefix_scan(monkeypatch, skewed):
    monkeypatch.setattr(ordered, "CHUNK", 333)
    pdf, df = skewed
    scans = {
        "low": ordered.Scan("min", F.col("v"), inclusive=False),
        "high": ordered.Scan("max", F.col("v")),
        "total": ordered.Scan("sum", F.col("v")),
    }
    got = ordered.prefix_scan(df, ["g"], "o", scans).toPandas().sort_values("o").reset_index(drop=True)
    g = pdf.groupby("g")["v"]
    low = g.cummin().groupby(pdf["g"]).shift(1)
    pd.testing.assert_series_equal(got["low"], low, check_names=False)
    pd.testing.assert_series_equal(got["high"], g.cummax(), check_names=False)
    np.testing.assert_allclose(got["total"], g.cumsum())


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99])
def test_pick_positions(skewed, q):
    pdf, df = skewed
    picked = ordered.pick_positions(df, ["g"], "v", {"x": F.floor(F.col("n") * q)}).toPandas()
    want = {g: sorted(v)[int(len(v) * q)] for g, v in pdf.groupby("g")["v"]}
    assert dict(zip(picked["g"], picked["v"])) == want


def test_describe_matches_pandas(skewed):
    pdf, df = skewed
    got = timing.describe(df, ["g"], "v").toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].describe()
    for mine, theirs in (("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("std", "std"), ("mean", "mean"), ("n", "count")):
        np.testing.assert_allclose(got[mine], want[theirs])


def test_single_rows_and_constants(spark):
    one = spark.createDataFrame([("a", 5.0)], "g string, v double")
    row = timing.describe(one, ["g"], "v").first()
    assert (row["n"], row["p25"], row["p75"], row["std"]) == (1, 5.0, 5.0, None)
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    bins = {r["bin"]: r["n"] for r in timing.histogram(same, "v").collect()}
    assert len(bins) == 20 and bins[10] == 4 and sum(bins.values()) == 4
    counts, _ = np.histogram([3.0] * 4, bins=20)
    assert counts[10] == 4


def test_histogram_matches_numpy(skewed):
    pdf, df = skewed
    got = [r["n"] for r in timing.histogram(df, "v").orderBy("bin").collect()]
    assert got == list(np.histogram(pdf["v"], bins=20)[0])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    large = spark.createDataFrame(
        [(("hot" if i % 3 else f"k{i}") if i % 11 else None, i) for i in range(500)], "k string, i int"
    )
    small = spark.createDataFrame([("hot", "h"), ("k3", "t"), ("k6", "s")], "k string, v string")
    got = salted_join(large, small, ["k"], F.col("i"), how, hot_rows=20)
    assert got.where(F.col("k") == "hot").select("__salt").distinct().count() > 5
    left = sorted(map(str, got.select("k", "i", "v").collect()))
    assert left == sorted(map(str, large.join(small, "k", how).select("k", "i", "v").collect()))


def test_bounded_rows(spark):
    assert len(bounded_rows(spark.range(3), 3, "numbers")) == 3
    with pytest.raises(ValueError, match="numbers"):
        bounded_rows(spark.range(4), 3, "numbers")


def test_null_groups_are_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 4)
    rows = [(None if i % 3 else "a", None if i % 2 else 0, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, h int, o long, v double")
    got = ordered.prefix_scan(df, ["g", "h"], "o", {"s": ordered.Scan("sum", "v"), "n": ordered.Scan("max", "g")}).collect()
    sums = {}
    for g, h, o, v in rows:
        sums[g, h] = sums.get((g, h), 0) + v
        match = [r for r in got if r["o"] == o]
        assert [(r["g"], r["h"], r["s"], r["n"]) for r in match] == [(g, h, sums[g, h], g)]
    picked = ordered.pick_positions(df, ["g", "h"], "v", {"last": F.col("n") - 1}).collect()
    assert {(r["g"], r["h"]): r["v"] for r in picked} == {(g, h): max(v for a, b, _, v in rows if (a, b) == (g, h)) for g, h in sums}


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_positions_of_any_key(spark, kind):
    rng = random.Random(4)
    names = ["hot"] * 700 + [None] * 50 + [f"k{i}" for i in range(50)]
    keys = rng.sample(range(100_000), 800)
    rows = [(g, f"{k:06d}" + "x" * (k % 3), k) for g, k in zip(names, keys, strict=True)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t string, k long")
    order = {"string": F.col("t"), "double": F.col("k") / 7, "date": F.date_add(F.lit("1900-01-01").cast("date"), F.col("k").cast("int"))}
    df = df.withColumn("o", order[kind])
    whole = ordered.positions(df, ["o"], "p").orderBy("p").collect()
    assert [r["p"] for r in whole] == list(range(1, 801)) and [r["k"] for r in whole] == sorted(keys)
    grouped = ordered.positions(df, ["o"], "p", ["g"]).collect()
    for g in ("hot", None, "k7"):
        mine = sorted((r["p"], r["k"]) for r in grouped if r["g"] == g)
        assert mine == list(enumerate(sorted(k for n, k in zip(names, keys, strict=True) if n == g), 1))
    assert ordered.positions(df.where("false"), ["o"], "p", ["g"]).count() == 0


def test_nested_chunks(spark):
    rng = random.Random(6)
    values = [rng.choice([0.5, 0.5 + rng.random() * 1e-9, -rng.random(), rng.random() * 1e9, -0.0]) for _ in range(900)]
    values = sorted(set(values))
    df = spark.createDataFrame([("a" if i % 2 else None, v, i) for i, v in enumerate(values)], "g string, v double, i long")
    chunks = ordered.radix_chunks("v", df.schema["v"].dataType)
    got = ordered.prefix_scan(df, [], "v", {"n": ordered.Scan("sum", F.lit(1)), "low": ordered.Scan("min", "i", False)}, chunks)
    assert [(r["n"], r["low"]) for r in got.orderBy("v").collect()] == [(n, 0 if n > 1 else None) for n in range(1, len(values) + 1)]


@pytest.mark.parametrize("kind", ["double", "float", "int", "bigint", "decimal(12,2)", "timestamp", "date"])
def test_exact_order_statistics(spark, kind):
    """A third of the rows lies in a thousandth of the range, and some values are extreme."""
    rng = random.Random(8)
    hot = [500 + rng.randrange(100) / 100 for _ in range(1000)]
    rows = [("all" if i % 4 else "few", v) for i, v in enumerate(hot + [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [0.0, -0.0, 1e7, -1e7])]
    df = spark.createDataFrame(rows, "g string, v double")
    number = F.timestamp_micros((F.col("v") * 1e6).cast("long")) if kind == "timestamp" else F.date_from_unix_date((F.col("v") % 20000).cast("int")) if kind == "date" else F.col("v").cast(kind)
    df = df.select("g", number.alias("v"))
    wanted = {f"q{q}": F.floor((F.col("n") - 1) * (q / 20)) for q in range(21)}
    got = {(r["g"], r["label"]): r["v"] for r in ordered.pick_positions(df, ["g"], "v", wanted).collect()}
    for g in ("all", "few"):
        values = sorted(r["v"] for r in df.where(F.col("g") == g).collect())
        assert [got[g, f"q{q}"] for q in range(21)] == [values[int((len(values) - 1) * (q / 20))] for q in range(21)]


def test_order_statistics_plan_without_a_job(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    ordered.pick_positions(df, ["g"], "v", {"m": F.floor(F.col("n") / 2)}).explain()
    timing.describe(df, ["g"], "v").explain()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


@pytest.mark.parametrize("chunk,delta", [(1 << 22, 0.0), (5, 0.0), (3, 0.25), (1, 0.1)])
def test_last_improvement(spark, monkeypatch, chunk, delta):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rng = random.Random(2)
    rows = []
    for g in (None, "a", "b", "c"):
        level = 10.0
        for step in range(rng.choice([1, 40, 90])):
            level -= rng.choice([0, 0, 0.05, 0.3])
            rows.append((g, step * 2, rng.choice([None, level, level + rng.random()])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v double")
    got = {(r["g"], r["o"]): (r["best_before"], r["improved"], r["last_improved"]) for r in ordered.last_improvement(df, ["g"], "o", "v", delta).collect()}
    for g in (None, "a", "b", "c"):
        best, last = None, None
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            better = v is not None and (best is None or v < best - delta)
            last = o if better else last
            assert got[g, o] == (best, better, last)
            best = v if best is None else best if v is None else min(best, v)
