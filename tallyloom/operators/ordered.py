"""Ordered work over groups of any size: positions, prefix scans, exact order statistics.

A window over a whole group puts that group in one task, which fails when one group holds a large
share of the rows.  The functions here cut a group into chunks along its order key, work inside
the chunks with ordinary windows, and carry totals from chunk to chunk through a small table with
one row per (group, chunk).  A null in a group column is a group of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import shared_dir

# Rows per chunk for integer order keys that are unique inside their group.
CHUNK = 1 << 22
# Bits that one level of a radix selection tells apart; three levels tell all 64 apart.
RADIX_BITS = (22, 21, 21)


def integer_chunk(order: str) -> Column:
    """Chunk of a unique integer key: no chunk of a group can hold more than ``CHUNK`` rows."""
    return F.floor(F.col(order) / F.lit(CHUNK))


def ordered_bits(value: str, kind: T.DataType) -> Column:
    """A 64-bit integer that orders as the values of a numeric column do."""
    col = F.col(value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (col * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # adding 0 makes one zero of the two; the sign bit orders the rest
        plain = col.cast("double") + F.lit(0.0)
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
        return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    raise ValueError(f"column {value} of type {kind.simpleString()} has no 64-bit order")


def radix_chunks(value: str, kind: T.DataType) -> list[Column]:
    """Nested chunks of a numeric key: the first bits of its order, then all but the last, …"""
    bits, left, out = ordered_bits(value, kind), 64, []
    for width in RADIX_BITS[:-1]:
        left -= width
        out.append(F.shiftright(bits, left))
    return out


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, min or max; exclusive leaves the current row out.

    ``value`` is a column name or an expression.
    """

    kind: str
    value: Column | str
    inclusive: bool = True


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.least(carried, local) if kind == "min" else F.greatest(carried, local)


def _stand_in(kind: T.DataType) -> Column:
    """Some value of a type, to stand for null in a key."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    raise ValueError(f"group column of type {kind.simpleString()}")


def _without_nulls(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Group columns as join keys: nulls replaced and told apart by ``__nulls``; how to get them back."""
    open_ = [f for f in df.schema.fields if f.name in group and f.nullable]
    if not open_:
        return df, list(group), {}
    mask, back = F.lit(0), {}
    for i, f in enumerate(open_):
        mask = mask + F.when(F.col(f.name).isNull(), 1 << i).otherwise(0)
        back[f.name] = F.when(F.col("__nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(f.name))
    rows = df.withColumn("__nulls", mask).withColumns({f.name: F.coalesce(f.name, _stand_in(f.dataType)) for f in open_})
    return rows, [*group, "__nulls"], back


def _carried(totals: DataFrame, group: list[str], cuts: list[str], kinds: Mapping[str, str]) -> DataFrame:
    """What each chunk gets from the chunks before it: nested chunks get the sum of all levels."""
    before = W.partitionBy(*group, *cuts[:-1]).orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    fine = totals.select(
        *group, *cuts, *[_FOLD[kind](f"__total_{n}").over(before).alias(f"__carry_{n}") for n, kind in kinds.items()]
    )
    if len(cuts) == 1:
        return fine
    keys = [*group, *cuts[:-1]]
    coarse = totals.groupBy(*keys).agg(
        *[_FOLD[kind](f"__total_{n}").alias(f"__total_{n}") for n, kind in kinds.items()], F.min("__start").alias("__start")
    )
    above = _carried(coarse, group, cuts[:-1], kinds)
    both = fine.join(above.withColumnsRenamed({f"__carry_{n}": f"__above_{n}" for n in kinds}), on=keys)
    merged = [_merge(kind, F.col(f"__above_{n}"), F.col(f"__carry_{n}")).alias(f"__carry_{n}") for n, kind in kinds.items()]
    return both.select(*group, *cuts, *merged)


def prefix_scan(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    scans: Mapping[str, Scan],
    chunk: Column | Sequence[Column] | None = None,
    costly: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Running sums, minima and maxima along ``order`` in each group.

    ``order`` must be unique in its group.  ``chunk`` must never fall as ``order`` rises; by default it is
    the integer chunk of ``order``.  A list of chunks is nested: each cuts the chunks of the one before.

    The rows are needed twice, for the chunk totals and for the windows.  By default the totals are
    added up where the rows lie, from a second, narrow read of the input.  With ``costly`` the rows
    are made and moved once and both uses share that one exchange: right when making a row is dear,
    and when ``df`` has no more columns than the group, the order and the scanned columns.  That exchange
    then has ``parts`` partitions if they are given.
    """
    given = [integer_chunk(order)] if chunk is None else [chunk] if isinstance(chunk, Column) else list(chunk)
    cuts = [f"__chunk{i}" if i else "__chunk" for i in range(len(given))]
    inputs = {n: s.value if isinstance(s.value, str) else f"__in_{n}" for n, s in scans.items()}
    # a scanned group column would lose its nulls
    inputs = {n: f"__in_{n}" if c in group else c for n, c in inputs.items()}
    extra = {c: F.col(s.value) if isinstance(s.value, str) else s.value for (n, s) in scans.items() if (c := inputs[n]).startswith("__in_")}
    zero = F.lit(0).cast("long")
    rows = df.withColumns(extra | {c: F.coalesce(cut.cast("long"), zero) for c, cut in zip(cuts, given, strict=True)})
    rows, own, back = _without_nulls(rows, group)
    keys = [*own, *cuts]
    if costly:
        rows = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)

    totals = rows.groupBy(*keys).agg(
        *[_FOLD[s.kind](inputs[n]).alias(f"__total_{n}") for n, s in scans.items()],
        F.min(order).alias("__start"),  # both uses read the same columns, so they share the exchange
    )
    carried = _carried(totals, own, cuts, {n: s.kind for n, s in scans.items()})
    inside = W.partitionBy(*keys).orderBy(order)
    out = rows.join(carried, on=keys)
    values = {}
    for name, scan in scans.items():
        frame = inside.rowsBetween(W.unboundedPreceding, 0 if scan.inclusive else -1)
        local = _FOLD[scan.kind](inputs[name]).over(frame)
        values[name] = _merge(scan.kind, F.col(f"__carry_{name}"), local)
    return out.withColumns(values).withColumns(back).select(*df.columns, *scans)


def dense_position(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    name: str = "position",
    chunk: Column | None = None,
    costly: bool = False,
) -> DataFrame:
    """Number the rows of each group 1, 2, 3, … along a unique integer order key."""
    return prefix_scan(df, group, order, {name: Scan("sum", F.lit(1).cast("long"))}, chunk, costly)


def positions(df: DataFrame, order: Sequence[str], name: str = "position", group: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group 1, 2, 3, … along keys of any type that can be sorted.

    The rows are dealt out by ranges of (group, order), sorted inside each range and written with their
    rank in it; what comes before a range is the sum of the earlier ranges' counts, one row per range.
    A hot range gets more partitions by Spark's sampling, and no window sees more than one row per range.
    Rows that agree in all keys are numbered in any order.
    """
    spark, keys = df.sparkSession, [F.col(f"`{c}`") for c in (*group, *order)]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rank = 1 << 33
    path = shared_dir(spark, "positions")
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the id is the partition's number and, in its lower 33 bits, the row's rank in the partition
    dealt.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__row", T.LongType())])).parquet(path)
    rows = rows.withColumns({"__part": F.shiftright("__row", 33), "__row": F.col("__row").bitwiseAND(F.lit(rank - 1))})
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # at most one row per shuffle partition
    placed = rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row") + 1)
    if not group:
        return placed.select(*df.columns, name)
    placed, own, back = _without_nulls(placed, group)
    firsts = placed.groupBy(*own).agg(F.min(name).alias("__first"))
    out = placed.join(firsts, on=own).withColumn(name, F.col(name) - F.col("__first") + 1)
    return out.withColumns(back).select(*df.columns, name)


def last_improvement(
    df: DataFrame, group: Sequence[str], order: str, value: str, min_delta: float = 0.0, chunk: Column | None = None
) -> DataFrame:
    """``df`` with best_before, improved and last_improved along ``order`` in each group, in one scan.

    A row improves if its value is below the lowest earlier value by more than ``min_delta``;
    last_improved is the order key of the latest row that does, the row itself included.  A null value
    neither improves nor counts as best.

    The state of a stretch of rows is its lowest value and its last improvement, as the stretch by itself
    sees it.  Improvements of a stretch have falling values, so behind another stretch its last one is the
    last that still improves, or none does: states can be merged, and chunks pass theirs on as totals do.
    """
    cut = integer_chunk(order) if chunk is None else chunk
    rows = df.select(*df.columns, F.coalesce(cut.cast("long"), F.lit(0).cast("long")).alias("__chunk"))
    rows, own, back = _without_nulls(rows, group)
    keys = [*own, "__chunk"]
    rows = rows.repartition(*keys)

    def better(best: Column, new: Column) -> Column:
        return new.isNotNull() & (best.isNull() | (new < best - min_delta))

    here = W.partitionBy(*keys).orderBy(order)
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    event = F.struct(F.col(order).alias("at"), F.col(value).alias("value"))
    marked = rows.withColumn("__low", F.min(value).over(here.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "__event", F.when(better(F.col("__low"), F.col(value)), event)
    )
    states = marked.groupBy(*keys).agg(F.min(value).alias("__min"), F.max("__event").alias("__last"), F.min(order).alias("__start"))
    before = W.partitionBy(*own).orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    states = states.withColumn("__best", F.min("__min").over(before))
    passed = F.when(better(F.col("__best"), F.col("__last.value")), F.col("__last.at"))
    states = states.withColumn("__passed", passed).withColumn("__carried", F.max("__passed").over(before))
    out = marked.join(states.select(*keys, "__best", "__carried"), on=keys).withColumn("__last", F.max("__event").over(so_far))
    best = F.least("__best", "__low")
    last = F.when(better(F.col("__best"), F.col("__last.value")), F.col("__last.at")).otherwise(F.col("__carried"))
    values = {"best_before": best, "improved": better(best, F.col(value)), "last_improved": last}
    return out.withColumns(values).withColumns(back).select(*df.columns, *values)


def pick_positions(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, Column],
) -> DataFrame:
    """The exact values at given 0-based positions of each sorted group, as (group, label, value).

    ``wanted`` maps a label to a position expression over ``n``, the row count of the group.

    Radix selection on the order-preserving bits of the value: counts by the first bits tell in which
    stretch of values a wanted position lies, and only those stretches are counted by further bits, until
    single values are left.  Nothing but counts moves, no group is sorted, and a stretch never has more
    than 2 ** 22 parts, however the values are spread.
    """
    given = df.where(F.col(value).isNotNull()).select(*group, value)
    given, keys, back = _without_nulls(given, group)
    rows = given.withColumn("__bits", ordered_bits(value, df.schema[value].dataType))
    labels = [F.struct(F.lit(label).alias("label"), at.cast("long").alias("at")) for label, at in wanted.items()]
    left, targets, above = 64, None, None
    for level, width in enumerate(RADIX_BITS):
        left -= width
        part = f"__p{level}"
        rows = rows.withColumn(part, F.shiftright("__bits", left))
        inside = [*keys, above] if above else list(keys)
        counted = rows
        if above:
            counted = rows.join(targets.select(*inside).distinct(), on=inside, how="left_semi")
        counts = counted.groupBy(*inside, part).agg(F.count("*").alias("__rows"), F.first(value).alias(value))
        along = W.partitionBy(*inside).orderBy(part)
        spans = counts.withColumn("__upto", F.sum("__rows").over(along.rowsBetween(W.unboundedPreceding, 0)))
        if above:
            met = spans.join(targets, on=inside)
        else:
            total = spans.withColumn("n", F.sum("__rows").over(W.partitionBy(*inside)))
            met = total.withColumn("__want", F.explode(F.array(*labels))).select("*", "__want.label", "__want.at").drop("__want")
        start = F.col("__upto") - F.col("__rows")
        hit = met.where((F.col("at") >= start) & (F.col("at") < F.col("__upto")))
        targets = hit.select(*keys, part, "label", (F.col("at") - start).alias("at"), value)
        if level + 1 < len(RADIX_BITS):
            targets = targets.drop(value)
        above = part
    return targets.withColumns(back).select(*group, "label", value)
