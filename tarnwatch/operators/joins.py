"""Joins by time: nearest row, intervals, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros, seconds
from .segments import SEGMENT, exceeds, known

#: An interval table up to this many rows is broadcast; a larger one is cut at bucket borders.
BROADCAST_ROWS = 10_000
#: Starts of one bucket that meet its spans in one task.
MEET = 500


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], tolerance_seconds: float, rows: int = SEGMENT) -> DataFrame:
    """left with values of the right row nearest in time within the tolerance; of two equally
    near, the earlier. Both sides run through the same order, in ranges where a key is long."""
    at = micros(ts)
    a = left.select(F.struct(*left.columns).alias("_row"), *by, at.alias("_t"), F.lit(1).alias("_side"))
    b = right.select(*by, at.alias("_t"), F.lit(0).alias("_side"), F.struct(at.alias("at"), *values).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    if exceeds(both, by, rows):
        both = known(both, by, "_t", {"_before": F.col("_hit")}, ties=["_side"], rows=rows)
        both = known(both, by, "_t", {"_after": F.col("_hit")}, ahead=True, ties=["_side"], rows=rows)
    else:
        order = Window.partitionBy(*by).orderBy("_t", "_side")
        both = both.withColumn("_before", F.last("_hit", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        both = both.withColumn("_after", F.first("_hit", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = both.filter("_side = 1")
    d0, d1 = F.col("_t") - F.col("_before.at"), F.col("_after.at") - F.col("_t")
    pick = F.when(d1.isNull() | (d0 <= d1), F.col("_before")).otherwise(F.col("_after"))
    out = out.withColumn("_pick", pick)
    near = F.abs(F.col("_pick.at") - F.col("_t")) <= tolerance_seconds * 1e6
    return out.select("_row.*", *[F.when(near, F.col(f"_pick.{v}")).alias(v) for v in values], near.alias("matched")).withColumn("matched", F.coalesce("matched", F.lit(False)))


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (which are counted), else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def started_inside(spans: DataFrame, points: DataFrame, span: tuple[str, str], point: tuple[str, str], rule: Column) -> DataFrame:
    """Rows of spans and points that overlap and fulfil the rule, which holds only where the point's
    start isn't before the span's: so a pair meets once, in the bucket of the later start.

    Buckets are a quarter of the mean span long, so a span lies in about five. Those with more than
    MEET points are cut into parts, and each part meets all spans of the bucket in one task."""
    length = F.greatest(seconds(span[1]) - seconds(span[0]), F.lit(0))
    width = max(1, int((spans.agg(F.avg(length)).first()[0] or 0) / 4))
    bucket = lambda c: F.floor(seconds(c) / width)
    placed = points.withColumn("_bucket", bucket(point[0]))
    parts = placed.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("_parts"))
    dealt = placed.join(parts, "_bucket").withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int")).drop("_parts")
    cut = spans.withColumn("_bucket", F.explode(F.sequence(bucket(span[0]), F.greatest(bucket(span[0]), bucket(span[1])))))
    cut = cut.join(parts, "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # Few bytes may give very many pairs: a number of tasks of its own, and no side is broadcast, which
    # would leave the other in the few tasks that it is read by.
    cut = cut.repartition(16 * cut.sparkSession.sparkContext.defaultParallelism, "_bucket", "_part")
    both = (F.col(point[0]) < F.col(span[1])) & (F.col(span[0]) < F.col(point[1]))
    met = cut.join(dealt.withColumnsRenamed({"_bucket": "_bucket_of", "_part": "_part_of"}).hint("merge"), (F.col("_bucket") == F.col("_bucket_of")) & (F.col("_part") == F.col("_part_of")) & both & rule)
    return met.drop("_bucket", "_part", "_bucket_of", "_part_of")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Rows of a and b whose spans overlap. A small b is broadcast; else each pair meets at its
    later start."""
    if b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return a.join(F.broadcast(b), (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])))
    later = started_inside(a, b, a_span, b_span, F.col(b_span[0]) >= F.col(a_span[0]))
    return later.unionByName(started_inside(b, a, b_span, a_span, F.col(a_span[0]) > F.col(b_span[0])))


def inside(ts: Column, start: Column, end: Column, closed: bool = False) -> Column:
    return (ts >= start) & ((ts <= end) if closed else (ts < end))


def interval_join(df: DataFrame, ts: str, intervals: DataFrame, columns: Sequence[str], how: str = "inner", closed: bool = False, bucket_seconds: int = 3600) -> DataFrame:
    """df joined to the intervals (start, end, columns) that hold its time.

    A small interval table is broadcast (its rows are counted first). A larger one is cut at
    bucket borders, so that both sides meet in an equality join on the bucket."""
    small = intervals.select("start", "end", *columns)
    rule = inside(F.col(ts), F.col("start"), F.col("end"), closed)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(small), rule, how)
        return joined if how in ("left_semi", "left_anti") else joined.drop("start", "end")
    bucket = lambda c: F.floor(seconds(c) / bucket_seconds)
    cut = small.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    keyed = df.withColumn("_bucket_of", bucket(F.col(ts)))
    joined = keyed.join(cut, (F.col("_bucket_of") == F.col("_bucket")) & rule, how)
    return joined.drop("_bucket", "_bucket_of", *(() if how in ("left_semi", "left_anti") else ("start", "end")))


def interval_label(df: DataFrame, ts: str, intervals: DataFrame, name: str = "label", closed: bool = False) -> DataFrame:
    """df with 1 where any interval holds the row, else 0. Overlapping intervals are merged
    first, so that a row never meets two."""
    order = Window.orderBy("start", "end")
    # The catalog alone is ordered as one; it is a table of events, not of readings.
    marked = intervals.select("start", "end").withColumn("_far", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_run", F.sum(F.coalesce((F.col("start") > F.col("_far")).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("_hit", F.lit(1))
    return interval_join(df, ts, merged, ["_hit"], "left", closed).withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def _back(rows: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """rows, repeated ones too, with the columns of found (one row for each distinct keys)."""
    right = found.select(*[F.col(k).alias(f"_{k}_key") for k in keys], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_key"))
    return rows.join(right, same, "left").drop(*[f"_{k}_key" for k in keys])


def first_period(df: DataFrame, ts: str, periods: DataFrame) -> DataFrame:
    """df with period: the name of the first period (by idx) that holds the row, else null."""
    joined = interval_join(df.select(ts).distinct(), ts, periods, ["idx", "name"], "left", closed=True)
    return _back(df, [ts], joined.groupBy(ts).agg(F.min_by("name", "idx").alias("period")))


def best_overlap(episodes: DataFrame, periods: DataFrame) -> DataFrame:
    """episodes (episode, start, end) with period and iou: the period of the largest overlap
    over union, the first of equals; iou 0 and null without any overlap."""
    p = periods.select("idx", F.col("name").alias("period"), F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    span = lambda a, b: (micros(b) - micros(a)) / 1e6
    joined = overlap_join(episodes.select("start", "end").distinct(), p, ("start", "end"), ("_ps", "_pe"))
    both = span(F.greatest("start", "_ps"), F.least("end", "_pe"))
    union = span(F.least("start", "_ps"), F.greatest("end", "_pe"))
    joined = joined.withColumn("_iou", F.coalesce(F.try_divide(both, union), F.lit(0.0)))
    best = F.max_by(F.struct("period", "_iou"), F.struct(F.col("_iou"), -F.col("idx")))
    found = joined.groupBy("start", "end").agg(best.alias("_b")).select("start", "end", F.col("_b.period").alias("period"), F.coalesce("_b._iou", F.lit(0.0)).alias("iou"))
    return _back(episodes, ["start", "end"], found).withColumn("iou", F.coalesce("iou", F.lit(0.0)))
