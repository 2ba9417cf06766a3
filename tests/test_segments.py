"""Scans cut into ranges give what the plain window gives, and spread one key over many tasks."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnwatch.operators import calibration as C
from tarnwatch.operators import joins, segments, tails
from tarnwatch.operators import timeseries as T


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", int(3 * i + i % 2), float(v), int(f)) for i, (v, f) in enumerate(zip(rng.normal(size=900), rng.random(900) < 0.2))]
    rows += [(None, i, float(i % 5), i % 2) for i in range(40)] + [("one", 7, 1.5, 1)]
    df = spark.createDataFrame([(k, i, v if f or i % 4 else None, f) for k, i, v, f in rows], "k string, i long, v double, f int")
    return df.repartition(3).persist()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


FEW = 64
SCANS = {
    "row_windows": lambda df, n: T.row_windows(df, ["k"], "i", 10, rows=n),
    "forward_fill": lambda df, n: T.forward_fill(df, ["k"], "i", ["v"], 3, rows=n),
    "interpolate": lambda df, n: T.interpolate(df, ["k"], "i", "v", rows=n),
    "hampel": lambda df, n: T.hampel(df.filter("v IS NOT NULL"), ["k"], "i", "v", rows=n),
    "cusum": lambda df, n: T.cusum(df, ["k"], "i", "v", limit=2.0, rows=n),
    "episodes": lambda df, n: T.episodes(df.filter("f = 1").withColumn("ts", F.timestamp_seconds("i")), ["k"], "ts", 9, rows=n),
    "runs": lambda df, n: T.runs(df, ["k"], "i", "f", 1, rows=n),
    "dilate": lambda df, n: T.dilate(df, ["k"], "i", "f", 2, rows=n),
    "flip_rate": lambda df, n: T.flip_rate(df, ["k"], "i", "f", rows=n),
    "effective_n": lambda df, n: T.effective_n(df, ["k"], "i", "v", 4, rows=n),
    "unit_root": lambda df, n: T.unit_root(df, ["k"], "i", "v", rows=n),
    "mase": lambda df, n: T.mase(df.withColumn("h", F.lit(0.1)), ["k"], "i", "v", "h", rows=n),
    "decluster": lambda df, n: tails.decluster(df.filter("f = 1"), ["k"], "i", "v", 6, rows=n),
    "expanding_r2": lambda df, n: C.expanding_r2(df.withColumn("x", F.col("i").cast("double")), ["k"], "i", "x", "v", rows=n),
}


@pytest.mark.parametrize("name", SCANS)
def test_ranges_give_the_plain_window(series, name):
    plain, cut = SCANS[name](series, 10**9), SCANS[name](series, FEW)
    same = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in plain.dtypes]
    assert plain.columns == cut.columns and rows(plain, *same) == rows(cut, *same)


def test_nearest_rows_over_ranges(spark, series):
    left = series.filter("f = 1").select("k", F.timestamp_seconds("i").alias("ts"))
    right = series.filter("f = 0").select("k", F.timestamp_seconds(F.col("i") + 1).alias("ts"), "v")
    a, b = (joins.asof_nearest(left, right, ["k"], "ts", ["v"], 5, rows=n) for n in (10**9, FEW))
    assert rows(a, "*") == rows(b, "*")


def test_sums_lows_and_known_values_over_ranges(series):
    for n in (FEW, 10**9):
        out = segments.summed(series.filter("v IS NOT NULL"), ["k"], "i", {"s": F.col("v")}, lows=True, rows=n).collect()
        by = {}
        for r in sorted(out, key=lambda r: r.i):
            s, low = by.get(r.k, (0.0, float("inf")))
            s += r.v
            by[r.k] = (s, min(low, s))
            assert abs(r.s - by[r.k][0]) < 1e-9 and abs(r.s_low - by[r.k][1]) < 1e-9
    for ahead in (False, True):
        a, b = (segments.known(series, ["k"], "i", {"x": F.col("v")}, ahead, rows=n) for n in (10**9, FEW))
        assert rows(a, "k", "i", "x") == rows(b, "k", "i", "x")


def test_no_keys_and_no_rows(series):
    one = series.filter("k = 'hot'")
    a, b = (segments.numbered(one, [], "i", rows=n) for n in (10**9, FEW))
    assert rows(a, "i", "_pos") == rows(b, "i", "_pos")
    assert segments.numbered(one.limit(0), ["k"], "i", rows=FEW).count() == 0
    assert segments.framed(one.limit(0), [], "i", 1, 1, lambda w: {"x": F.lag("v").over(w)}, rows=FEW).count() == 0


def test_one_key_of_ten_million_rows_is_spread_over_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(10_000_000).select(F.lit("hot").alias("k"), "id", (F.col("id") % 7).cast("double").alias("v"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut = segments.segmented(df, ["k"], "id", 100_000)
        sizes = cut.repartition(4 * parts, "k", "_seg").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) >= 4 * parts - 2 and max(r["count"] for r in sizes) < 0.4 * 10_000_000
        n = segments.numbered(df, ["k"], "id", rows=100_000)
        assert n.filter(F.col("_pos") != F.col("id")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_plain_window_is_used_for_short_keys(series):
    plan = segments.numbered(series, ["k"], "i", rows=10**6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and "Join" not in plan

