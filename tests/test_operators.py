import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import calendar
from tarnwatch.operators import attribution, joins, metrics, tails, timeseries
from tarnwatch.sources import profiles

T0 = dt.datetime(2025, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_forward_fill_stops_at_the_limit(spark):
    xs = [1.0, *[None] * 6, 8.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    fill = lambda n: [r.x for r in timeseries.forward_fill(df, ["k"], "i", ["x"], n).orderBy("i").collect()]
    assert fill(2) == [1.0, 1.0, 1.0, None, None, None, None, 8.0] and fill(0) == xs


def test_interpolation_by_position(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])], "k string, i int, x double")
    assert [r.x for r in timeseries.interpolate(df, ["k"], "i", "x").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_spine_has_every_window(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("b", at(20), 2)], "k string, w timestamp, n int")
    out = timeseries.fill_windows(df, ["k"], "w", 600, ["n"]).collect()
    assert len(out) == 6 and sum(r.n for r in out) == 3


def test_episodes_and_runs(spark):
    df = spark.createDataFrame([("a", at(m)) for m in (0, 15, 31, 40)], "k string, ts timestamp")
    assert [r.episode for r in timeseries.episodes(df, ["k"], "ts", 900).orderBy("ts").collect()] == [0, 0, 1, 1]
    flags = spark.createDataFrame([("a", i, y) for i, y in enumerate([0, 1, 1, 0, 0, 1, 0])], "k string, i int, y int")
    assert sorted((r.run_start, r.run_end) for r in timeseries.runs(flags, ["k"], "i", "y").collect()) == [(1, 2), (5, 5)]


def test_nearest_join_prefers_the_earlier_and_keeps_the_tolerance(spark):
    left = spark.createDataFrame([("a", at(m)) for m in (10, 30, 90)] + [("b", at(0))], "k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 1), ("a", at(15), 2), ("a", at(33), 3)], "k string, ts timestamp, v int")
    got = {(r.k, r.ts): (r.v, r.matched) for r in joins.asof_nearest(left, right, ["k"], "ts", ["v"], 300).collect()}
    assert got == {("a", at(10)): (1, True), ("a", at(30)): (3, True), ("a", at(90)): (None, False), ("b", at(0)): (None, False)}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_interval_join_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(i, at(i)) for i in range(0, 300, 7)], "i int, ts timestamp")
    cat = spark.createDataFrame([(at(14), at(70)), (at(49), at(140)), (at(200), at(210))], "start timestamp, end timestamp")
    got = {r.i: r.label for r in joins.interval_label(df, "ts", cat).collect()}
    assert got == {i: int(14 <= i < 140 or 200 <= i < 210) for i in range(0, 300, 7)}
    assert joins.interval_join(df, "ts", cat, [], "left_anti").count() == sum(1 for v in got.values() if not v)


def test_confusion_of_the_worked_example(spark):
    y = [int(10 <= i < 20) for i in range(100)]
    p = [int(11 <= i < 16 or i == 30) for i in range(100)]
    row = metrics.with_rates(spark.createDataFrame(list(zip(y, p)), "y int, p int").agg(*metrics.confusion(F.col("y"), F.col("p")))).first()
    assert (row.tp, row.fn, row.fp, row.tn) == (5, 5, 1, 89)
    assert (row.fpr, row.f1, row.mcc, row.precision) == pytest.approx((0.011111, 0.625, 0.617578, 0.833333), abs=1e-6)
    ci = spark.range(1).select(*metrics.wilson(F.lit(10.0), F.lit(100.0)), *metrics.agresti_coull(F.lit(10.0), F.lit(100.0))).first()
    assert tuple(ci) == pytest.approx((0.055229, 0.174366, 0.053485, 0.176110), abs=1e-6)


@pytest.mark.parametrize(("scores", "target", "want"), [([0.1, 0.2, 0.3, 0.4, 0.9], 0.21, 0.9), ([1, 2, 3, 4], 0.26, 4), ([1, 2, 9, 9, 9], 0.2, None)])
def test_threshold_never_passes_its_target(spark, scores, target, want):
    t = metrics.threshold_at_most(spark.createDataFrame([(float(s),) for s in scores], "s double"), "s", target).first()[0]
    assert t == want if want else t > 9


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.625)
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None


def test_pareto_fits(spark):
    row = tails.pwm_fit(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 5, 9)], "k string, x double"), ["k"], "x").first()
    assert (row.a0, row.a1) == pytest.approx((4, 1.12)) and abs(row.xi) < 1
    x = np.random.default_rng(1).exponential(2.0, 4000)
    xi, sigma = tails.likelihood_fit(x)
    assert abs(xi) < 0.06 and abs(sigma - 2) < 0.15
    u = np.random.default_rng(2).random(6000)
    xi, sigma = tails.likelihood_fit(3.0 / 0.4 * ((1 - u) ** -0.4 - 1))
    assert abs(xi - 0.4) < 0.08 and abs(sigma - 3) < 0.3


def test_ramp(spark):
    df = spark.range(1, 11).select(attribution.ramp(F.col("id"), F.lit(10), F.lit(0.3)).alias("w"), "id").orderBy("id")
    assert [r.w for r in df.collect()] == pytest.approx([1 / 3, 2 / 3, 1, 1, 1, 1, 1, 1, 2 / 3, 1 / 3])


def test_calendar(spark):
    rows = [("2025-11-17 12:30:00",), ("2025-11-15 12:30:00",), ("2025-11-17 18:00:00",), ("2025-11-17 08:00:00",), ("2025-11-18 09:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(calendar.regime_of(F.col("t").cast("timestamp"), ["2025-11-18"]).alias("r"))
    assert [r.r for r in df.collect()] == ["ACTIVE", "QUIET", "QUIET", "ACTIVE", "QUIET"]
    names = spark.createDataFrame([("network_outage_R2", "x"), (None, "NETWORK_OUTAGE_EAST"), ("outage", None)], "a string, b string")
    assert [r[0] for r in names.select(calendar.outage(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert names.select(calendar.family(F.col("a")), calendar.occurrence(F.col("a"))).first()[:] == ("network_outage", 2)


def test_profiles(spark):
    raw = spark.createDataFrame([("2025-01-01 00:00:00", "1.5", "3"), ("2025-01-01 00:00:30", "bad", "4")], "timestamp string, bytes string, packets string")
    rows = profiles.network(raw).collect()
    assert [(r.bytes, r.packets, r.label) for r in rows] == [(1.5, 3.0, 0), (None, 4.0, 0)]
    water = profiles.water(spark.createDataFrame([("2025-01-01 00:00:00", "TRUE", "1.0"), ("2025-01-01 00:01:00", "0", "x")], "Time string, EVENT string, pH string")).collect()
    assert [(r.label, r.pH) for r in water] == [(1, 1.0), (0, None)]
    flow = spark.createDataFrame([(0, 10.0, 2.0, 5.0), (0, 30.0, 6.0, 9.0), (1, 1.0, 0.0, 2.0)], "slot int, tcp double, udp double, rtt double")
    out = {r.timestamp: r for r in profiles.flows(flow, "slot", "2025-01-01", ["tcp", "udp"], {"rtt": "tcp"}, {"ratio": ("tcp", "udp")}).collect()}
    assert out[T0].tcp == 40 and out[T0].rtt == pytest.approx(8.0) and out[T0].ratio == pytest.approx(5.0)
    readings = [(at(i), s, float(50 + (i % 7) * (5 if (s == "A") == (i >= 100) else 0))) for i in range(200) for s in "AB"]
    long = spark.createDataFrame(readings, "timestamp timestamp, sensor_id string, speed double")
    assert profiles.volatile_sensors(long, str(at(100)), 1).first().sensor_id == "B"
    assert profiles.with_sensors(long, str(at(100)), 1).columns[-1] == "speed_B"
    with pytest.raises(ValueError):
        profiles.profile("other")


def test_split_and_selection(spark):
    df = spark.createDataFrame([(at(i), float(i), float(2 * i), 1.0, float((i * 37) % 11)) for i in range(100)], "timestamp timestamp, a double, b double, c double, d double")
    parts = {r.part: r["count"] for r in profiles.split_train(df, str(at(79))).groupBy("part").count().collect()}
    assert parts == {"model": 60, "calibration": 20, "test": 20}
    assert profiles.select_metrics(df, ["a", "b", "c", "d"]) == ["a", "d"]


def test_streamed_ageing_equals_the_batch(spark, tmp_path):
    from tarnwatch.operators import ageing
    from tarnwatch.streaming.ageing import aged

    rows = [(leaf, at(1440 * d), float((d * 3 + i) % 5), float(d % 2), float((d + i) % 4)) for d in range(8) for i, leaf in enumerate("ab")]
    schema = "leaf string, win_start timestamp, ev_p double, ev_s double, ev_n double"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = aged(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("aged_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.leaf, r.win_start, round(r.acc_safe, 9), round(r.acc_atk, 9)) for r in df.collect())
    assert key(spark.table("aged_test")) == key(ageing.age(spark.createDataFrame(rows, schema), "leaf", "win_start"))


def test_running_sums_equal_one_ordered_pass(spark):
    rng = np.random.default_rng(3)
    xs = sorted({round(float(x), 3) for x in rng.normal(size=300)})
    df = spark.createDataFrame([(x, i % 7) for i, x in enumerate(xs)], "s double, n long")
    for down in (False, True):
        want, total = {}, 0
        for x, n in sorted(((x, i % 7) for i, x in enumerate(xs)), reverse=down):
            total += n
            want[x] = total
        assert {r.s: r.run_n for r in metrics.running(df, "s", ["n"], down).collect()} == want
    assert metrics.running(df.limit(0), "s", ["n"]).count() == 0


def test_ranks_with_ties_and_one_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    pairs = [(a > b) + (a == b) / 2 for y, a in rows for z, b in rows if y and not z]
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(sum(pairs) / len(pairs))
    best = metrics.best_cut(df, "y", "s").first()
    assert (best.threshold, round(best.youden, 6)) == (0.5, round(1 - 2 / 3, 6))
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first().auc is None and metrics.best_cut(df.filter("y = 1"), "y", "s").count() == 0


def test_existence_recall_and_unit_root(spark):
    df = spark.createDataFrame([("a", i, y, p) for i, (y, p) in enumerate([(1, 0), (1, 1), (0, 1), (1, 0), (0, 0), (1, 0)])], "k string, i int, y int, p int")
    assert tuple(metrics.existence_recall(df, ["k"], "i", "y", "p").first()) == (3, 1, pytest.approx(1 / 3))
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    data = [("noise", i, float(x)) for i, x in enumerate(noise)] + [("walk", i, float(x)) for i, x in enumerate(np.cumsum(noise))] + [("flat", i, 1.0) for i in range(9)]
    out = {r.k: r for r in timeseries.unit_root(spark.createDataFrame(data, "k string, i int, x double"), ["k"], "i", "x").collect()}
    assert out["noise"].df_stat < -10 < out["walk"].df_stat and out["flat"].df_stat is None and out["walk"].rho1 > 0.9


def test_metric_selection_tolerates_constants_within_nulls(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7), None if i else 1.0, 3.0) for i in range(9)], "a double, b double, c double, d double, e double")
    assert profiles.select_metrics(df, ["a", "b", "c", "d", "e"]) == ["a", "c"]
    two = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (None, 6.0, 4.0)], "a double, b double, c double")
    # b is constant where a has values; c follows b exactly on the rows that both have.
    assert set(profiles.select_metrics(two, ["a", "b", "c"])) == {"a", "b"}


def test_rows_that_repeat_keep_their_number(spark):
    ntz = "cast(%s as timestamp_ntz)"
    periods = spark.sql("SELECT * FROM VALUES (0, 'p', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-02 00:00:00'), (1, 'q', timestamp_ntz'2024-01-01 12:00:00', timestamp_ntz'2024-01-03 00:00:00') AS t(idx, name, start, end)")
    rows = spark.createDataFrame([("2024-01-01 13:00:00", 1)] * 3 + [("2024-01-02 13:00:00", 2)] * 2 + [("2025-01-01 00:00:00", 3), (None, 4), (None, 4)], "t string, v int").select(F.expr(ntz % "t").alias("ts"), "v")
    got = sorted(((r.v, r.period) for r in joins.first_period(rows, "ts", periods).collect()), key=str)
    assert got == [(1, "p")] * 3 + [(2, "q")] * 2 + [(3, None)] + [(4, None)] * 2
    episodes = spark.createDataFrame([(1, "2024-01-01", "2024-01-02")] * 3 + [(2, "2025-01-01", "2025-01-02")] * 2 + [(3, None, None)] * 2, "episode int, a string, b string").select("episode", F.expr(ntz % "a").alias("start"), F.expr(ntz % "b").alias("end"))
    got = sorted(((r.episode, r.period) for r in joins.best_overlap(episodes, periods).collect()), key=str)
    assert got == [(1, "p")] * 3 + [(2, None)] * 2 + [(3, None)] * 2
