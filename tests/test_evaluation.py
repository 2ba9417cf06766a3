"""Evaluation, qualification and calibration against brute force and counted cases."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import attribution as A
from tarnwatch.operators import calibration as C
from tarnwatch.operators import evaluation as E
from tarnwatch.operators import fusion, joins, metrics, studies, tails
from tarnwatch.operators import qualification as Q

EVENTS = "name string, start timestamp, end timestamp"


def hours(spark, n):
    return spark.range(n).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), "id")


def events(spark, rows, more=""):
    df = spark.createDataFrame([(n, a, b, *rest) for n, a, b, *rest in rows], f"name string, a long, b long{more}")
    return df.withColumn("start", F.timestamp_seconds(F.col("a") * 3600)).withColumn("end", F.timestamp_seconds(F.col("b") * 3600)).drop("a", "b")


def test_events_without_rows_and_of_one_name_stay(spark):
    cat = events(spark, [("A", 2, 5), ("A", 10, 12), ("none", 900, 901)])
    got = sorted((r.name, r.n, r.n_detected, r.ttd_s) for r in metrics.attack_summary(hours(spark, 50), cat, "ts", "v", 3.0).collect())
    assert got == [("A", 2, 2, 0.0), ("A", 3, 2, 3600.0), ("none", 0, 0, None)]
    table = {r.name: r for r in E.ppv_table(hours(spark, 50).withColumns({"p": (F.col("v") > 3).cast("int"), "y": F.lit(0)}), cat.filter("name = 'none'"), "ts", "p", "y").collect()}
    assert table["none"].n == 0 and table["none"].tpr is None and table["none"].ppv is None


def test_overlaps_beyond_the_broadcast_bound_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = events(spark, [(f"a{i}", int(s), int(s) + int(rng.integers(1, 60))) for i, s in enumerate(rng.integers(0, 400, 60))]).withColumnRenamed("name", "episode")
    b = events(spark, [(f"b{i}", int(s), int(s) + int(rng.integers(1, 60))) for i, s in enumerate(rng.integers(0, 400, 40))]).withColumn("idx", F.substring("name", 2, 9).cast("int"))
    want = sorted(map(tuple, joins.best_overlap(a, b).collect()))
    pairs = sorted(map(tuple, A.overlapping(b).select("name_1", "name_2").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, joins.best_overlap(a, b).collect())) == want
    assert sorted(map(tuple, A.overlapping(b).select("name_1", "name_2").collect())) == pairs and len(pairs) > 10
    lone = events(spark, [("x", 5000, 5001)]).withColumnRenamed("name", "episode")
    assert [(r.period, r.iou) for r in joins.best_overlap(lone, b).collect()] == [(None, 0.0)]


def test_overlaps_meet_once_at_the_later_start(spark, monkeypatch):
    rng = np.random.default_rng(8)
    spans = [(f"b{i % 50}", int(s), int(s) + int(rng.integers(-3, 90))) for i, s in enumerate(rng.integers(0, 40, 60))] + [("long", -900_000, 900_000), ("late", 39, 10**6)]
    b = events(spark, spans)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(joins, "MEET", 7)
    want = sorted((m, n) for m, s, e in spans for n, t, f in spans if m < n and s < f and t < e)
    assert sorted(map(tuple, A.overlapping(b).select("name_1", "name_2").collect())) == want
    a, c = (b.toDF(*[f"{x}_{k}" for x in b.columns]) for k in (1, 2))
    met = joins.started_inside(a, c, ("start_1", "end_1"), ("start_2", "end_2"), F.expr("start_2 >= start_1"))
    assert met.count() == sum(s <= t and s < f and t < e for _, s, e in spans for _, t, f in spans)


def test_sweep_counts_each_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 500), np.round(rng.random(500), 2))] + [(1, None), (None, 0.5)]
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in metrics.sweep(spark.createDataFrame(rows, "y int, score double"), [0.5, 0.1, 0.5, 0.9]).collect()}
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    assert got == {t: tuple(sum(1 for y, s in known if y == a and (s >= t) == b) for a, b in ((1, True), (0, True), (0, False), (1, False))) for t in (0.1, 0.5, 0.9)}
    assert metrics.sweep(spark.createDataFrame([], "y int, score double"), [0.5]).count() == 0


def test_median_run_and_summary(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1, 1, 1, *[0] * 9]
    df = spark.createDataFrame([("k", i, y, float(i % 3), int(i % 2)) for i, y in enumerate(flags)], "k string, i int, y int, s double, p int")
    assert E.median_run(df, ["k"], "i", "y") == 2 and E.median_run(df.filter("y = 0"), ["k"], "i", "y") == 0
    got = E.vus_summary(df, ["k"], "i", "y", "s", "p", steps=3).first()
    assert (got.n_runs, got.n_hit, got.most) == (3, 3, 2)
    for kind in ("roc", "pr"):
        parts = [E.M.range_auc(df, ["k"], "i", "y", "s", b, kind).first()[0] for b in (0, 1, 2)]
        assert abs(got[f"vus_{kind}"] - ((parts[0] + parts[1]) / 2 + (parts[1] + parts[2]) / 2) / 2) < 1e-9


def f1(y, p):
    tp = ((y == 1) & (p == 1)).sum()
    return 2 * tp / max(1, (y == 1).sum() + (p == 1).sum())


def test_bca_of_rows_is_that_of_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.where(rng.random(400) < 0.8, y, 1 - y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, p int")
    got = E.bca_interval(df, "y", ["p"], E.f1_of, replicates=4000)
    draws = np.array([f1(y[i], p[i]) for i in rng.integers(0, 400, (4000, 400))])
    left = np.array([f1(np.delete(y, i), np.delete(p, i)) for i in range(400)])
    low, high = E.bca_endpoints(f1(y, p), draws, left, np.ones(400))
    assert abs(got["value"] - f1(y, p)) < 1e-12 and abs(got["low"] - low) < 0.01 and abs(got["high"] - high) < 0.01
    none = E.bca_interval(df.limit(0), "y", ["p"], E.f1_of)
    assert all(math.isnan(v) for v in none.values())


def test_moving_blocks_count_what_they_draw(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 103), rng.integers(0, 2, 103)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))], "i long, y int, p int")
    got = {r.rep: tuple(r)[1:] for r in E.block_draws(df, "i", 2 * F.col("y") + F.col("p"), 4, 10, 20, 7).collect()}
    draws = spark.range(220).select(F.floor(F.col("id") / 11).alias("rep"), (F.col("id") % 11).alias("k")).select("rep", "k", F.pmod(F.xxhash64("rep", "k", F.lit(7)), F.lit(94)).alias("s")).collect()
    want = defaultdict(lambda: np.zeros(4, int))
    for d in draws:
        size = 3 if d.k == 10 else 10
        want[d.rep] += np.bincount(2 * y[d.s : d.s + size] + p[d.s : d.s + size], minlength=4)
    assert got == {r: tuple(c) for r, c in want.items()} and all(sum(c) == 103 for c in got.values())


def test_paired_gain_and_exact_mcnemar(spark):
    rng = np.random.default_rng(5)
    y, a, b = rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(y, a, b)], "y int, a int, b int")
    got = E.bca_interval(df, "y", ["a", "b"], E.f1_gain, replicates=500)
    assert abs(got["value"] - (f1(y, a) - f1(y, b))) < 1e-12 and got["low"] < got["value"] < got["high"]
    rows = [(i, j) for i in range(0, 12) for j in range(0, 12)] + [(40, 9), (30, 31)]
    out = spark.createDataFrame(rows, "a int, b int").withColumn("p", E.mcnemar_p(F.col("a"), F.col("b"))).collect()
    for r in out:
        m, low = r.a + r.b, min(r.a, r.b)
        if m == 0:
            want = 1.0
        elif m < 25:
            want = min(1.0, 2 * sum(math.comb(m, i) for i in range(low + 1)) / 2**m)
        else:
            want = math.erfc(math.sqrt(max(abs(r.a - r.b) - 1, 0) ** 2 / m / 2))
        assert abs(r.p - want) < 1e-6


def test_quantiles_are_exact_whatever_the_ties(spark):
    rng = np.random.default_rng(6)
    data = {f"small{n}": rng.normal(size=n) for n in (2, 7, 33, 330, 3999, 4001)}  # a margin is less than a row in most
    data |= {"a": np.round(rng.normal(size=5000), 1), "b": np.zeros(300), "c": np.array([1.0]), "d": np.concatenate([np.zeros(4000), rng.random(2000)])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("e", None)], "k string, v double")
    shares = [0.0, 0.5, 0.667, 0.9, 0.99, 1.0]
    got = {r.k: r for r in C.quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert got[k].n == len(x) and np.allclose([got[k][f"q{i}"] for i in range(len(shares))], np.quantile(x, shares), atol=1e-12)
    one = C.quantiles(df.filter("k = 'd'"), [], "v", [0.8]).first()
    assert abs(one.q0 - np.quantile(data["d"], 0.8)) < 1e-12


def test_regimes_with_few_rows_take_the_thresholds_of_the_leaf(spark):
    # Ten days of hours: 8..17 on working days is ACTIVE. The leaf "few" has rows at night alone.
    base = hours(spark, 240).select(F.lit("full").alias("leaf"), "ts", F.abs(F.col("v") - 3).alias("e"))
    few = hours(spark, 240).filter(F.hour("ts") < 6).select(F.lit("few").alias("leaf"), "ts", F.abs(F.col("v") - 3).alias("e"))
    got = {(r.leaf, r.regime): r for r in C.thresholds_by_regime(base.unionByName(few), "leaf", "ts", "e").collect()}
    assert got["few", "ACTIVE"].n == 0 and got["few", "ACTIVE"].source == "leaf" and got["few", "ACTIVE"].t_susp == got["few", "QUIET"].t_susp
    assert {got["full", r].source for r in ("ACTIVE", "QUIET")} == {"own"}
    tiny = C.thresholds_by_regime(base.limit(5), "leaf", "ts", "e").first()
    assert (tiny.t_susp, tiny.t_atk, tiny.source) == (1.0, 2.0, "leaf")
    routed = C.with_regime_thresholds(base, C.thresholds_by_regime(base, "leaf", "ts", "e"), "leaf", "ts")
    assert routed.filter("t_susp IS NULL").count() == 0


def test_likelihood_by_sums_is_that_of_the_rows(spark):
    rng = np.random.default_rng(7)
    data = {"heavy": rng.pareto(3, 3000) * 2, "light": rng.uniform(0, 5, 800), "exp": rng.exponential(4, 2000), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "k string, x double")
    got = {r.k: r for r in tails.maximum_likelihood(df, "k", "x").collect()}

    def loss(x, xi, sigma):
        return -len(x) * np.log(sigma) - x.sum() / sigma if abs(xi) < 1e-9 else -len(x) * np.log(sigma) - (1 / xi + 1) * np.log1p(xi * x / sigma).sum()

    for k in ("heavy", "light", "exp"):
        xi, sigma = tails.likelihood_fit(data[k])
        assert got[k].n == len(data[k]) and abs(got[k].xi - xi) < 0.02 and abs(got[k].sigma - sigma) < 0.02 * max(1, sigma)
        assert loss(data[k], got[k].xi, got[k].sigma) >= loss(data[k], xi, sigma) - 0.01
    assert got["one"].n == 1


def test_a_prior_over_gaps_against_a_fold(spark):
    rng = np.random.default_rng(8)
    types, n = ["x", "y", "z"], 40
    b = rng.dirichlet([1, 1, 1, 1], n)
    gate = (rng.random(n) < 0.5).astype(int)
    df = spark.createDataFrame([("k", i, *map(float, b[i]), int(gate[i])) for i in range(n)], "key string, i int, x double, y double, z double, u double, gate int")
    t = A.transition_matrix(types, 0.7, {("x", "y"): 0.2})
    got = {r.i: tuple(r)[2:] for r in Q.with_memory(df, "key", "i", types, "gate", t, 0.9, 0.3).collect()}
    before, gap = None, 1
    for i in range(n):
        if not gate[i]:
            assert got[i] == (None,) * 4
            gap += 1
            continue
        now, u = b[i, :3], b[i, 3]
        if before is not None:
            d = 0.9**gap
            now = 0.7 * now + 0.3 * d * (np.array(t).T @ before[0])
            u = 0.7 * u + 0.3 * (1 - d * (1 - before[1]))
        before, gap = (now, u), 1
        assert np.allclose(got[i], [*now, u])


def test_rows_without_groups_and_missing_columns(spark):
    system = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.1), (4, None)], "w int, proj_atk double")
    scores = spark.createDataFrame([(1, "a", 0, "g", 0.9), (1, "b", 1, "g", 0.9), (3, "a", 0, "g", 0.9), (3, "b", 1, "g", 0.2)], "w int, type string, type_idx int, grp string, score double")
    got = {r.w: r for r in Q.qualify(system, scores, "w", 0.5).collect()}
    assert [got[w].qual_status for w in (1, 2, 3, 4)] == [Q.QUALIFIED, Q.NO_GROUPS, Q.CLOSED, Q.CLOSED]
    assert got[1].top1_type == "a" and got[2].top1_type is None and got[2].u == 1.0 and got[3].u is None
    df = Q.split_rows(Q.qualify(system, scores, "w", 0.5))
    assert {r.w: r.part for r in df.collect()} == {1: "qualified", 2: "no_groups", 3: "closed", 4: "closed"}
    assert Q.split_rows(system).filter("part <> 'closed'").count() == 0


def test_consensus_fold_against_pairs(spark):
    """ccf of many is the pairwise rule taken in order."""
    rng = np.random.default_rng(9)
    rows = [(0, i, *map(float, x), 1 / 3, 1 / 3, 1 / 3) for i, x in enumerate(rng.dirichlet([2, 1, 1, 3], 5))]
    names = "g int, leaf int, b_safe double, b_susp double, b_atk double, u double, a_safe double, a_susp double, a_atk double"
    got = fusion.fuse(spark.createDataFrame(rows, names), ["g"], "ccf").first()

    def ccf(x, y):
        agreed = np.minimum(x[:3], y[:3])
        rx, ry = x[:3] - agreed, y[:3] - agreed
        out = agreed + rx * y[3] + ry * x[3] + rx * ry
        for i in range(3):
            for j in range(3):
                if i != j:
                    out[i] += (rx[i] * ry[j] + rx[j] * ry[i]) / 2
        u = x[3] * y[3]
        return np.array([*out, u]) / (out.sum() + u)

    want = np.array(rows[0][2:6])
    for r in rows[1:]:
        want = ccf(want, np.array(r[2:6]))
    assert np.allclose([got.b_safe, got.b_susp, got.b_atk, got.u], want, atol=1e-9)


def test_synthetic_tables_and_noise(spark):
    df = studies.synthetic_pair(spark, 200, 100, 2, seed=3).persist()
    r = df.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg(F.when(F.col("y") == 0, F.abs(F.col("m_0") - F.col("clean_0")))).alias("same"), F.avg(F.when(F.col("y") == 1, F.col("m_0") - F.col("clean_0"))).alias("moved")).first()
    assert (r.n, r.y, r.same) == (300, 10, 0.0) and abs(r.moved - 4.0) < 1e-9
    c = studies.correlated_residuals(spark, 4000, leakage=0.8).agg(F.corr("forecast_0", "reconst_0").alias("far"), F.corr("forecast_0", "forecast_1").alias("near")).first()
    assert 0.3 < c.far < c.near
    t = spark.createDataFrame([("a", 0, "g", 0.8, 0.1, 0.1), ("b", 1, "g", 0.1, 0.1, 0.8)], "type string, type_idx int, grp string, c_safe double, c_susp double, c_atk double")
    g = spark.createDataFrame([(i, "g", "a" if i % 2 else "b", *((0.7, 0.2, 0.1) if i % 2 else (0.1, 0.2, 0.7))) for i in range(60)], "w int, grp string, truth string, p_safe double, p_susp double, p_atk double")
    acc = {r.sigma: r.accuracy for r in studies.signature_noise(g, t, "w", "truth", [0.0, 0.2, 2.0], 3).collect()}
    assert acc[0.0] == 1.0 and acc[0.0] >= acc[0.2] > acc[2.0] > 0.3


@pytest.mark.parametrize("mode", C.WEIGHTS)
def test_leaf_weights(spark, mode):
    df = spark.createDataFrame([(0.5, 4.0, None, True), (0.5, 0.0, 2.0, True), (0.5, 4.0, 2.0, False)], "r2 double, iw double, rmse double, f boolean")
    got = [r[0] for r in df.select(C.leaf_weight(mode, F.col("r2"), F.col("iw"), F.col("rmse"), F.col("f"))).collect()]
    assert got == {"uniform": [1, 1, 1], "r2_static": [0.5] * 3, "interval": [0.25, 0.5, 0.5], "online_rmse": [0.5, 0.5, 0.5]}[mode]
    with pytest.raises(ValueError):
        C.leaf_weight("other", F.col("r2"))
