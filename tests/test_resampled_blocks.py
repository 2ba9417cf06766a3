"""Block bootstrap, ageing with a fixed rate, nearest neighbours and the kernel machine against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import ageing, models, neighbours
from tarnwatch.operators import evaluation as E


def f1(c):
    return E.f1_of(np.asarray(c, dtype=float))


def data(n, seed, nulls=0):
    rng = np.random.default_rng(seed)
    y = np.repeat(rng.integers(0, 2, n // 10 + 1), 10)[:n]
    p = np.where(rng.random(n) < 0.8, y, 1 - y)
    gone = set(rng.choice(n, nulls, replace=False).tolist())
    return y, p, gone


@pytest.mark.parametrize("rows", [40, 10**6])
def test_kinds_of_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(E, "BLOCK_ROWS", rows)
    y, p, _ = data(203, 1)
    df = spark.createDataFrame([(i, int(2 * a + b)) for i, (a, b) in enumerate(zip(y, p))], "pos long, c int").repartition(3)
    code = 2 * y + p
    for length, step in ((10, 1), (10, 10), (203, 1), (1, 1)):
        got = {tuple(r)[:4]: r.times for r in E.block_kinds(df, "pos", F.col("c"), 4, length, step).collect()}
        want = {}
        for s in range(0, 203 - length + 1 if step == 1 else 203, step):
            k = tuple(np.bincount(code[s : s + length], minlength=4).tolist())
            want[k] = want.get(k, 0) + 1
        assert got == want


def test_draws_are_multinomial_over_kinds_in_any_number_of_groups(spark):
    kinds = spark.createDataFrame([(5, 0, 70), (3, 2, 20), (0, 5, 10)], "c0 long, c1 long, times long")
    for group in (10, 1):
        got = E.drawn_blocks(kinds, 2, 40, 3000, 7, group)
        assert got.shape == (3000, 2) and (got.sum(axis=1) == 200).all()
        mean, var = 40 * (0.7 * 5 + 0.2 * 3), 40 * (0.7 * 25 + 0.2 * 9 - (0.7 * 5 + 0.2 * 3) ** 2)
        assert abs(got[:, 0].mean() - mean) < 4 * math.sqrt(var / 3000) and abs(got[:, 0].var() / var - 1) < 0.1


def test_intervals_of_blocks_are_those_of_resampling_with_null_labels(spark):
    y, p, gone = data(1000, 2, 100)
    rows = [(5 * i, None if i in gone else int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "i long, y int, p int").repartition(4)
    got = E.bca_interval(df, "y", ["p"], E.f1_of, "i", 50, replicates=4000)
    keep = [i for i in range(1000) if i not in gone]
    code = (2 * y + p)[keep]
    n = len(code)
    rng = np.random.default_rng(3)
    blocks = np.array([np.bincount(code[s : s + 50], minlength=4) for s in range(n - 49)])
    draws = f1(np.array([blocks[rng.integers(0, n - 49, n // 50)].sum(axis=0) for _ in range(4000)]))
    left = f1(np.array([np.bincount(np.delete(code, np.arange(s, min(s + 50, n))), minlength=4) for s in range(0, n, 50)]))
    theta = float(f1(np.bincount(code, minlength=4)))
    low, high = E.bca_endpoints(theta, draws, left, np.ones(len(left)))
    assert n == 900 and abs(got["value"] - theta) < 1e-12
    assert abs(got["low"] - low) < 0.012 and abs(got["high"] - high) < 0.012
    # Blocks of a persistent series say less than as many single rows.
    single = E.bca_interval(df, "y", ["p"], E.f1_of)
    assert got["high"] - got["low"] > 0.8 * (single["high"] - single["low"])
    with pytest.raises(ValueError):
        E.bca_interval(df, "y", ["p"], E.f1_of, None, 50)


def test_a_last_block_is_cut_short(spark):
    y, p, _ = data(57, 4)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))], "i long, y int, p int")
    seen = []
    E.bca_interval(df, "y", ["p"], lambda c: (seen.append(np.asarray(c)), E.f1_of(c))[1], "i", 10, replicates=50)
    draws = next(s for s in seen if s.shape == (50, 4))
    assert (draws.sum(axis=1) == 57).all()
    whole = E.bca_interval(df, "y", ["p"], E.f1_of, "i", 500, replicates=20)
    assert whole["low"] <= whole["value"] <= whole["high"] or math.isnan(whole["low"]) or whole["low"] == whole["high"]


def test_events_of_one_name_stay_apart(spark):
    from tarnwatch.operators import qualification as Q

    hour = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    df = spark.range(50).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("v"), (F.col("id") % 2).cast("int").alias("p"), F.lit(0).alias("y"), F.lit("leaf").alias("leaf"), F.lit("x").alias("top1_type"), (F.col("id") >= 4).alias("gate_open"), F.lit("qualified").alias("qual_status"))
    one = spark.range(1)
    cat = None
    for name, a, b in (("A", 3, 5), ("A", 10, 13), ("A", 10, 13), ("none", 900, 901)):
        row = one.select(F.lit(name).alias("name"), F.lit("x").alias("expected"), hour(a).alias("start"), hour(b).alias("end"))
        cat = row if cat is None else cat.unionByName(row)
    want = lambda rows: sorted(map(str, rows))
    m = [(r.name, r.n, r.n_detected, r.ttq_min) for r in Q.metrics_by_attack(df, cat, "ts").collect()]
    assert want(m) == want([("A", 2, 1, 60.0), ("A", 3, 3, 0.0), ("A", 3, 3, 0.0), ("none", 0, 0, None)])
    t = [(r.name, r.n, r.tpr) for r in E.ppv_table(df, cat, "ts", "p", "y").collect()]
    assert want(t) == want([("A", 2, 0.5), ("A", 3, 1 / 3), ("A", 3, 1 / 3), ("none", 0, None)])
    b = [(r.name, r.before, r.max_during, r.mean_after) for r in E.base_rates(df, cat, "ts", "v", 7200, 7200).collect()]
    assert want(b) == want([("A", 2.0, 4.0, 5.5), ("A", 9.0, 12.0, 13.5), ("A", 9.0, 12.0, 13.5), ("none", None, None, None)])
    c = [(r.name, r.ttq_s) for r in E.first_correct(df.filter("ts >= timestamp_seconds(14400)"), cat, "ts", "top1_type").collect()]
    assert want(c) == want([("A", 3600.0), ("A", 0.0), ("A", 0.0), ("none", None)])
    o = [(r.name, r.metric, r.n) for r in E.outage_check(df, F.col("v") < 40, cat, "ts", ["v"]).collect()]
    assert want(o) == want([("A", "v", 2), ("A", "v", 3), ("A", "v", 3)])
    f = [(r.name, r.n, r["first"], r.most) for r in E.leaf_profile(df, cat, "ts", "leaf", "v").collect()]
    assert want(f) == want([("A", 2, 3.0, 4.0), ("A", 3, 10.0, 12.0), ("A", 3, 10.0, 12.0)])


@pytest.mark.parametrize("prior", [False, True])
def test_fixed_ageing_is_the_fold_without_python(spark, prior):
    rng = np.random.default_rng(5)
    rows = [(k, i, *map(float, rng.random(3) * (rng.random() < 0.7)), "c") for k in ("a", "b") for i in range(300)] + [("z", 1, None, 2.0, 0.0, "c"), ("z", 2, 1.0, None, 0.0, "d")]
    df = spark.createDataFrame(rows, "k string, i int, ev_p double, ev_s double, ev_n double, c string").repartition(3)
    for rate, block in ((0.85, 37), (0.5, 7), (0.99, 64)):
        p = ageing.Ageing(rate=rate, conflict="none", start_at_prior=prior)
        out = ageing.age(df, "k", "i", params=p, carry=["c"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        short = ageing.age_fixed(df, "k", "i", params=p, carry=["c"], block=block)
        for got in (out.collect(), short.collect()):
            by = {}
            for r in sorted(rows, key=lambda r: (r[0], r[1])):
                s = by.get(r[0], (None, [a * 3.0 * prior for a in p.prior]))[1]
                s = [rate * a + (b or 0.0) for a, b in zip(s, r[2:5])]
                by[r[0]] = (r[1], s)
                by[r[0], r[1]] = s
            assert len(got) == len(rows)
            assert all(np.allclose([r.acc_safe, r.acc_susp, r.acc_atk], by[r.k, r.i], rtol=1e-12, atol=1e-12) for r in got)
            assert all((r.k_eff, r.lambda_dyn) == (0.0, rate) for r in got)
    near_one = ageing.age_fixed(df, "k", "i", params=ageing.Ageing(rate=0.9997, conflict="none"), block=5)
    assert abs(near_one.filter("k = 'a' AND i = 299").first().acc_safe - sum(0.9997 ** (299 - r[1]) * r[2] for r in rows if r[0] == "a")) < 1e-9


def lof(train, x, k):
    """Local outlier factors by all distances; copies are rows of their own."""
    d = np.sqrt(((train[:, None] - train[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, axis=1)
    reach = near[:, -1]
    density = 1 / np.maximum(np.maximum(near, reach[order]).mean(axis=1), 1e-12)
    e = np.sqrt(((x[:, None] - train[None]) ** 2).sum(axis=2))
    o = np.argsort(e, axis=1, kind="stable")[:, :k]
    own = 1 / np.maximum(np.maximum(np.take_along_axis(e, o, axis=1), reach[o]).mean(axis=1), 1e-12)
    return density[o].mean(axis=1) / own


def test_outlier_factors_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(2600, 3)), rng.normal(6, 0.2, (2400, 3))])
    x = np.concatenate([x, rng.uniform(-9, 9, (200, 3))])
    train = np.arange(len(x)) < 5000
    df = spark.createDataFrame([(i, *map(float, v), bool(t)) for i, (v, t) in enumerate(zip(x, train))], "i int, a double, b double, c double, t boolean").repartition(4)
    got = {r.i: r.score for r in neighbours.local_outlier_factor(df, F.col("t"), ["a", "b", "c"], 20).collect()}
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    want = lof((x[train] - mean) / scale, (x - mean) / scale, 20)
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9)


def test_copies_of_one_row_are_neighbours_of_each_other(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.zeros((60, 2)), rng.normal(size=(90, 2))])
    df = spark.createDataFrame([(i, *map(float, v), True) for i, v in enumerate(x)] + [(999, None, 3.0, False)], "i int, a double, b double, t boolean")
    got = {r.i: r.score for r in neighbours.local_outlier_factor(df, F.col("t"), ["a", "b"], 10).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = lof(z, z, 10)
    assert len(got) == 151 and np.allclose([got[i] for i in range(60, 150)], want[60:], rtol=1e-6)
    assert len({round(got[i], 9) for i in range(60)}) == 1
    alone = neighbours.local_outlier_factor(df.limit(1), F.col("t"), ["a", "b"], 10).collect()
    assert [r.score for r in alone] == [1.0]


def test_the_kernel_machine_meets_the_conditions_of_the_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 2))
    for nu in (0.05, 0.3, 1.0):
        alpha, rho = models.support_vectors(x, nu, 0.5)
        most = 1 / (nu * len(x))
        k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
        g = k @ alpha
        assert abs(alpha.sum() - 1) < 1e-9 and (alpha >= 0).all() and (alpha <= most + 1e-12).all()
        if nu < 1:
            assert (g[alpha < 1e-12] >= rho - 1e-5).all() and (g[alpha > most - 1e-12] <= rho + 1e-5).all()
            assert (g < rho - 1e-5).mean() <= nu + 0.01 and (alpha > 1e-12).mean() >= nu - 0.01
    rows = [(i, *map(float, v), True) for i, v in enumerate(x)] + [(999, 9.0, -9.0, False)]
    df = spark.createDataFrame(rows, "i int, a double, b double, t boolean")
    out = {r.i: r.score for r in models.one_class_kernel(df, F.col("t"), ["a", "b"], nu=0.1).collect()}
    assert max(out, key=out.get) == 999 and 0.03 < np.mean([v > 1e-6 for i, v in out.items() if i < 999]) < 0.15
    assert [r.score for r in models.one_class_kernel(df, F.lit(False), ["a", "b"]).limit(2).collect()] == [0.0, 0.0]
