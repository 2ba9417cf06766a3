"""The chain of tail thresholds, least absolute residuals, and tails of distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import distributions as D
from tarnwatch.operators import calibration as C
from tarnwatch.operators import models, tails


def leaves():
    rng = np.random.default_rng(3)
    p = (np.arange(80) + 0.5) / 80
    hard = 1.001 + 5 * (1 - (1 - p) ** (1 / 1.02))  # a hard end: the likelihood grows up to it
    low = np.linspace(0, 1, 720)
    return {
        "likelihood": rng.exponential(2.0, 3000), "few rows": np.array([1.0, 2.0, 5.0]), "few peaks": rng.random(200),
        "heavy tail": 10 + rng.pareto(1.2, 3000), "moments": np.concatenate([low, hard]), "empirical": np.concatenate([low, 7 + 1e-3 * p]),
    }



def test_every_branch_is_taken_and_right(spark):
    data = leaves()
    rows = [(k, "x", i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("likelihood", "x", 9999, None)]
    df = spark.createDataFrame(rows, "leaf string, branch string, i long, e double").repartition(4)
    got = {r.leaf: r for r in tails.evt_thresholds(df, ["leaf", "branch"], "e").collect()}
    assert set(got) == set(data) and all(r.branch == "x" for r in got.values())
    assert {k: r.reason for k, r in got.items()} == {k: k for k in data}
    for k, x in data.items():
        r = got[k]
        assert r.n == len(x) and r.t_atk >= 1.1 * r.t_susp - 1e-12 and abs(r.t_base - 0.9 * r.t_susp) < 1e-12
        t0 = np.quantile(x, 0.9)
        peaks = x[x > t0] - t0
        if k == "few rows":
            assert r.t_susp == 1e-9 and abs(r.t_atk - 1.1e-9) < 1e-20
            continue
        assert abs(r.t0 - t0) < 1e-9 and r.n_peaks == len(peaks)
        if k in ("few peaks", "heavy tail"):
            assert abs(r.t_susp - np.quantile(x, 0.98)) < 1e-9 and r.xi is None
        elif k == "likelihood":
            xi, sigma = tails.likelihood_fit(peaks)
            assert abs(r.xi - xi) < 1e-3 and abs(r.sigma - sigma) < 1e-3 * sigma
            share = 0.02 * len(x) / len(peaks)
            assert abs(r.t_susp - (t0 + sigma / xi * (share**-xi - 1))) < 1e-3
        elif k == "moments":
            s, n = np.sort(peaks), len(peaks)
            a0, a1 = s.mean(), (s * (1 - (np.arange(1, n + 1) - 0.35) / n)).mean()
            assert abs(r.xi - (2 - a0 / (a0 - 2 * a1))) < 1e-6 and abs(r.sigma - 2 * a0 * a1 / (a0 - 2 * a1)) < 1e-6
            share = 0.01 * len(x) / n
            assert abs(r.t_atk - max(t0 + r.sigma / r.xi * (share**-r.xi - 1), 1.1 * r.t_susp)) < 1e-9
        else:
            for q, t in ((0.02, r.t_susp), (0.01, r.t_atk)):
                assert abs(t - max(t0 + np.quantile(peaks, 1 - q * len(x) / len(peaks)), 1.1 * r.t_susp * (q < 0.02))) < 1e-9


def test_clusters_count_once(spark):
    x = np.zeros(2000)
    rng = np.random.default_rng(4)
    x[:] = rng.random(2000)
    for at in range(50, 1950, 19):
        x[at : at + 3] = 2 + rng.exponential(1, 3)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "leaf string, i long, e double").repartition(3)
    got = tails.evt_thresholds(df, ["leaf"], "e", order="i", run=2).first()
    t0 = np.quantile(x, 0.9)
    over = np.flatnonzero(x > t0)
    clusters = np.split(over, np.flatnonzero(np.diff(over) > 2) + 1)
    assert got.n_peaks == len(clusters)
    with pytest.raises(ValueError):
        tails.evt_thresholds(df, ["leaf"], "e", run=2)


def test_sides_of_a_leaf_and_few_rows_on_one(spark):
    rows = [("p", float(v)) for v in range(-20, 21)] + [("b", float(v)) for v in range(-3, 30)] + [("n", float(v)) for v in range(-30, 3)] + [("s", -1.0), ("s", None), ("s", 2.0)]
    df = spark.createDataFrame(rows, "leaf string, r double")
    way = F.when(F.col("leaf") == "p", "pos").when(F.col("leaf") == "b", "both").when(F.col("leaf") == "n", "neg").otherwise("sym")
    got = {}
    for r in C.sides(df, ["leaf"], "r", way).collect():
        got.setdefault((r.leaf, r.branch), []).append(r.e)
    assert sorted(got["p", "pos"]) == [float(v) for v in range(21)]
    assert sorted(got["b", "pos"]) == [float(v) for v in range(30)]
    assert sorted(got["b", "neg"]) == sorted(abs(float(v)) for v in range(-3, 30))  # three rows are too few
    assert sorted(got["n", "neg"]) == [float(v) for v in range(31)] and sorted(got["s", "sym"]) == [1.0, 2.0]


def best_line(x, y):
    """The least sum over all lines through two readings."""
    best = np.abs(y - np.median(y)).sum()
    for i in range(len(x)):
        with np.errstate(divide="ignore", invalid="ignore"):
            b = (y - y[i]) / (x - x[i])
        for s in b[np.isfinite(b)]:
            best = min(best, np.abs(y - y[i] - s * (x - x[i])).sum())
    return best


def test_the_line_of_least_absolute_residuals(spark):
    rng = np.random.default_rng(5)
    data = {"noise": (rng.normal(size=61), rng.normal(size=61)), "line": (np.arange(30.0), 3 + 2 * np.arange(30.0)), "flat": (np.full(20, 4.0), rng.normal(size=20)), "ties": (rng.integers(0, 5, 80).astype(float), rng.integers(0, 5, 80).astype(float))}
    x = rng.normal(size=101)
    data["outliers"] = (x, 1 - 3 * x + 0.1 * rng.normal(size=101) + 100 * (rng.random(101) < 0.2))
    data["far"] = (1e6 + rng.random(50), 1e-3 * rng.random(50))
    rows = [(k, float(a), float(b)) for k, (u, v) in data.items() for a, b in zip(u, v)] + [("noise", None, 1.0), ("noise", 1.0, None)]
    got = {r.k: r for r in models.lad_line(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), ["k"], "x", "y").collect()}
    assert set(got) == set(data)
    for k, (u, v) in data.items():
        assert got[k].n == len(u)
        assert got[k].loss <= best_line(u, v) * (1 + 1e-9) + 1e-9, k
        assert abs(np.abs(v - got[k].intercept - got[k].slope * u).sum() - got[k].loss) < 1e-6 * max(1, got[k].loss)
    assert abs(got["outliers"].slope + 3) < 0.1 and abs(got["line"].slope - 2) < 1e-9 and got["flat"].slope == 0


#: Upper tails by tables, to six places: fixed values.
CHI2 = [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.0, 4, 1.0), (10.0, 5, 0.075235), (1.0, 1, 0.317311), (30.0, 15, 0.011921)]


def test_tails_by_tables(spark):
    df = spark.createDataFrame(CHI2, "x double, d int, p double")
    for r in df.withColumn("got", D.chi2_tail(F.col("x"), F.col("d"))).collect():
        assert abs(r.got - r.p) < 1e-6, r
    far = spark.createDataFrame([(2500.0, 2000), (60.0, 1), (400.0, 7)], "x double, d int").select(D.chi2_tail(F.col("x"), F.col("d"))).collect()
    assert 0 < far[0][0] < 1e-10 and 0 < far[1][0] < 1e-13 and 0 <= far[2][0] < 1e-80
    xs = [0.0, 0.1, 0.5, 1.0, 1.9, 2.1, 3.0, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erfc(r.x)) < 1e-12 for r in got)


def test_kolmogorov_by_its_series(spark):
    cases = [(0.1, 100, 100), (0.3, 40, 50), (0.05, 1000, 2000), (0.9, 10, 10), (0.01, 50, 50), (0.2, 60, 60)]
    got = spark.createDataFrame(cases, "d double, a long, b long").select("d", "a", "b", D.kolmogorov_tail(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n = math.sqrt(r.a * r.b / (r.a + r.b))
        x = (n + 0.12 + 0.11 / n) * r.d
        want = min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 3000)))) if x > 0.1 else 1.0
        assert abs(r.p - want) < 1e-6


#: Quantiles of Student's t of three degrees of freedom: fixed values.
T3 = {0.5: 0.0, 0.75: 0.764892, 0.9: 1.637744, 0.95: 2.353363, 0.975: 3.182446}


def test_student_deviates(spark):
    draws = spark.range(100_000).select(D.student_deviate(D.uniform("id", F.lit(1)), D.uniform("id", F.lit(2)), 3.0).alias("t"), D.cauchy_deviate(D.uniform("id", F.lit(3))).alias("c"))
    t, c = (np.array([r[i] for r in draws.collect()]) for i in (0, 1))
    for q, want in T3.items():
        assert abs((t <= want).mean() - q) < 0.005
        assert abs((t >= -want).mean() - q) < 0.005
    assert abs((c <= 1).mean() - 0.75) < 0.005
