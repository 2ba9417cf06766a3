"""The queries without SQL, on the smallest tables: against numpy where it can say what is right,
else for what must hold of any right answer."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch import plans
from tarnwatch.operators import evaluation as E
from tarnwatch.operators import fusion, models, tails
from tarnwatch.plans import q_metrics, q_models, q_opinions

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return plans.QUERIES[name](spark, SF).collect()


def days(spark):
    """(times, training rows?, values) of the detectors' table."""
    got = q_models.wide(spark, SF).orderBy("ts").collect()
    return [r.ts for r in got], np.array([r.ts.isoformat() < "2024-01-20" for r in got]), np.array([[r.a, r.b, r.c] for r in got])


def test_every_query_has_sql_or_a_test_here():
    here = open(__file__).read()
    assert [n for n in plans.QUERIES if n not in plans.ORACLE_SQL and f'"{n}"' not in here] == []


def test_pca_error(spark):
    ts, train, x = days(spark)
    c = x - x[train].mean(axis=0)
    _, v = np.linalg.eigh(np.cov(x[train].T, bias=True))
    want = (c**2).sum(axis=1) - (c @ v[:, -1]) ** 2
    got = {r.ts: r.score for r in rows(spark, "q_pca_error")}
    assert np.allclose([got[t] for t in ts], want, atol=0.02, rtol=1e-6)


def test_outlier_factor(spark):
    ts, train, x = days(spark)
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    ref, z, k = (x[train] - mean) / scale, (x - mean) / scale, 5
    dist = np.sqrt(((ref[:, None] - ref[None]) ** 2).sum(axis=2))
    near = [[j for j in np.argsort(dist[i], kind="stable") if j != i][:k] for i in range(len(ref))]
    reach = np.array([dist[i, n[-1]] for i, n in enumerate(near)])
    density = np.array([1 / np.mean([max(dist[i, j], reach[j]) for j in n]) for i, n in enumerate(near)])
    got = {r.ts: r.score for r in rows(spark, "q_outlier_factor")}
    for t, p, own in zip(ts, z, train):
        if not own:
            d = np.sqrt(((ref - p) ** 2).sum(axis=1))
            n = np.argsort(d, kind="stable")[:k]
            assert abs(got[t] - density[n].mean() * np.mean(np.maximum(d[n], reach[n]))) < 1e-5


@pytest.mark.parametrize("name", ["q_isolation_forest", "q_one_class"])
def test_detectors_repeat_and_rank_the_farthest_day_high(spark, name):
    ts, train, x = days(spark)
    z = np.abs((x - x[train].mean(axis=0)) / x[train].std(axis=0)).max(axis=1)
    a, b = ({r.ts: r.score for r in rows(spark, name)} for _ in range(2))
    assert a == b and set(a) == set(ts) and all(math.isfinite(v) for v in a.values())
    assert name != "q_isolation_forest" or all(0 < v < 1 for v in a.values())
    far = ts[int(z.argmax())]
    assert sum(v > a[far] for v in a.values()) <= len(ts) // 3


def test_seasonal_model(spark):
    got = {r.leaf: r for r in rows(spark, "q_seasonal_model")}
    data = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "value").collect():
        data[r.event_type].append((r.t, r.value))
    for leaf, points in data.items():
        t, y = map(np.array, zip(*points))
        cols = [np.ones(len(t))] + [f(2 * math.pi * t / p * k) for p, n in ((7 * 86400.0, 3), (86400.0, 4)) for k in range(1, n + 1) for f in (np.sin, np.cos)]
        x = np.stack(cols, axis=1)
        beta = np.linalg.solve(x.T @ x + 1e-3 * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), x.T @ y)
        assert abs(got[leaf].mean_yhat - (x @ beta).mean()) < 1e-3 and abs(got[leaf].mean_y - y.mean()) < 1e-3


def test_likelihood_fit(spark):
    got = {r.leaf: r for r in rows(spark, "q_likelihood_fit")}
    data = defaultdict(list)
    for r in q_metrics._peaks(spark, SF).collect():
        data[r.leaf].append(r.excess)
    for leaf, x in data.items():
        xi, sigma = tails.likelihood_fit(np.array(x))
        assert got[leaf].n == len(x) and abs(got[leaf].xi - xi) < 0.01 and abs(got[leaf].sigma - sigma) < 0.01 * sigma + 0.01


def test_dropped_windows(spark):
    before = {(r.leaf, r.day): (r.ev_p, r.ev_s, r.ev_n) for r in q_opinions.evidence(spark, SF).collect()}
    got = rows(spark, "q_drop_windows")
    assert len(got) == len(before) and all((r.ev_p, r.ev_s, r.ev_n) == ((0, 0, 0) if r.lost else before[r.leaf, r.day]) for r in got)
    assert 0.1 < sum(r.lost for r in got) / len(got) < 0.3


def test_consensus_and_all_modes(spark):
    ops = defaultdict(list)
    for r in q_opinions.leaf_opinions(spark, SF).orderBy("leaf").collect():
        ops[r.day].append(np.array([r.b_safe, r.b_susp, r.b_atk, r.u]))

    def ccf(x, y):
        if np.allclose(x, y, rtol=1e-5, atol=1e-12):
            return x
        agreed = np.minimum(x[:3], y[:3])
        rx, ry = x[:3] - agreed, y[:3] - agreed
        out = agreed + rx * y[3] + ry * x[3] + rx * ry
        for i in range(3):
            for j in range(3):
                if i != j:
                    out[i] += (rx[i] * ry[j] + rx[j] * ry[i]) / 2
        return np.array([*out, x[3] * y[3]]) / (out.sum() + x[3] * y[3])

    for r in rows(spark, "q_fuse_ccf"):
        want = ops[r.day][0]
        for x in ops[r.day][1:]:
            want = ccf(want, x)
        assert np.allclose([r.b_safe, r.b_susp, r.b_atk, r.u], want, atol=2e-6)
    modes = {r.mode: r for r in rows(spark, "q_fusion_modes")}
    assert set(modes) == set(fusion.MODES) and {m.n for m in modes.values()} == {len(ops)} and all(0 <= m.mean <= m.most <= 1 for m in modes.values())
    p = [r.b_atk + r.u / 3 for r in rows(spark, "q_fuse_ccf")]
    assert abs(modes["ccf"].mean - np.mean(p)) < 1e-5


def test_intervals_hold_the_plain_value(spark):
    df = q_metrics.scored(spark, SF).orderBy("event_id").select("y", (F.col("score") >= 100).cast("int").alias("p"), (F.col("user_id") % 2).cast("int").alias("b")).collect()
    y, p, b = (np.array([r[i] for r in df]) for i in range(3))
    f1 = lambda p: 2 * ((y == 1) & (p == 1)).sum() / ((y == 1).sum() + (p == 1).sum())
    rng, n = np.random.default_rng(1), len(y)
    score = lambda i, p: 2 * ((y[i] == 1) & (p[i] == 1)).sum() / max(1, (y[i] == 1).sum() + (p[i] == 1).sum())
    kinds = {
        "q_bca_f1": (lambda i: score(i, p), 1), "q_bca_blocks": (lambda i: score(i, p), 50), "q_bca_paired": (lambda i: score(i, p) - score(i, b), 1),
    }
    for name, (statistic, block) in kinds.items():
        start = lambda: (rng.integers(0, n - block + 1, -(-n // block))[:, None] + np.arange(block)).reshape(-1)[:n]
        draws = np.array([statistic(start()) for _ in range(1500)])
        left = np.array([statistic(np.delete(np.arange(n), np.arange(s, min(s + block, n)))) for s in range(0, n, block)])
        low, high = E.bca_endpoints(statistic(np.arange(n)), draws, left, np.ones(len(left)))
        (r,) = rows(spark, name)
        assert abs(r.value - statistic(np.arange(n))) < 1e-6
        assert abs(r.low - low) < 0.1 * (high - low) and abs(r.high - high) < 0.1 * (high - low), name
    (r,) = rows(spark, "q_bootstrap_f1")
    assert abs(r.f1 - f1(p)) < 1e-6 and r.low <= r.f1 <= r.high


def test_summary_of_volumes(spark):
    (r,) = rows(spark, "q_vus_summary")
    df = q_metrics.scored(spark, SF)
    assert r.most == E.median_run(df, ["user_id"], "event_id", "y") and 0 < r.n_hit <= r.n_runs and 0 < r.vus_pr < r.vus_roc < 1
    assert abs(r.vus_roc - E.M.vus(df, ["user_id"], "event_id", "y", "score", r.most, 3).first()[0]) < 1e-6


def test_studies(spark):
    acc = {r.sigma: r.accuracy for r in rows(spark, "q_signature_noise")}
    assert acc[0.0] == 1.0 >= acc[0.05] >= acc[0.3]
    t = {r.sigma: r.accuracy for r in rows(spark, "q_student_noise")}
    assert t[0.0] == 1.0 >= t[0.05] >= t[0.3]
    got = {r.kind: r for r in rows(spark, "q_severity_study")}
    assert got["volumetric"].f1 > got["slowloris"].f1 and got["volumetric"].ks > got["slowloris"].ks
    assert got["volumetric"].p < 0.05 and {r.realism for r in got.values()} <= {"weak", "outlier", "realistic"}
    seeds = {r.metric: r for r in rows(spark, "q_run_seeds")}
    assert set(seeds) == {"f1", "f1_trivial"} and all(r.n == 3 and r.low <= r.mean <= r.high for r in seeds.values())
    assert rows(spark, "q_table_digest") == rows(spark, "q_table_digest")


def test_stl_vote(spark):
    from test_decompose import brute

    got = defaultdict(list)
    for r in rows(spark, "q_stl_vote"):
        got[r.leaf].append(r)
    leaf = sorted(got)[0]
    mine = sorted(got[leaf], key=lambda r: r.t)
    y = {r.t: r.y for r in plans.q_series.hourly(spark, SF).filter(F.col("leaf") == leaf).collect()}
    season, trend, rest = brute(np.array([y[r.t] for r in mine]), 24, 3)
    assert np.allclose([r.rest for r in mine], rest, atol=1e-5) and np.allclose([r.trend for r in mine], trend, atol=1e-5)
    assert [r.vote for r in mine] == (np.abs(rest) > 3 * rest.std()).astype(int).tolist()


def test_forecasts_and_refits(spark):
    from test_forecast import ridge, terms

    p = q_models.FORECASTER
    e = spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'view'").orderBy("ts").collect()
    when, y = [r.ts.replace(microsecond=0) for r in e], np.array([r.value for r in e])
    x, train = np.array([terms(p, t) for t in when]), np.array([t.isoformat() < "2024-01-20" for t in when])
    want = x @ ridge(p, x[train], y[train])
    got = {r.event_id: r for r in rows(spark, "q_forecast")}
    assert all(abs(got[r.event_id].yhat - w) < 1e-3 and got[r.event_id].low < w < got[r.event_id].high for r, w, t in zip(e, want, train) if not t)
    day = np.array([t.toordinal() for t in when])
    origin, folds, n, sse = day.max(), 0, 0, 0.0
    while origin >= day.min() + 14:
        test = day == origin
        if test.any():
            folds, n, sse = folds + 1, n + test.sum(), sse + ((y[test] - x[test] @ ridge(p, x[day < origin], y[day < origin])) ** 2).sum()
        origin -= 3
    r = next(r for r in rows(spark, "q_rolling_refits") if r.leaf == "view")
    assert (r.n_folds, r.n) == (folds, n) and abs(r.mse - sse / n) < 1e-3 * sse / n and abs(r.r2 - (1 - sse / n / y.var())) < 1e-4


def test_the_kernel_machine_of_the_days(spark):
    ts, train, x = days(spark)
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    got = {r.ts: r.score for r in rows(spark, "q_one_class_kernel")}
    s = np.array([got[t] for t in ts])
    # Outside are at most a tenth of the days of training; of those, the farthest is at least on the edge.
    assert (s[train] > 1e-3).mean() <= 0.1 and s[train][np.abs(z[train]).max(axis=1).argmax()] > -1e-3
    alpha, rho = models.support_vectors(z[train], 0.1, 1 / (3 * z[train].var()))
    k = np.exp(-((z[:, None] - z[train][None]) ** 2).sum(axis=2) / (3 * z[train].var()))
    assert np.allclose(s, rho - k @ alpha, atol=1e-3)


def test_decisions_by_forecasts_and_tails(spark):
    from test_forecast import ridge, terms

    from tarnwatch.plans import detection as D
    from tarnwatch.plans.q_detection import MODELLED

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    resid = D.residuals(D.leaves(D.cells(events)), MODELLED)
    got = [r for r in resid.filter("leaf = 'count:view'").orderBy("win_start").collect()]
    x = np.array([terms(MODELLED.forecaster, r.win_start) for r in got])
    y, calib = np.array([r.y for r in got]), np.array([r.calib for r in got])
    assert np.allclose([r.yhat for r in got], x @ ridge(MODELLED.forecaster, x[calib], y[calib]), atol=1e-6)
    plain = [r for r in D.residuals(D.leaves(D.cells(events))).filter("leaf = 'count:view'").orderBy("win_start").collect()]
    assert [r.calib for r in plain] == [r.calib for r in got]
    out = rows(spark, "q_decision_modelled")
    assert len(out) == 30 and all(0 <= r.proj_atk <= 1 and r.gate_open == (r.proj_atk >= r.delta) for r in out)
    ev = D.evidence(resid, MODELLED).filter("leaf = 'count:view'").orderBy("day").collect()
    size = np.abs([r.resid for r in got])
    susp, atk = (np.quantile(size[calib], q) for q in (0.9, 0.97))  # too few peaks for a tail
    atk, base = max(atk, 1.1 * susp), 0.9 * susp
    n = np.clip((size - susp) / (atk - susp), 0, 1)
    p = np.clip((susp - size) / (susp - base), 0, 1)
    assert abs(sum(r.ev_n for r in ev) - n.sum()) < 1e-6 and abs(sum(r.ev_p for r in ev) - p.sum()) < 1e-6


def test_train_span_audit(spark):
    from tarnwatch.operators import labelling
    from tarnwatch.plans.q_series import catalog, hourly

    got = rows(spark, "q_train_span_audit")
    train = F.col("t") < F.lit("2024-01-20").cast("timestamp_ntz")
    labels = labelling.consensus_labels(hourly(spark, SF).filter(train), ["leaf"], "t", "y", 24, outer=2).collect()
    assert all(r.label == int(((r.stl or 0) + r.hampel + r.cusum) >= 2) for r in labels)
    n = defaultdict(int)
    for r in labels:
        n[r.t] += r.label
    known = [(r.start, r.end) for r in catalog(spark).collect()]
    want = sorted(((-k, t) for t, k in n.items() if k and not any(a <= t <= b for a, b in known)))[:50]
    assert sorted((-r.n_flags, r.t) for r in got) == want
    assert all(r.severity == ("high" if r.n_flags >= 3 else "medium" if r.n_flags == 2 else "low") for r in got)
