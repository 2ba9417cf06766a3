"""The robust decomposition against one that works on a whole series, point by point."""

import numpy as np
import pytest

from tarnwatch.operators.decompose import decompose, inner_passes, loess, robust_weights, stl_vote


def point(y, w, at, span):
    """The local line at one place, from its definition."""
    n = len(y)
    q = min(span, n)
    left = min(max(at - span // 2, 0), n - q)
    x = np.arange(left, left + q, dtype=float)
    width = max(np.abs(x - at).max() + max(0, (span - n) // 2), 1)
    r = np.abs(x - at) / width
    k = np.array([0.0 if v >= 0.999 else 1.0 if v <= 0.001 else (1 - v**3) ** 3 for v in r]) * w[left : left + q]
    if k.sum() == 0:
        return y[min(max(at, 0), n - 1)]
    mean, centre = (k * y[left : left + q]).sum() / k.sum(), (k * x).sum() / k.sum()
    spread = (k * (x - centre) ** 2).sum() / k.sum()
    slope = (k * (x - centre) * y[left : left + q]).sum() / k.sum() / spread if spread > (1e-3 * width) ** 2 else 0.0
    return mean + slope * (at - centre)


def smooth(y, w, span, extend=0):
    return np.array([point(y, w, at, span) for at in range(-extend, len(y) + extend)])


def brute(y, period, outer, seasonal=7):
    n, w, trend = len(y), np.ones(len(y)), np.zeros(len(y))
    odd = lambda v: int(np.ceil(v)) + (int(np.ceil(v)) % 2 == 0)
    for step in range(outer + 1):
        for _ in range(2):
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                cycle[p::period] = smooth((y - trend)[p::period], w[p::period], seasonal, 1)
            low = np.array([np.mean([np.mean([cycle[i + a + b + c] for a in range(period)]) for b in range(period) for c in range(3)]) for i in range(n)])
            season = cycle[period : period + n] - smooth(low, np.ones(n), odd(period + 1))
            trend = smooth(y - season, w, odd(1.5 * period / (1 - 1.5 / seasonal)))
        rest = y - season - trend
        if step < outer:
            w = robust_weights(rest, 6 * np.median(np.abs(rest)))
    return season, trend, rest


def test_local_lines_point_by_point():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8, 40):
        y, w = rng.normal(size=n), rng.random(n) * (rng.random(n) > 0.2)
        for span in (3, 7, 11):
            for extend in (0, 1):
                assert np.allclose(loess(y, w, span, extend), smooth(y, w, span, extend), atol=1e-8)


def made(n, period, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 10 + 0.01 * t + 3 * np.sin(2 * np.pi * t / period) + 0.5 * np.cos(4 * np.pi * t / period) + 0.3 * rng.normal(size=n)


def test_blocks_give_the_decomposition_of_the_whole_series(spark):
    a, b = made(700, 6, 2), made(150, 6, 3)
    a[[100, 333]] += 25
    rows = [("a", i, float(v)) for i, v in enumerate(a)] + [(None, i, float(v)) for i, v in enumerate(b)] + [("short", i, 1.0) for i in range(5)] + [("none", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int, y double").repartition(3)
    got = decompose(df, ["k"], "i", "y", 6, outer=2, settled=-1.0, rows=90).collect()
    assert len(got) == len(rows)
    for key, y in (("a", a), (None, b)):
        season, trend, rest = brute(y, 6, 2)
        mine = {r.i: r for r in got if r.k == key}
        for name, want in (("season", season), ("trend", trend), ("rest", rest)):
            assert np.allclose([mine[i][name] for i in range(len(y))], want, atol=1e-8), (key, name)
    assert all(r.rest is None for r in got if r.k in ("short", "none"))


def test_a_planted_outlier_is_found_and_does_not_bend_the_trend(spark):
    y = made(4000, 24, 4)
    hit = y.copy()
    hit[2000] += 60
    df = spark.createDataFrame([(k, i, float(v)) for k, s in (("clean", y), ("hit", hit)) for i, v in enumerate(s)], "k string, i int, y double")
    got = stl_vote(df, ["k"], "i", "y", 24, 5.0, outer=5).collect()
    trend = {k: np.array([r.trend for r in sorted(got, key=lambda r: r.i) if r.k == k]) for k in ("clean", "hit")}
    assert np.abs(trend["hit"] - trend["clean"]).max() < 0.1
    assert [r.i for r in got if r.k == "hit" and r.vote] == [2000]
    season, bent = inner_passes(hit, np.ones(4000), np.zeros(4000), 24)
    assert np.abs(bent - trend["clean"]).max() > 0.5  # without robust weights it would


def test_nulls_are_filled_by_position(spark):
    y = made(200, 6, 5)
    rows = [("k", i, None if i in (0, 50, 51) else float(v)) for i, v in enumerate(y)]
    got = {r.i: r for r in decompose(spark.createDataFrame(rows, "k string, i int, y double"), ["k"], "i", "y", 6, outer=0).collect()}
    filled = y.copy()
    filled[0], filled[50], filled[51] = y[1], y[49] + (y[52] - y[49]) / 3, y[49] + (y[52] - y[49]) * 2 / 3
    season, trend, rest = brute(filled, 6, 0)
    assert np.allclose([got[i].rest for i in range(200)], rest, atol=1e-8)
    assert pytest.approx(got[0].season + got[0].trend + got[0].rest) == filled[0]
