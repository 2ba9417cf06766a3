"""The forecaster against dense solves on the readings themselves."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import forecast as P

START = dt.datetime(2024, 1, 1)
HOLIDAYS = {"2024-01-10": "local", "2024-01-24": "local", "2024-01-17": "fair"}


def terms(p, when):
    """The row of terms of one time, one by one."""
    t = (when - dt.datetime(1970, 1, 1)).total_seconds()
    name = p.holidays.get(when.date().isoformat())
    off = when.weekday() >= 5 or name is not None
    row = [1.0]
    for period, n, use in ((604800, p.week_terms, True), (86400, p.day_terms, not off), (86400, p.day_terms, off), (3600, p.hour_terms, True)):
        for f in (math.sin, math.cos):
            row += [f(2 * math.pi * k * (t % 604800) / period) * use for k in range(1, n + 1)]
    return row + [float(name == h) for h in p.names]


def ridge(p, x, y):
    prior = p.ridge * np.diag([1e-9] + [1.0] * (x.shape[1] - 1))
    return np.linalg.solve(x.T @ x + prior, x.T @ y)


def made(days, seed, noise=1.0, every=600):
    rng = np.random.default_rng(seed)
    times = [START + dt.timedelta(seconds=every * i) for i in range(days * 86400 // every)]
    level = np.array([20 + (6 if t.weekday() < 5 else 2) * math.sin(2 * math.pi * t.hour / 24) + 2 * math.cos(2 * math.pi * t.minute / 60) - (5 if t.date().isoformat() in HOLIDAYS else 0) for t in times])
    return times, level, level + noise * rng.normal(size=len(times))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, y double")


@pytest.fixture(scope="module")
def utc(spark):
    # Times go in and out as they are in UTC.
    return lambda t: t.replace(tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("multiplicative", [False, True])
def test_coefficients_of_a_dense_solve(spark, utc, multiplicative):
    p = P.Forecaster(week_terms=2, day_terms=3, hour_terms=2, holidays=HOLIDAYS, multiplicative=multiplicative)
    times, _, y = made(28, 1)
    rows = [("a", utc(t), float(v)) for t, v in zip(times, y)] + [(None, utc(t), float(v) * 2) for t, v in zip(times[:3000], y)] + [("a", utc(START), None), ("a", None, 1.0)]
    got = {r.k: r for r in P.fit(frame(spark, rows), ["k"], "ts", "y", p).collect()}
    for k, tt, yy in (("a", times, y), (None, times[:3000], 2 * y[:3000])):
        x = np.array([terms(p, t) for t in tt])
        v = np.log(yy) if multiplicative else yy
        beta = ridge(p, x, v)
        assert got[k].n == len(tt) and np.allclose(got[k].beta, beta, atol=1e-6)
        rest = v - x @ beta
        inverse = np.linalg.inv(x.T @ x + p.ridge * np.diag([1e-9] + [1.0] * (x.shape[1] - 1)))
        assert abs(got[k].noise - rest @ rest / (len(tt) - np.trace(inverse @ x.T @ x))) < 1e-6
    df = frame(spark, rows)
    out = P.predict(df, P.fit(df, ["k"], "ts", "y", p), ["k"], "ts", p).filter("k = 'a' AND ts IS NOT NULL").select(F.unix_seconds("ts").alias("t"), "yhat", "low", "high").collect()
    x = np.array([terms(p, t) for t in times])
    mean = x @ ridge(p, x, np.log(y) if multiplicative else y)
    want = {int(t.replace(tzinfo=dt.timezone.utc).timestamp()): v for t, v in zip(times, np.exp(mean) if multiplicative else mean)}
    assert all(abs(r.yhat - want[r.t]) < 1e-6 and r.low < r.yhat < r.high for r in out) and len(out) == len(times) + 1


def test_the_interval_holds_about_its_share_of_held_out_readings(spark, utc):
    p = P.Forecaster(holidays=HOLIDAYS)
    times, _, y = made(42, 2)
    rows = [("a", utc(t), float(v)) for t, v in zip(times, y)] + [("new", utc(START), 1.0)]
    df = frame(spark, rows)
    cutoff = F.lit("2024-02-05").cast("timestamp")
    fitted = P.fit(df.filter((F.col("ts") < cutoff) & (F.col("k") == "a")), ["k"], "ts", "y", p)
    test = P.predict(df.filter(F.col("ts") >= cutoff), fitted, ["k"], "ts", p)
    inside = test.agg(F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double"))).first()[0]
    assert 0.93 < inside < 0.97
    assert P.predict(df.filter("k = 'new'"), fitted, ["k"], "ts", p).first().yhat is None
    assert P.fit(df.limit(0), ["k"], "ts", "y", p).count() == 0


def test_refits_are_those_of_each_fold(spark, utc):
    p = P.Forecaster(week_terms=2, day_terms=3, hour_terms=1, holidays=HOLIDAYS)
    times, _, y = made(30, 3, every=1800)
    keep = [i for i, t in enumerate(times) if t.day != 20]  # a day without readings
    times, y = [times[i] for i in keep], y[keep]
    rows = [("a", utc(t), float(v)) for t, v in zip(times, y)] + [("b", utc(t), float(v)) for t, v in zip(times[:200], y)]
    got = {r.k: r for r in P.rolling_refits(frame(spark, rows), ["k"], "ts", "y", p, 14, 3, 2).collect()}
    x, day = np.array([terms(p, t) for t in times]), np.array([(t - START).days for t in times])
    origin, folds, n, sse = day.max() + 1 - 2, 0, 0, 0.0
    while origin >= 14:
        test = (day >= origin) & (day < origin + 2)
        if test.any():
            beta = ridge(p, x[day < origin], y[day < origin])
            folds, n, sse = folds + 1, n + test.sum(), sse + ((y[test] - x[test] @ beta) ** 2).sum()
        origin -= 3
    a, b = got["a"], got["b"]
    assert (a.n_folds, a.n) == (folds, n) and abs(a.mse - sse / n) < 1e-6 and abs(a.r2 - (1 - sse / n / y.var())) < 1e-6
    rest = y[:200] - x[:200] @ ridge(p, x[:200], y[:200])
    assert b.n_folds == 0 and abs(b.mse - (rest**2).mean()) < 1e-5
