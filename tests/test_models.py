import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import audit, models
from tarnwatch.operators.neighbours import local_outlier_factor


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), i < 300) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(999, 9.0, -9.0, False)]
    return spark.createDataFrame(rows, "i int, a double, b double, train boolean")


@pytest.mark.parametrize("build", [models.robust_z, models.pca_error, models.isolation_forest, local_outlier_factor, models.one_class])
def test_an_outlier_has_the_highest_score(points, build):
    more = {"components": 1} if build is models.pca_error else {"k": 10} if build is local_outlier_factor else {}
    df = build(points, F.col("train"), ["a", "b"], **more)
    scores = {r.i: r.score for r in df.collect()}
    assert len(scores) == 401 and sorted(scores.values()).index(scores[999]) >= 395


def test_lad_slope_is_the_best(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60)
    got = models.lad_slope(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double"), ["k"], "x", "y").first().slope
    loss = lambda s: np.abs(y - s * x).sum()
    assert all(loss(got) <= loss(s) + 1e-9 for s in y / x)


def test_seasonal_model_recovers_a_wave(spark):
    df = spark.range(24 * 28).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    df = df.withColumn("y", 5 + 2 * F.sin(2 * math.pi * F.unix_seconds("ts") / 86400.0))
    out = models.seasonal_predict(df, models.seasonal_fit(df, "k", "ts", "y"), "k", "ts")
    assert out.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 0.01


def test_correlation_summary(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=500)
    rows = [(float(x), float(x + 0.1 * e), float(z)) for x, e, z in zip(a, rng.normal(size=500), rng.normal(size=500))]
    got = audit.correlation_summary(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert got["band"] == "HIGH" and got["vif"]["a"] > 20 and got["vif"]["c"] < 1.2 and got["bartlett"] > 100


def test_bootstrap_interval_holds_the_value(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"), ((F.col("id") % 5 == 0) & (F.col("id") % 3 > 0)).cast("int").alias("p"))
    r = models.bootstrap_f1(df, "id", "y", "p").first()
    assert r.low <= r.f1 <= r.high and r.high - r.low < 0.2


def test_a_common_row_is_drawn_in_proportion(spark):
    # 30,000 distinct rows and 15,000 copies of one, as idle telemetry.
    df = spark.range(45_000).select(F.when(F.col("id") < 30_000, F.rand(5)).otherwise(0.0).alias("a"), F.when(F.col("id") < 30_000, F.rand(6)).alias("b"))
    for seed in range(3):
        x, mean, scale = models._drawn(df, F.lit(True), ["a", "b"], 3000, seed)
        assert len(x) == 3000 and 0.29 < (abs(x * scale + mean) < 1e-9).all(axis=1).mean() < 0.38
    assert len(models._draw(df, F.lit(True), ["a", "b"], 100_000, 7)) == 45_000 and len(models._draw(df, F.lit(False), ["a", "b"], 10, 7)) == 0
