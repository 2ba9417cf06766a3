"""Queries of residual models, reference detectors and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, models
from ..operators.neighbours import local_outlier_factor
from ..sources import profiles
from .q_metrics import SC, scored
from .registry import query, r6, table

HOURLY = "h AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS a, sum(value) AS b, max(value) AS c FROM events GROUP BY 1)"


def wide(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day")["start"].alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("value").alias("b"), F.max("value").alias("c"))


def _train():
    return F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")


@query("q_lad_slope", "WITH r AS (SELECT event_type, value / user_id AS r, abs(user_id) AS w FROM events WHERE user_id <> 0), c AS (SELECT event_type, r, sum(w) OVER (PARTITION BY event_type ORDER BY r) AS c, sum(w) OVER (PARTITION BY event_type) AS t FROM r) SELECT event_type, round(min(r), 6) AS slope FROM c WHERE c >= t / 2e0 GROUP BY 1")
def lad_slope(spark, sf):
    return r6(models.lad_slope(table(spark, sf, "events").withColumn("x", F.col("user_id").cast("double")), ["event_type"], "x", "value"))


@query("q_seasonal_model")
def seasonal(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("leaf"), "ts", "value")
    out = models.seasonal_predict(df, models.seasonal_fit(df, "leaf", "ts", "value"), "leaf", "ts")
    return out.groupBy("leaf").agg(F.round(F.avg("yhat"), 4).alias("mean_yhat"), F.round(F.avg("value"), 4).alias("mean_y"))


MED = ", ".join(f"quantile_cont({m}, 0.5) AS m{m}" for m in "abc")


@query("q_robust_z", f"WITH {HOURLY}, m AS (SELECT {MED} FROM h WHERE ts < TIMESTAMP '2024-01-20'), d AS (SELECT quantile_cont(abs(a - ma), 0.5) AS da, quantile_cont(abs(b - mb), 0.5) AS db, quantile_cont(abs(c - mc), 0.5) AS dc FROM h, m WHERE ts < TIMESTAMP '2024-01-20') SELECT ts, round(greatest(abs(a - ma) / (1.4826e0 * da), abs(b - mb) / (1.4826e0 * db), abs(c - mc) / (1.4826e0 * dc)), 6) AS score FROM h, m, d")
def robust_z(spark, sf):
    return r6(models.robust_z(wide(spark, sf), _train(), ["a", "b", "c"]).select("ts", "score"))


@query("q_shewhart", f"WITH {HOURLY}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS da, stddev_pop(b) AS db, stddev_pop(c) AS dc FROM h WHERE ts < TIMESTAMP '2024-01-20') SELECT ts, round((least(greatest((a - ma) / da, 0) / 3, 1) + least(greatest((b - mb) / db, 0) / 3, 1) + least(greatest((c - mc) / dc, 0) / 3, 1)) / 3, 6) AS score FROM h, m")
def shewhart(spark, sf):
    return r6(models.shewhart(wide(spark, sf), _train(), ["a", "b", "c"]).select("ts", "score"))


@query("q_pca_error")
def pca_error(spark, sf):
    return models.pca_error(wide(spark, sf), _train(), ["a", "b", "c"], 1).select("ts", F.round("score", 2).alias("score"))


@query("q_isolation_forest")
def isolation_forest(spark, sf):
    return r6(models.isolation_forest(wide(spark, sf), _train(), ["a", "b", "c"], trees=50, sample=64).select("ts", "score"))


@query("q_bootstrap_f1")
def bootstrap(spark, sf):
    return r6(models.bootstrap_f1(scored(spark, sf).withColumn("p", (F.col("score") >= 100).cast("int")), "event_id", "y", "p", replicates=200))


@query("q_score_votes", f"WITH {SC}, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, avg((score >= 100)::INT) AS n FROM sc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC) AS k FROM d) SELECT day, round(avg(n), 6) AS mean_n, round(max(n), 6) AS max_n, round(avg(CASE WHEN k <= 3 THEN n END), 6) AS top3_n, round(avg((n >= 0.1)::INT), 6) AS vote FROM r GROUP BY day")
def score_votes(spark, sf):
    d = scored(spark, sf).groupBy(F.window("ts", "1 day")["start"].alias("day"), "event_type").agg(F.avg((F.col("score") >= 100).cast("double")).alias("n"))
    top = F.slice(F.sort_array(F.collect_list("n"), False), 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return r6(d.groupBy("day").agg(F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), mean.alias("top3_n"), F.avg((F.col("n") >= 0.1).cast("double")).alias("vote")))


@query("q_profile_traffic", "SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, round(avg(value), 6) AS speed_mean, round(coalesce(stddev_samp(value), 0), 6) AS speed_std, round(avg((value < 35)::INT), 6) AS slow_share, round(quantile_cont(value, 0.1), 6) AS speed_p10 FROM events GROUP BY 1")
def profile_traffic(spark, sf):
    df = table(spark, sf, "events").select(F.window("ts", "1 day")["start"].alias("timestamp"), F.col("event_type").alias("sensor_id"), F.col("value").alias("speed"))
    return r6(profiles.traffic(df).drop("label"))


@query("q_volatile_sensors", "SELECT event_type AS sensor_id, round(var_samp(value), 4) AS variance FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 ORDER BY 2 DESC LIMIT 2")
def volatile(spark, sf):
    df = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("sensor_id"), F.col("value").alias("speed"))
    return profiles.volatile_sensors(df, "2024-01-15", 2).select("sensor_id", F.round("variance", 4).alias("variance"))


@query("q_weighted_rollup", "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, round(sum(l_extendedprice), 2) AS total, round(sum(l_discount * (abs(l_quantity) + 1e-9)) / sum(abs(l_quantity) + 1e-9), 6) AS discount FROM lineitem GROUP BY 1")
def weighted_rollup(spark, sf):
    w = F.abs(F.col("l_quantity")) + 1e-9
    day = F.window("l_shipdate", "1 day")["start"].alias("day")
    return table(spark, sf, "lineitem").groupBy(day).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.sum(F.col("l_discount") * w) / F.sum(w), 6).alias("discount"))


_LINES = "pr AS (SELECT a.event_type, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS k FROM dl a JOIN dl b ON a.event_type = b.event_type AND a.x < b.x), ls AS (SELECT pr.event_type, m, k, sum(abs(y - k - m * x)) AS loss FROM pr JOIN dl ON dl.event_type = pr.event_type GROUP BY ALL), bs AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY loss, m) = 1)"


def _daily_pairs(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"), F.sum("value").alias("y"))


@query("q_lad_line", f"WITH dl AS (SELECT event_type, ts::DATE AS day, avg(value) AS x, sum(value) AS y FROM events GROUP BY ALL), {_LINES} SELECT event_type, (SELECT count(*) FROM dl WHERE dl.event_type = bs.event_type) AS n, round(m, 5) AS slope, round(loss, 5) AS loss FROM bs")
def lad_line(spark, sf):
    out = models.lad_line(_daily_pairs(spark, sf), ["event_type"], "x", "y")
    return out.select("event_type", "n", F.round("slope", 5).alias("slope"), F.round("loss", 5).alias("loss"))


@query("q_lad_r2", """WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS x, sum(value) AS y FROM events GROUP BY ALL), nm AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM d),
pt AS (SELECT *, CASE WHEN i < m - m // 3 * 2 THEN 0 ELSE 1 + (i - (m - m // 3 * 2)) // (m // 3) END AS part FROM nm), le AS (SELECT f.f AS part, p.event_type, p.x, p.y FROM pt p JOIN (VALUES (1), (2)) f(f) ON p.part < f.f),
pr AS (SELECT a.event_type, a.part, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS k FROM le a JOIN le b ON a.event_type = b.event_type AND a.part = b.part AND a.x < b.x),
ls AS (SELECT pr.event_type, pr.part, pr.m, pr.k, sum(abs(y - k - m * x)) AS loss FROM pr JOIN le ON le.event_type = pr.event_type AND le.part = pr.part GROUP BY ALL), bs AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY event_type, part ORDER BY loss, m) = 1),
sc AS (SELECT pt.event_type, pt.part, any_value(pt.m) AS n, 1 - sum((y - k - bs.m * x) * (y - k - bs.m * x)) / (var_pop(y) * count(*)) AS r FROM pt JOIN bs ON bs.event_type = pt.event_type AND bs.part = pt.part GROUP BY ALL) SELECT event_type, any_value(n) AS n, round(avg(r), 5) AS r2 FROM sc GROUP BY 1""")
def lad_r2(spark, sf):
    return models.lad_r2(_daily_pairs(spark, sf), ["event_type"], "day", "x", "y", 2, 10).select("event_type", "n", F.round("r2", 5).alias("r2"))


#: Holidays of the forecasts: fixed values.
FORECASTER = forecast.Forecaster(day_terms=4, hour_terms=1, holidays={"2024-01-01": "new year", "2024-01-15": "local"})


@query("q_forecast")
def forecasts(spark, sf):
    """Forecasts with intervals for the days after the 20th, from those before; tests hold them against a dense solve."""
    df = table(spark, sf, "events").select(F.col("event_type").alias("leaf"), "event_id", "ts", "value")
    fitted = forecast.fit(df.filter(_train()), ["leaf"], "ts", "value", FORECASTER)
    out = forecast.predict(df.filter(~_train()), fitted, ["leaf"], "ts", FORECASTER)
    return out.select("leaf", "event_id", *[F.round(c, 4).alias(c) for c in ("yhat", "low", "high")])


@query("q_rolling_refits")
def rolling_refits(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("leaf"), "ts", "value")
    return r6(forecast.rolling_refits(df, ["leaf"], "ts", "value", FORECASTER))


@query("q_one_class_kernel")
def one_class_kernel(spark, sf):
    return models.one_class_kernel(wide(spark, sf), _train(), ["a", "b", "c"], nu=0.1).select("ts", F.round("score", 4).alias("score"))


@query("q_outlier_hours", """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS t, count(*)::DOUBLE AS a, sum(value) AS b, max(value) AS c FROM events GROUP BY 1), s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS da, stddev_pop(b) AS db, stddev_pop(c) AS dc FROM h WHERE t < TIMESTAMP '2024-01-20'),
z AS MATERIALIZED (SELECT t, t < TIMESTAMP '2024-01-20' AS tr, (a - ma) / da AS a, (b - mb) / db AS b, (c - mc) / dc AS c FROM h, s), d AS MATERIALIZED (SELECT x.t, y.t AS u, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d, x.tr FROM z x JOIN z y ON y.tr),
n AS MATERIALIZED (SELECT * FROM d WHERE tr AND t <> u QUALIFY row_number() OVER (PARTITION BY t ORDER BY d) <= 10), r AS (SELECT t, max(d) AS reach FROM n GROUP BY t), l AS (SELECT n.t, 1 / greatest(avg(greatest(d, reach)), 1e-12) AS dens FROM n JOIN r ON r.t = n.u GROUP BY n.t),
q AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY d) <= 10) SELECT q.t, round(avg(dens) * greatest(avg(greatest(d, reach)), 1e-12), 6) AS score FROM q JOIN r ON r.t = q.u JOIN l ON l.t = q.u GROUP BY q.t""")
def outlier_hours(spark, sf):
    h = table(spark, sf, "events").groupBy(F.window("ts", "1 hour")["start"].alias("t")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("value").alias("b"), F.max("value").alias("c"))
    return r6(local_outlier_factor(h, F.col("t") < F.lit("2024-01-20").cast("timestamp_ntz"), ["a", "b", "c"], 10).select("t", "score"))


@query("q_outlier_factor")
def outlier_factor(spark, sf):
    return r6(local_outlier_factor(wide(spark, sf), _train(), ["a", "b", "c"], k=5).select("ts", "score"))


@query("q_one_class")
def one_class(spark, sf):
    return models.one_class(wide(spark, sf), _train(), ["a", "b", "c"]).select("ts", F.round("score", 4).alias("score"))
