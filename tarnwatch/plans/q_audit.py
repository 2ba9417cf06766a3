"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import opinions as O
from ..operators import audit, metrics, tails
from ..operators.calibration import quantiles
from .q_metrics import SC, scored
from .q_series import catalog
from .registry import query, r6, table

REG = "CASE WHEN isodow(ts) < 6 AND hour(ts) >= 8 AND hour(ts) < 18 THEN 'ACTIVE' ELSE 'QUIET' END"


@query("q_joint_exceedance", f"WITH n AS (SELECT {REG} AS regime, date_trunc('hour', ts)::TIMESTAMP AS win, sum((value >= 100)::INT) AS n FROM events GROUP BY ALL) SELECT regime, k::INT AS k, round(avg((n >= k)::INT), 6) AS share FROM n CROSS JOIN (SELECT unnest(range(1, 5)) AS k) GROUP BY ALL")
def joint_exceedance(spark, sf):
    df = table(spark, sf, "events").withColumns({"regime": calendar.regime_of(F.col("ts")), "win": F.date_trunc("hour", "ts")})
    return r6(audit.joint_exceedance(df, ["regime"], "win", F.col("value"), 100.0, 4))


@query("q_near_miss", "SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (value >= 75) AS high FROM events WHERE value >= 50 AND value < 100 GROUP BY 1")
def near_miss(spark, sf):
    return audit.near_miss(table(spark, sf, "events"), "ts", "value", 100.0)




@query(
    "q_episode_profile",
    """WITH g AS (SELECT user_id, ts, event_id, event_type, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200e6 THEN 1 ELSE 0 END AS nw FROM events WHERE value > 100 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS episode FROM g), k AS (SELECT user_id, episode, event_type, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT user_id, episode, event_type AS modal FROM (SELECT *, row_number() OVER (PARTITION BY user_id, episode ORDER BY n DESC, event_type) AS r FROM k) WHERE r = 1)
SELECT user_id, episode, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s, any_value(modal) AS modal, round(avg(value), 6) AS mean_score, round(max(value), 6) AS max_score FROM e JOIN m USING (user_id, episode) GROUP BY ALL""",
)
def episode_profile(spark, sf):
    from pyspark.sql import Window

    from ..functions.times import micros

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hot = table(spark, sf, "events").filter("value > 100").withColumn("_new", F.coalesce(micros("ts") - F.lag(micros("ts")).over(w) > 43200e6, F.lit(False)).cast("long"))
    hot = hot.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r6(audit.episode_profile(hot, ["user_id", "episode"], "ts", "event_type", "value").drop("severity"))


@query("q_false_alarms", f"WITH {SC}, c AS (SELECT count(*) FILTER (score >= 200) AS k, count(*)::DOUBLE AS n, 1.959963984540054e0 AS z FROM sc WHERE y = 0) SELECT k, n::BIGINT AS n, round(k / n, 6) AS far, round(greatest((k/n + z*z/(2*n)) / (1 + z*z/n) - z * sqrt((k/n)*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n), 0), 6) AS low FROM c")
def false_alarms(spark, sf):
    g = scored(spark, sf).filter("y = 0").agg(F.sum((F.col("score") >= 200).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    return r6(g.select("k", "n", metrics.ratio(F.col("k"), F.col("n")).alias("far"), metrics.wilson(F.col("k"), F.col("n").cast("double"))[0].alias("low")))


@query("q_around_events", f"WITH {SC} SELECT name, round(avg(CASE WHEN ts < s THEN score END), 6) AS before, round(avg(CASE WHEN ts >= s AND ts < e THEN score END), 6) AS during, round(avg(CASE WHEN ts >= e THEN score END), 6) AS after FROM sc JOIN cat ON ts >= s - INTERVAL 12 HOURS AND ts < e + INTERVAL 12 HOURS GROUP BY name")
def around_events(spark, sf):
    return r6(audit.around_events(scored(spark, sf), "ts", "score", catalog(spark), 43200, 43200))


@query("q_annual_projection", f"WITH {SC}, g AS (SELECT {REG} AS regime, count(*) AS n, avg((score >= 100)::INT) AS fpr FROM sc WHERE y = 0 GROUP BY 1) SELECT round(sum(n * fpr) / sum(n) * 105120, 4) AS fp_per_year FROM g")
def annual_projection(spark, sf):
    g = scored(spark, sf).filter("y = 0").groupBy(calendar.regime_of(F.col("ts")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= 100).cast("double")).alias("fpr"))
    return audit.annual_projection(g, "n", "fpr").select(F.round("fp_per_year", 4).alias("fp_per_year"))


@query("q_ks_distance", f"WITH {SC}, c AS (SELECT score, sum(y) AS a, sum(1 - y) AS b FROM sc GROUP BY 1), w AS (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM c WINDOW o AS (ORDER BY score)), m AS (SELECT max(abs(ca / (SELECT sum(a) FROM c)::DOUBLE - cb / (SELECT sum(b) FROM c)::DOUBLE)) AS ks, (SELECT sum(a) FROM c)::DOUBLE AS na, (SELECT sum(b) FROM c)::DOUBLE AS nb FROM w), x AS (SELECT ks, (sqrt(na * nb / (na + nb)) + 0.12e0 + 0.11e0 / sqrt(na * nb / (na + nb))) * ks AS x FROM m) SELECT round(ks, 6) AS ks, round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 200), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2e0 * k * k * x * x))))) END, 6) AS p FROM x")
def ks_distance(spark, sf):
    return r6(audit.ks_distance(scored(spark, sf), "score", F.col("y") == 1))


@query("q_time_to_detect", "WITH RECURSIVE v AS (SELECT event_type AS leaf, count(*) FILTER (value < 50) * 8e0 / count(*) AS p, count(*) FILTER (value >= 50) * 8e0 / count(*) AS n FROM events GROUP BY 1), z AS (SELECT leaf, p, n, 0 AS i, 0e0 AS s, 0e0 AS a FROM v UNION ALL SELECT leaf, p, n, i + 1, 0.85e0 * s + p, 0.85e0 * a + n FROM z WHERE i < 50) SELECT leaf, (min(i) FILTER (i > 0 AND a / (3 + s + a) >= 0.3))::INT AS windows FROM z GROUP BY leaf")
def time_to_detect(spark, sf):
    """How long the mix of readings of each leaf would take to open the gate."""
    share = lambda c: F.sum(c.cast("double")) * 8 / F.count(F.lit(1))
    v = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf")).agg(share(F.col("value") < 50).alias("p"), share(F.col("value") >= 50).alias("n"))
    return v.select("leaf", audit.time_to_detect(F.col("p"), F.col("n"), 0.85, 0.3).alias("windows"))


@query("q_decluster", "WITH p AS (SELECT event_type AS leaf, event_id, value FROM events WHERE value > 150), n AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY leaf ORDER BY event_id) <= 20 THEN 0 ELSE 1 END AS nw FROM p), c AS (SELECT *, sum(nw) OVER (PARTITION BY leaf ORDER BY event_id) AS c FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY leaf, c ORDER BY value DESC, event_id) AS k FROM c) SELECT leaf, event_id, round(value, 6) AS value FROM r WHERE k = 1")
def decluster(spark, sf):
    p = table(spark, sf, "events").filter("value > 150").select(F.col("event_type").alias("leaf"), "event_id", "value")
    return r6(tails.decluster(p, ["leaf"], "event_id", "value", 20))


@query("q_threshold_scales", "WITH t AS (SELECT event_type, f, 80 * f AS s, 160 * f AS a, value FROM events CROSS JOIN (VALUES (0.5e0), (1e0), (1.5e0)) v(f)), m AS (SELECT event_type, f, CASE WHEN value <= 0.9e0 * s THEN 1 WHEN value < s THEN 1 - (value - 0.9e0 * s) / (0.1e0 * s) ELSE 0 END AS p, CASE WHEN value <= s THEN 0 WHEN value < a THEN (value - s) / (a - s) ELSE 1 END AS n FROM t) SELECT event_type, f, round(sum(p), 5) AS ev_p, round(sum(1 - p - n), 5) AS ev_s, round(sum(n), 5) AS ev_n FROM m GROUP BY ALL")
def threshold_scales(spark, sf):
    df = table(spark, sf, "events").select("event_type", "value", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias("f"))
    mass = O.trapezoid(F.col("value"), 80 * F.col("f"), 160 * F.col("f"), direction="pos")
    df = df.select("event_type", "f", *[m.alias(n) for m, n in zip(mass, "psn", strict=True)])
    return df.groupBy("event_type", "f").agg(*[F.round(F.sum(c), 5).alias(f"ev_{c}") for c in "psn"])


@query("q_day_night", "SELECT CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'day' ELSE 'night' END AS part, event_type, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY ALL")
def day_night(spark, sf):
    part = F.when((F.hour("ts") >= 8) & (F.hour("ts") < 20), "day").otherwise("night").alias("part")
    return r6(quantiles(table(spark, sf, "events").select(part, "event_type", "value"), ["part", "event_type"], "value", [0.99]).withColumnRenamed("q0", "p99"))


@query("q_top_disagreements", "WITH p AS (SELECT event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT a, b, count(*) AS n FROM p WHERE a <> b GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10")
def top_disagreements(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "events").select(F.col("event_type").alias("a"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b"))
    return p.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(10)


@query("q_over_runs", "SELECT event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1")
def over_runs(spark, sf):
    return r6(audit.over_runs(table(spark, sf, "events").withColumnRenamed("event_type", "metric"), "metric", "value"))


@query("q_drop_windows")
def drop_windows(spark, sf):
    from .q_opinions import evidence

    return r6(audit.drop_windows(evidence(spark, sf), ["leaf", "day"], 0.2, ["ev_p", "ev_s", "ev_n"]))


@query("q_regime_diagnosis", f"WITH h AS (SELECT {REG} AS regime, event_type AS leaf, date_trunc('hour', ts)::TIMESTAMP AS win, max(value) AS v FROM events GROUP BY ALL), c AS (SELECT leaf, avg((v >= 100)::INT) FILTER (regime = 'ACTIVE') AS a, avg((v >= 100)::INT) FILTER (regime = 'QUIET') AS b FROM h GROUP BY leaf), f AS (SELECT regime, win, avg(v) AS v FROM h GROUP BY ALL), q AS (SELECT quantile_cont(v, 0.999) FILTER (regime = 'ACTIVE') AS a, quantile_cont(v, 0.999) FILTER (regime = 'QUIET') AS b FROM f), n AS (SELECT regime, win, sum((v >= 100)::INT) AS n FROM h GROUP BY ALL), j AS (SELECT avg((n >= 2)::INT) FILTER (regime = 'ACTIVE') AS a, avg((n >= 2)::INT) FILTER (regime = 'QUIET') AS b FROM n), r AS (SELECT (SELECT quantile_cont(a / nullif(b, 0), 0.5) FROM c) AS e, (SELECT a / nullif(b, 0) FROM q) AS f, (SELECT a / nullif(b, 0) FROM j) AS k) SELECT round(e, 6) AS evidence_ratio, round(f, 6) AS fused_ratio, round(k, 6) AS joint_ratio, CASE WHEN e > 1.05 THEN 'evidence' WHEN f > 1.05 THEN 'fusion' WHEN k > 1.05 THEN 'correlation' ELSE 'inconclusive' END AS verdict FROM r")
def regime_diagnosis(spark, sf):
    h = table(spark, sf, "events").groupBy(calendar.regime_of(F.col("ts")).alias("regime"), F.col("event_type").alias("leaf"), F.date_trunc("hour", "ts").alias("win")).agg(F.max("value").alias("v"))
    fused = h.groupBy("regime", "win").agg(F.avg("v").alias("v"))
    return r6(audit.regime_diagnosis(h, fused, "regime", "leaf", "win", "v", 100.0, 2, 1.05))


@query("q_train_span_audit")
def train_span_audit(spark, sf):
    """Hours of the training span that several types' readings make suspect, outside the known events."""
    from ..operators import labelling
    from .q_series import hourly

    train = F.col("t") < F.lit("2024-01-20").cast("timestamp_ntz")
    return labelling.train_span_audit(hourly(spark, sf), "t", "leaf", "y", train, catalog(spark), 24, 50, outer=2)
