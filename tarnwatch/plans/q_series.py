"""Queries of the time-series, join and relational operators over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decompose, joins, timeseries
from .registry import query, r6, table

#: The catalog that the queries label by: fixed values.
CATALOG = (("A", "2024-01-05 03:00:00", "2024-01-06 12:00:00"), ("B", "2024-01-06 00:00:00", "2024-01-07 00:00:00"), ("C", "2024-01-20 12:00:00", "2024-01-22 18:00:00"))
CAT = "cat(idx, name, s, e) AS (VALUES " + ", ".join(f"({i}, '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (n, a, b) in enumerate(CATALOG)) + ")"
DAILY = "d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS y, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT *, CASE WHEN (n + day(day)) % 4 = 0 THEN NULL ELSE y END AS x FROM d)"


def catalog(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CATALOG)], "idx int, name string, s string, e string").select("idx", "name", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))


def daily(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day")["start"].alias("day")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("x", F.when((F.col("n") + F.dayofmonth("day")) % 4 != 0, F.col("y")))


#: Events that a table gives: each user's high readings, as one span.
HIGH = "hi AS (SELECT user_id, 'U' || user_id AS name, min(ts) AS s, max(ts) + INTERVAL 1 SECOND AS e FROM events WHERE value > 150 GROUP BY user_id)"


def high_spans(spark, sf):
    high = table(spark, sf, "events").filter("value > 150").groupBy("user_id").agg(F.min("ts").alias("start"), (F.max("ts") + F.expr("interval 1 second")).alias("end"))
    return high.select("user_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"), "start", "end")


@query("q_forward_fill", f"WITH {DAILY} SELECT event_type, day, round(last_value(x IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS x FROM h")
def forward_fill(spark, sf):
    return r6(timeseries.forward_fill(daily(spark, sf), ["event_type"], "day", ["x"], 2).select("event_type", "day", "x"))


@query(
    "q_interpolate",
    f"""WITH {DAILY}, g AS (SELECT *, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY event_type ORDER BY day)),
p AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, max(CASE WHEN x IS NOT NULL THEN i END) OVER b AS i0, first_value(x IGNORE NULLS) OVER f AS v1, min(CASE WHEN x IS NOT NULL THEN i END) OVER f AS i1 FROM g
  WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, day, round(coalesce(x, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1), 6) AS x FROM p""",
)
def interpolate(spark, sf):
    return r6(timeseries.interpolate(daily(spark, sf), ["event_type"], "day", "x").select("event_type", "day", "x"))


@query(
    "q_hampel",
    f"""WITH {DAILY}, w AS (SELECT event_type, day, y, list(y) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM d),
m AS (SELECT *, list_sort(l)[4] AS med FROM w)
SELECT event_type, day, CASE WHEN len(l) = 7 AND abs(y - med) > 3 * list_sort(list_transform(l, lambda v: abs(v - med)))[4] / 0.6745 THEN 1 ELSE 0 END AS vote FROM m""",
)
def hampel(spark, sf):
    return timeseries.hampel(daily(spark, sf), ["event_type"], "day", "y").select("event_type", "day", "vote")


@query(
    "q_cusum",
    f"""WITH RECURSIVE {DAILY}, z AS (SELECT event_type, day, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS z, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d WINDOW p AS (PARTITION BY event_type)),
c AS (SELECT event_type, day, i, greatest(0, z - 0.5e0) AS up, greatest(0, -z - 0.5e0) AS dn FROM z WHERE i = 1 UNION ALL
  SELECT z.event_type, z.day, z.i, greatest(0, up + z.z - 0.5e0), greatest(0, dn - z.z - 0.5e0) FROM c JOIN z ON z.event_type = c.event_type AND z.i = c.i + 1)
SELECT event_type, day, CASE WHEN up > 2 OR dn > 2 THEN 1 ELSE 0 END AS vote FROM c""",
)
def cusum(spark, sf):
    return timeseries.cusum(daily(spark, sf), ["event_type"], "day", "y", limit=2.0).select("event_type", "day", "vote")


@query("q_residual_vote", f"WITH {DAILY}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, avg(y) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS tr FROM d), s AS (SELECT *, y - tr - avg(y - tr) OVER (PARTITION BY event_type, i % 7) AS r FROM t), v AS (SELECT *, stddev_pop(r) OVER (PARTITION BY event_type) AS sd FROM s) SELECT event_type, day, (abs(r) > 2 * sd)::INT AS vote FROM v")
def residual_vote(spark, sf):
    return timeseries.residual_vote(daily(spark, sf), ["event_type"], "day", "y", 7, 2.0).select("event_type", "day", "vote")


@query("q_row_windows", "SELECT event_type, (i - 1) // 10 AS win_no, max(ts) AS last_ts, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) GROUP BY ALL")
def row_windows(spark, sf):
    df = timeseries.row_windows(table(spark, sf, "events"), ["event_type"], "event_id", 10)
    return r6(df.groupBy("event_type", "win_no").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse")))


EPI = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200e6 THEN 1 ELSE 0 END AS nw FROM (SELECT DISTINCT user_id, ts FROM events WHERE value > 100) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS episode FROM g),
ep AS (SELECT user_id, episode::BIGINT AS episode, min(ts) AS s, max(ts) + INTERVAL 1 SECOND AS e, count(*) AS n FROM e GROUP BY ALL)"""


def _episodes(spark, sf):
    hot = table(spark, sf, "events").filter("value > 100").select("user_id", "ts").distinct()
    e = timeseries.episodes(hot, ["user_id"], "ts", 43200)
    return e.groupBy("user_id", "episode").agg(F.min("ts").alias("start"), (F.max("ts") + F.expr("interval 1 second")).alias("end"), F.count(F.lit(1)).alias("n"))


@query("q_episodes", EPI + " SELECT user_id, episode, s AS start_ts, e AS end_ts, n FROM ep")
def episodes(spark, sf):
    return _episodes(spark, sf).withColumnsRenamed({"start": "start_ts", "end": "end_ts"})


@query("q_episode_iou", EPI + f", {CAT}, o AS (SELECT user_id, episode, idx, name, (epoch_us(least(ep.e, cat.e)) - epoch_us(greatest(ep.s, cat.s))) / (epoch_us(greatest(ep.e, cat.e)) - epoch_us(least(ep.s, cat.s)))::DOUBLE AS iou FROM ep LEFT JOIN cat ON ep.s < cat.e AND cat.s < ep.e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, episode ORDER BY iou DESC, idx) AS k FROM o) SELECT user_id, episode, name AS period, round(CASE WHEN name IS NULL THEN 0 ELSE coalesce(iou, 0) END, 6) AS iou FROM r WHERE k = 1")
def episode_iou(spark, sf):
    return r6(joins.best_overlap(_episodes(spark, sf).select("user_id", "episode", "start", "end"), catalog(spark)).select("user_id", "episode", "period", "iou"))


@query("q_runs", f"WITH {DAILY}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d), k AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY event_type ORDER BY day) <= 2 THEN 0 ELSE 1 END AS nw FROM f WHERE n % 2 = 1), r AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY day) AS g FROM k) SELECT event_type, min(day) AS run_start, max(day) AS run_end, count(*) AS n FROM r GROUP BY event_type, g")
def runs(spark, sf):
    return timeseries.runs(daily(spark, sf).withColumn("flag", (F.col("n") % 2).cast("int")), ["event_type"], "day", "flag", 1)


@query("q_dilate", f"WITH {DAILY} SELECT event_type, day, max((n % 5 = 0)::INT) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM d")
def dilate(spark, sf):
    return timeseries.dilate(daily(spark, sf).withColumn("flag", (F.col("n") % 5 == 0).cast("int")), ["event_type"], "day", "flag", 2).select("event_type", "day", "dilated")


@query("q_flip_rate", "WITH f AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, round(coalesce(avg(CASE WHEN b IS NOT NULL THEN (event_type <> b)::INT END), 0), 6) AS flip_rate FROM f GROUP BY user_id")
def flip_rate(spark, sf):
    return r6(timeseries.flip_rate(table(spark, sf, "events"), ["user_id"], "event_id", "event_type"))


@query("q_first_by", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_by(spark, sf):
    return timeseries.first_by(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("q_mase", f"WITH {DAILY}, l AS (SELECT event_type, y, abs(y - lag(y) OVER (PARTITION BY event_type ORDER BY day)) AS dy, avg(y) OVER (PARTITION BY event_type) AS f FROM d) SELECT event_type, round(avg(abs(y - f)) / avg(dy), 6) AS mase, round(greatest(0.05, least(1, 1 - avg(abs(y - f)) / avg(dy))), 6) AS trust FROM l GROUP BY event_type")
def mase(spark, sf):
    df = daily(spark, sf).withColumn("f", F.avg("y").over(Window.partitionBy("event_type")))
    return r6(timeseries.mase(df, ["event_type"], "day", "y", "f").withColumn("trust", timeseries.mase_trust(F.col("mase"))))


@query("q_effective_n", f"WITH {DAILY}, c AS (SELECT event_type, day, y, y - avg(y) OVER (PARTITION BY event_type) AS c FROM d), l AS (SELECT *, lag(c, 1) OVER (PARTITION BY event_type ORDER BY day) AS l1, lag(c, 2) OVER (PARTITION BY event_type ORDER BY day) AS l2, lag(c, 3) OVER (PARTITION BY event_type ORDER BY day) AS l3, lag(c, 4) OVER (PARTITION BY event_type ORDER BY day) AS l4, lag(c, 5) OVER (PARTITION BY event_type ORDER BY day) AS l5 FROM c), g AS (SELECT event_type, count(y) AS n, (1 - 1 / 6e0) * coalesce(sum(c * l1) / (count(y) - 1) / var_samp(y), 0) + (1 - 2 / 6e0) * coalesce(sum(c * l2) / (count(y) - 2) / var_samp(y), 0) + (1 - 3 / 6e0) * coalesce(sum(c * l3) / (count(y) - 3) / var_samp(y), 0) + (1 - 4 / 6e0) * coalesce(sum(c * l4) / (count(y) - 4) / var_samp(y), 0) + (1 - 5 / 6e0) * coalesce(sum(c * l5) / (count(y) - 5) / var_samp(y), 0) AS w FROM l GROUP BY event_type) SELECT event_type, n, round(least(greatest(n / greatest(1 + 2 * w, 1e-9), 1), n), 6) AS n_eff FROM g")
def effective_n(spark, sf):
    return r6(timeseries.effective_n(daily(spark, sf), ["event_type"], "day", "y", 5))


@query("q_interval_label", f"WITH {CAT} SELECT event_id, (EXISTS (SELECT 1 FROM cat WHERE ts >= s AND ts < e))::INT AS label FROM events")
def interval_label(spark, sf):
    return joins.interval_label(table(spark, sf, "events").select("event_id", "ts"), "ts", catalog(spark)).select("event_id", "label")


@query("q_interval_anti", f"WITH {CAT} SELECT event_type, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM cat WHERE ts >= s AND ts < e) GROUP BY event_type")
def interval_anti(spark, sf):
    return joins.interval_join(table(spark, sf, "events"), "ts", catalog(spark), [], "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("q_first_period", f"WITH {CAT} SELECT event_id, (SELECT arg_min(name, idx) FROM cat WHERE ts >= s AND ts <= e) AS period FROM events")
def first_period(spark, sf):
    return joins.first_period(table(spark, sf, "events").select("event_id", "ts"), "ts", catalog(spark)).select("event_id", "period")


@query(
    "q_asof_nearest",
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, min(event_id) AS other FROM events WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT a.event_id, b.other, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts) AS r FROM a JOIN b USING (user_id))
SELECT a.event_id, CASE WHEN d <= 36000e6 THEN other END AS other, coalesce(d <= 36000e6, FALSE) AS matched FROM a LEFT JOIN j ON a.event_id = j.event_id AND r = 1""",
)
def asof(spark, sf):
    e = table(spark, sf, "events")
    b = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("event_id").alias("other"))
    return joins.asof_nearest(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), b, ["user_id"], "ts", ["other"], 36000).select("event_id", "other", "matched")


@query("q_label_align", "SELECT event_id, max((value > 200)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS label FROM events")
def label_align(spark, sf):
    from ..functions.times import micros

    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(-86_400_000_000, 0)
    df = table(spark, sf, "events").withColumn("_t", micros("ts"))
    return df.select("event_id", F.max((F.col("value") > 200).cast("int")).over(w).alias("label"))


@query("q_regime", "SELECT event_id, CASE WHEN isodow(ts) < 6 AND ts::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-06') AND hour(ts) >= 8 AND hour(ts) < 18 THEN 'ACTIVE' ELSE 'QUIET' END AS regime FROM events")
def regime(spark, sf):
    from ..functions.calendar import regime_of

    return table(spark, sf, "events").select("event_id", regime_of(F.col("ts"), ["2024-01-01", "2024-01-06"]).alias("regime"))


@query("q_unit_root", "WITH l AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS x FROM events), r AS (SELECT event_type, count(*) AS n, corr(y, x) AS rho1, regr_slope(y - x, x) AS b, regr_sxx(y - x, x) AS sxx, regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY 1) SELECT event_type, n, round(rho1, 6) AS rho1, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS df_stat FROM r")
def unit_root(spark, sf):
    return r6(timeseries.unit_root(table(spark, sf, "events"), ["event_type"], "event_id", "value"))


def hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf"), F.window("ts", "1 hour")["start"].alias("t")).agg(F.avg("value").alias("y"))


@query("q_stl_vote")
def stl_vote(spark, sf):
    """Robust decomposition of hourly means with a daily period; tests hold it against a brute-force one."""
    out = decompose.stl_vote(hourly(spark, sf), ["leaf"], "t", "y", 24, outer=3)
    return r6(out.select("leaf", "t", "season", "trend", "rest", "vote"))
