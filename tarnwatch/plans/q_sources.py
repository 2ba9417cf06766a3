"""Queries of profiles, splits, joins by time, training and small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import opinions as O
from ..operators import attribution as A
from ..operators import audit, fusion, metrics, timeseries
from ..sources import profiles
from . import detection as D
from .q_detection import SPINE
from .q_metrics import ATT, _scores
from .q_models import HOURLY, wide
from .q_series import DAILY, daily
from .registry import query, r6, table


def _ntz(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("q_profile_network", "SELECT ts AS timestamp, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id::DOUBLE AS user_id, 0 AS label FROM events")
def profile_network(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(F.col("ts").cast("string").alias("timestamp"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string")).alias("value"), F.col("user_id").cast("string").alias("user_id"))
    return _ntz(profiles.network(raw))


@query("q_profile_water", "SELECT ts AS timestamp, value AS ph, (value > 100)::INT AS label FROM events")
def profile_water(spark, sf):
    raw = table(spark, sf, "events").select(F.col("ts").cast("string").alias("Time"), F.when(F.col("value") > 100, "TRUE").otherwise("0").alias("EVENT"), F.col("value").cast("string").alias("ph"))
    return _ntz(profiles.water(raw))


@query("q_profile_flows", "SELECT TIMESTAMP '2024-01-01' + (event_id % 50) * INTERVAL 10 MINUTES AS timestamp, round(sum(value), 4) AS value, round(sum(user_id), 4) AS users, round(sum(user_id * (abs(value) + 1e-9)) / sum(abs(value) + 1e-9), 6) AS mean_user, max((value > 100)::INT) AS label, round(sum(value) / (sum(user_id) + 1e-9), 6) AS ratio FROM events GROUP BY 1")
def profile_flows(spark, sf):
    raw = table(spark, sf, "events").select((F.col("event_id") % 50).alias("slot"), "value", F.col("user_id").cast("double").alias("users"), F.col("user_id").cast("double").alias("mean_user"), (F.col("value") > 100).cast("int").alias("label"))
    out = _ntz(profiles.flows(raw, "slot", "2024-01-01", ["value", "users"], {"mean_user": "value"}, {"ratio": ("value", "users")}))
    return out.withColumns({c: F.round(c, 4) for c in ("value", "users")} | {c: F.round(c, 6) for c in ("mean_user", "ratio")})


@query("q_mask", "SELECT event_type, count(*) AS n, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-06 12:00:00') AS n_null FROM events GROUP BY 1")
def mask(spark, sf):
    df = profiles.mask(table(spark, sf, "events"), ["value"], [("2024-01-05 03:00:00", "2024-01-06 12:00:00")], "ts")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"))


@query("q_split_train", "WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS m FROM events WHERE ts <= TIMESTAMP '2024-01-20'), c AS (SELECT max(ts) AS cut FROM t WHERE i <= greatest(10, floor(m * 0.75e0))) SELECT CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'test' WHEN ts <= cut THEN 'model' ELSE 'calibration' END AS part, count(*) AS n FROM events, c GROUP BY 1")
def split_train(spark, sf):
    return profiles.split_train(table(spark, sf, "events"), "2024-01-20", "ts").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("q_long_wide", "SELECT ts::DATE AS day, round(sum(value), 4) AS a_value, count(*) AS n FROM events GROUP BY 1")
def long_wide(spark, sf):
    """To long form and back: the sums stay."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    w = profiles.to_wide(profiles.to_long(d, ["a", "b"], "day"), "day", "metric", ["value"], ["a", "b"])
    return w.select("day", F.round(F.col("a"), 4).alias("a_value"), F.col("b").cast("long").alias("n"))


@query("q_correlation_suite", f"WITH {HOURLY}, r AS (SELECT count(*) AS n, corr(a, b) AS r FROM h) SELECT n, round(abs(r), 6) AS mean_abs, round(abs(r), 6) AS max_abs, round(1 + abs(r), 6) AS radius, round(1 / (1 - r * r), 4) AS vif, round(-(n - 1 - 9 / 6e0) * ln(1 - r * r), 4) AS bartlett, CASE WHEN abs(r) < 0.3 THEN 'LOW' WHEN abs(r) < 0.6 THEN 'MODERATE' ELSE 'HIGH' END AS band FROM r")
def correlation_suite(spark, sf):
    s = audit.correlation_summary(wide(spark, sf), ["a", "b"])
    row = (s["n"], round(s["mean_abs"], 6), round(s["max_abs"], 6), round(s["radius"], 6), round(s["vif"]["a"], 4), round(s["bartlett"], 4), s["band"])
    return spark.createDataFrame([row], "n long, mean_abs double, max_abs double, radius double, vif double, bartlett double, band string")


@query("q_consensus", "SELECT event_id, ((value > 50)::INT + (user_id % 2 = 0)::INT + (event_type = 'error')::INT >= 2)::INT AS label FROM events")
def consensus(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") > 50).cast("int").alias("a"), (F.col("user_id") % 2 == 0).cast("int").alias("b"), (F.col("event_type") == "error").cast("int").alias("c"))
    return df.select("event_id", timeseries.consensus(["a", "b", "c"]).alias("label"))


@query("q_contrast", f"WITH {ATT} SELECT day, type, grp, round(score - avg(score) OVER (PARTITION BY day, grp), 6) AS score FROM sco")
def contrast(spark, sf):
    return r6(A.contrast(_scores(spark, sf), "day").select("day", "type", "grp", "score"))


@query("q_transition", "WITH t AS (SELECT DISTINCT event_type AS type FROM events), p AS (SELECT a.type, b.type AS next, CASE WHEN a.type = b.type THEN 0.8e0 WHEN a.type = 'click' AND b.type = 'error' THEN 0.15e0 ELSE 0.2e0 / ((SELECT count(*) FROM t) - 1) END AS p FROM t a, t b), m AS (SELECT * FROM p), s AS (SELECT type, sum(p) AS s FROM m GROUP BY 1), o AS (SELECT event_type AS type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT m.type, m.next, round(p / s, 6) AS p, (SELECT count(*) FROM o WHERE o.type = m.type AND o.next = m.next) AS n FROM m JOIN s USING (type)")
def transition(spark, sf):
    """The chain's matrix over the types of the table, beside how often each step occurs in it."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    types = sorted(r[0] for r in e.select("event_type").distinct().collect())  # as few as there are types
    m = A.transition_matrix(types, 0.8, {("click", "error"): 0.15})
    steps = e.select(F.col("event_type").alias("type"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next")).groupBy("type", "next").agg(F.count(F.lit(1)).alias("n"))
    p = spark.createDataFrame([(a, b, v) for a, row in zip(types, m, strict=True) for b, v in zip(types, row, strict=True)], "type string, next string, p double")
    return r6(p.join(steps, ["type", "next"], "left").select("type", "next", "p", F.coalesce("n", F.lit(0)).alias("n")))


@query("q_novelty_entropy", f"WITH {ATT}, s AS (SELECT day, b / nullif(sum(b) OVER (PARTITION BY day), 0) AS p FROM bel) SELECT day, round(coalesce(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(3), 1), 6) AS entropy FROM s GROUP BY day")
def novelty_entropy(spark, sf):
    b = A.beliefs(_scores(spark, sf), "day").groupBy("day").agg(F.collect_list("b").alias("b"))
    return r6(b.select("day", metrics.entropy(F.col("b")).alias("entropy")))


@query("q_mase_trust", "SELECT event_id, round(coalesce(greatest(0.05, least(1, 1 - CASE WHEN event_id % 9 > 0 THEN value / 100 END)), 0.05), 6) AS trust FROM events")
def mase_trust(spark, sf):
    m = F.when(F.col("event_id") % 9 > 0, F.col("value") / 100)
    return r6(table(spark, sf, "events").select("event_id", timeseries.mase_trust(m).alias("trust")))


REL = "SELECT event_id, value AS z, CASE WHEN value < 72 THEN 1 WHEN value < 80 THEN 1 - (value - 72) / (8 + 1e-9) ELSE 0 END AS p, CASE WHEN value < 80 THEN 0 WHEN value < 160 THEN (value - 80) / (80 + 1e-9) ELSE 1 END AS n FROM events"


@query("q_trapezoid_relative", f"WITH t AS ({REL}) SELECT event_id, round(p, 6) AS p, round(1 - p - n, 6) AS s, round(n, 6) AS n FROM t")
def trapezoid_relative(spark, sf):
    mass = O.trapezoid_relative(F.col("value"), F.lit(80.0), F.lit(160.0))
    return r6(table(spark, sf, "events").select("event_id", *[m.alias(x) for m, x in zip(mass, "psn", strict=True)]))


@query("q_replay_fusion", """WITH t AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, f, value AS v, 80 * f AS s, 160 * f AS a FROM events CROSS JOIN (VALUES (0.5e0), (1e0), (1.5e0)) x(f)),
m AS (SELECT leaf, day, f, CASE WHEN v <= 0.9e0 * s THEN 1 WHEN v < s THEN 1 - (v - 0.9e0 * s) / (s - 0.9e0 * s) ELSE 0 END AS p, CASE WHEN v <= s THEN 0 WHEN v < a THEN (v - s) / (a - s) ELSE 1 END AS n FROM t),
e AS (SELECT leaf, day, f, sum(p)::DOUBLE AS p, sum(1 - p - n)::DOUBLE AS s, sum(n)::DOUBLE AS n FROM m GROUP BY ALL), o AS (SELECT *, 3 / (3 + p + s + n) AS u FROM e),
g AS (SELECT day, f, sum((1 - u) * p) / sum(1 - u) AS p, sum((1 - u) * s) / sum(1 - u) AS s, sum((1 - u) * n) / sum(1 - u) AS n FROM o GROUP BY ALL) SELECT day, f, round((n + 1) / (3 + p + s + n), 6) AS proj_atk FROM g""")
def replay_fusion(spark, sf):
    """Thresholds scaled by stated factors, evidence rebuilt and fused again, in one job."""
    df = table(spark, sf, "events").select(F.col("event_type").alias("leaf"), F.window("ts", "1 day")["start"].alias("day"), "value", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias("f"))
    mass = O.trapezoid(F.col("value"), 80 * F.col("f"), 160 * F.col("f"), direction="pos")
    ev = df.select("leaf", "day", "f", *[m.alias(n) for m, n in zip(mass, "psn", strict=True)]).groupBy("leaf", "day", "f").agg(*[F.sum(c).alias(c) for c in "psn"])
    op = ev.select("leaf", "day", "f", *O.from_evidence(tuple(F.col(c) for c in "psn")).columns())
    return r6(fusion.fuse(op, ["day", "f"]).select("day", "f", O.Opinion.of().projected()[2].alias("proj_atk")))


@query("q_views", "SELECT 'type' AS view, event_type AS item, count(*) AS n, round(avg((value >= 100)::INT), 6) AS rate FROM events GROUP BY 2 UNION ALL SELECT 'weekday', isodow(ts)::VARCHAR, count(*), round(avg((value >= 100)::INT), 6) FROM events GROUP BY 2")
def views(spark, sf):
    """Two diagnostic views under one another, with a tag."""
    e = table(spark, sf, "events")
    view = lambda name, key: e.groupBy(key.cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") >= 100).cast("double")).alias("rate")).select(F.lit(name).alias("view"), "item", "n", "rate")
    return r6(view("type", F.col("event_type")).unionByName(view("weekday", F.weekday("ts") + 1)))


def _sides(spark, sf):
    d = daily(spark, sf).filter("n % 3 > 0")
    return (d.filter(F.col("event_type") == t).select("day", F.col("y").alias(t)) for t in ("click", "view"))


SIDES = "a AS (SELECT day, y AS click FROM d WHERE event_type = 'click' AND n % 3 > 0), b AS (SELECT day, y AS view FROM d WHERE event_type = 'view' AND n % 3 > 0)"


@query("q_join_inner", f"WITH {DAILY}, {SIDES} SELECT day, round(click, 6) AS click, round(view, 6) AS view FROM a JOIN b USING (day)")
def join_inner(spark, sf):
    a, b = _sides(spark, sf)
    return r6(a.join(b, "day"))


@query("q_join_left", f"WITH {DAILY}, {SIDES} SELECT day, round(click, 6) AS click, round(view, 6) AS view FROM a LEFT JOIN b USING (day)")
def join_left(spark, sf):
    a, b = _sides(spark, sf)
    return r6(a.join(b, "day", "left"))


@query("q_train_models", SPINE + """, ft AS (SELECT leaf, grp, count(*) AS n, avg(y) AS mean, 1 - sum(resid * resid) / nullif(var_pop(y) * count(*), 0) AS r2 FROM res WHERE calib AND resid IS NOT NULL GROUP BY ALL),
pr AS (SELECT leaf, avg(ev_p / 4) AS p, avg(ev_s / 4) AS s, greatest(avg(ev_n / 4), 0.005) AS n FROM ev WHERE calib GROUP BY leaf)
SELECT leaf, grp, ft.n, round(mean, 6) AS mean, round(r2, 6) AS r2, round(t_susp, 6) AS t_susp, round(t_atk, 6) AS t_atk, round(t_base, 6) AS t_base, round(p / (p + s + pr.n), 6) AS a_safe, round(s / (p + s + pr.n), 6) AS a_susp, round(pr.n / (p + s + pr.n), 6) AS a_atk FROM ft JOIN thr USING (leaf) JOIN pr USING (leaf)""")
def train_models(spark, sf):
    return r6(D.train(table(spark, sf, "events").select("ts", "event_type", "value")))
