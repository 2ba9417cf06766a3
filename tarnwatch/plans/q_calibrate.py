"""Queries of calibration: regimes, fallbacks, folds over time, weights and discounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import opinions as O
from ..operators import ageing, fusion, tails, timeseries
from ..operators import calibration as C
from ..operators import joins as J
from .q_audit import REG
from .q_opinions import evidence, leaf_opinions
from .q_series import CAT, catalog
from .registry import query, r6, table


def _rows(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("leaf"), "ts", (F.col("value") - 50).alias("r"))


@query("q_quantiles", "SELECT event_type AS leaf, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS q0, round(quantile_cont(value, 0.9), 6) AS q1, round(quantile_cont(value, 0.99), 6) AS q2 FROM events GROUP BY 1")
def quantiles(spark, sf):
    return r6(C.quantiles(table(spark, sf, "events").withColumnRenamed("event_type", "leaf"), ["leaf"], "value", [0.5, 0.9, 0.99]))


DIR = "dr AS (SELECT event_type AS leaf, ts, value - 50 AS r, CASE event_type WHEN 'click' THEN 'pos' WHEN 'view' THEN 'neg' WHEN 'error' THEN 'both' ELSE 'sym' END AS d FROM events), br AS (SELECT leaf, 'pos' AS branch, r AS e FROM dr WHERE d IN ('pos', 'both') AND r > 0 UNION ALL SELECT leaf, 'neg', -r FROM dr WHERE d IN ('neg', 'both') AND r < 0 UNION ALL SELECT leaf, 'sym', abs(r) FROM dr WHERE d = 'sym')"


def _directed(spark, sf):
    d = F.when(F.col("leaf") == "click", "pos").when(F.col("leaf") == "view", "neg").when(F.col("leaf") == "error", "both").otherwise("sym")
    return C.directed(_rows(spark, sf), "r", d)


@query("q_directed_thresholds", f"WITH {DIR}, q AS (SELECT leaf, branch, count(*) AS n, greatest(quantile_cont(e, 0.9), 1e-9) AS s, quantile_cont(e, 0.97) AS a FROM br GROUP BY ALL) SELECT leaf, branch, n, round(s, 6) AS t_susp, round(greatest(a, 1.1 * s), 6) AS t_atk, round(0.9 * s, 6) AS t_base, NULL::VARCHAR AS reason FROM q")
def directed_thresholds(spark, sf):
    return r6(C.thresholds_with_reason(_directed(spark, sf), ["leaf", "branch"], "e"))


REGT = f"x AS (SELECT event_type AS leaf, {REG} AS regime, abs(value - 50) AS e FROM events WHERE event_id % 40 = 0 OR event_type IN ('click', 'view')), q AS (SELECT leaf, regime, count(*) AS n, greatest(quantile_cont(e, 0.9), 1e-9) AS s, quantile_cont(e, 0.97) AS a FROM x GROUP BY ALL), l AS (SELECT leaf, count(*) AS n, CASE WHEN count(*) < 10 THEN 1 ELSE greatest(quantile_cont(e, 0.9), 1e-9) END AS s, CASE WHEN count(*) < 10 THEN 2 ELSE quantile_cont(e, 0.97) END AS a FROM x GROUP BY leaf), rt AS (SELECT l.leaf, r.regime, coalesce(q.n, 0) AS n, CASE WHEN q.n >= 10 THEN q.s ELSE l.s END AS s, CASE WHEN q.n >= 10 THEN q.a ELSE l.a END AS a, CASE WHEN q.n >= 10 THEN 'own' ELSE 'leaf' END AS source FROM l CROSS JOIN (VALUES ('ACTIVE'), ('QUIET')) r(regime) LEFT JOIN q ON q.leaf = l.leaf AND q.regime = r.regime)"


def _regime_thresholds(spark, sf):
    rows = table(spark, sf, "events").filter("event_id % 40 = 0 OR event_type IN ('click', 'view')").select(F.col("event_type").alias("leaf"), "ts", F.abs(F.col("value") - 50).alias("e"))
    return C.thresholds_by_regime(rows, "leaf", "ts", "e")


@query("q_regime_thresholds", f"WITH {REGT} SELECT leaf, regime, n, round(s, 6) AS t_susp, round(greatest(a, 1.1 * s), 6) AS t_atk, round(0.9 * s, 6) AS t_base, source FROM rt")
def regime_thresholds(spark, sf):
    return r6(_regime_thresholds(spark, sf))


@query("q_regime_dispatch", f"WITH {REGT} SELECT e.event_type AS leaf, {REG} AS regime, count(*) AS n, count(*) FILTER (abs(value - 50) >= s) AS n_over FROM events e JOIN rt ON rt.leaf = e.event_type AND rt.regime = {REG} GROUP BY ALL")
def regime_dispatch(spark, sf):
    df = C.with_regime_thresholds(_rows(spark, sf), _regime_thresholds(spark, sf), "leaf", "ts")
    return df.groupBy("leaf", "regime").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs("r") >= F.col("t_susp")).cast("long")).alias("n_over"))


@query("q_gap_ratio", f"WITH {REGT} SELECT leaf, regime, round((greatest(a, 1.1 * s) - s) / s, 6) AS gap_ratio FROM rt")
def gap_ratio(spark, sf):
    return r6(C.gap_ratio(_regime_thresholds(spark, sf), ["leaf", "regime"]))


EVD = "ev AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 30 AND value < 100) / 4e0 AS s, count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL)"


@query("q_reliability", f"WITH {EVD}, c AS (SELECT leaf, count(*) FILTER (s + n > 0) AS k, count(*) FILTER (s > 0 AND n <= 0) AS b FROM ev GROUP BY leaf) SELECT leaf, k AS n_suspect, round(CASE WHEN k < 10 THEN 0.3 ELSE least(1, greatest(0.05, 1 - b / k::DOUBLE)) END, 6) AS reliability FROM c")
def reliability(spark, sf):
    return r6(C.reliability(evidence(spark, sf), ["leaf"], "ev_s", "ev_n"))


HOURLY = "hr AS (SELECT event_type AS leaf, date_trunc('hour', ts)::TIMESTAMP AS t, avg(value) AS y FROM events GROUP BY ALL), hd AS (SELECT leaf, epoch(t)::BIGINT // 86400 AS d, isodow(t) >= 6 AS we, y FROM hr)"


@query("q_rolling_r2", f"""WITH {HOURLY}, o AS (SELECT *, d - min(d) OVER (PARTITION BY leaf) - 14 AS off FROM hd), te AS (SELECT leaf, d, we, y, off, d - off % 3 AS org FROM o WHERE off >= 0 AND off % 3 < 2),
f AS (SELECT DISTINCT leaf, org, we FROM te), own AS (SELECT f.leaf, f.org, f.we, avg(o.y) AS m FROM f JOIN o ON o.leaf = f.leaf AND o.we = f.we AND o.d < f.org GROUP BY ALL), al AS (SELECT f.leaf, f.org, avg(o.y) AS m FROM (SELECT DISTINCT leaf, org FROM f) f JOIN o ON o.leaf = f.leaf AND o.d < f.org GROUP BY ALL),
s AS (SELECT te.leaf, te.org, y, coalesce(own.m, al.m) AS h FROM te LEFT JOIN own USING (leaf, org, we) LEFT JOIN al USING (leaf, org)) SELECT leaf, count(DISTINCT org) AS n_folds, count(*) AS n, round(1 - sum((y - h) * (y - h)) / (var_pop(y) * count(*)), 6) AS r2 FROM s WHERE h IS NOT NULL GROUP BY leaf""")
def rolling_r2(spark, sf):
    hr = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf"), F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("y")).withColumn("we", F.weekday("t") >= 5)
    return r6(C.rolling_r2(hr, ["leaf"], "t", "y", ["we"], 14, 3, 2))


@query("q_expanding_r2", """WITH k AS (SELECT event_type AS leaf, user_id::DOUBLE AS x, value AS y, ntile(6) OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
s AS (SELECT leaf, k, count(*) AS n, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum(y) AS s FROM k GROUP BY ALL), b AS (SELECT *, sum(xy) OVER w / sum(xx) OVER w AS b FROM s WINDOW w AS (PARTITION BY leaf ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT leaf, sum(n)::BIGINT AS n, round(avg(1 - (yy - 2 * b * xy + b * b * xx) / (yy - s * s / n)), 6) AS r2 FROM b GROUP BY leaf""")
def expanding_r2(spark, sf):
    return r6(C.expanding_r2(table(spark, sf, "events").withColumnRenamed("event_type", "leaf"), ["leaf"], "event_id", "user_id", "value"))


@query("q_mean_fallback", "WITH r AS (SELECT event_type AS leaf, avg(value) / 100 - 0.5 AS r2 FROM events GROUP BY 1) SELECT leaf, r2 < 0 AS use_mean, round(CASE WHEN r2 < 0 THEN 0 ELSE r2 END, 6) AS r2 FROM r")
def mean_fallback(spark, sf):
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf")).agg((F.avg("value") / 100 - 0.5).alias("r2"))
    return r6(C.mean_fallback(r).select("leaf", "use_mean", "r2"))


@query("q_calibration_source", "WITH n AS (SELECT event_type AS leaf, value, ts >= TIMESTAMP '2024-01-29' AS h FROM events), c AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY leaf) AS k FROM n) SELECT leaf, count(*) AS n, round(sum(value), 4) AS total FROM c WHERE CASE WHEN k >= 16 THEN h ELSE NOT h END GROUP BY leaf")
def calibration_source(spark, sf):
    held = F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")
    rows = C.calibration_source(table(spark, sf, "events").withColumnRenamed("event_type", "leaf"), ["leaf"], held, 16)
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("q_missing_models", "SELECT leaf FROM (VALUES ('click'), ('view'), ('forecast_x')) e(leaf) WHERE leaf NOT IN (SELECT DISTINCT event_type FROM events)")
def missing_models(spark, sf):
    expected = spark.createDataFrame([("click",), ("view",), ("forecast_x",)], "leaf string")
    return C.missing_models(table(spark, sf, "events").select(F.col("event_type").alias("leaf")), expected, "leaf")


@query("q_leaf_weights", f"WITH {EVD} SELECT leaf, day, 1e0 AS uniform, round(p / 10, 6) AS r2_static, round(CASE WHEN leaf = 'click' AND s > 1e-6 THEN 1 / s ELSE p / 10 END, 6) AS interval, round(CASE WHEN n > 0 THEN 1 / n ELSE p / 10 END, 6) AS online_rmse FROM ev")
def leaf_weights(spark, sf):
    r2, width, rmse = F.col("ev_p") / 10, F.col("ev_s"), F.when(F.col("ev_n") > 0, F.col("ev_n"))
    return r6(evidence(spark, sf).select("leaf", "day", *[C.leaf_weight(m, r2, width, rmse, F.col("leaf") == "click").alias(m) for m in C.WEIGHTS]))


@query("q_weighted_fusion", f"WITH {EVD}, o AS (SELECT leaf, day, p, s, n, 3 / (3 + p + s + n) AS u, p / 10 AS w FROM ev WHERE p > 0), g AS (SELECT day, count(*) AS k, sum(w * (1 - u) * p) / sum(w * (1 - u)) AS p, sum(w * (1 - u) * s) / sum(w * (1 - u)) AS s, sum(w * (1 - u) * n) / sum(w * (1 - u)) AS n FROM o GROUP BY day) SELECT day, round(p / (3 + p + s + n), 6) AS b_safe, round(n / (3 + p + s + n), 6) AS b_atk, round(3 / (3 + p + s + n), 6) AS u FROM g")
def weighted_fusion(spark, sf):
    df = evidence(spark, sf).filter("ev_p > 0")
    op = df.select("leaf", "day", (F.col("ev_p") / 10).alias("w"), *O.from_evidence(tuple(F.col(c) for c in ("ev_p", "ev_s", "ev_n"))).columns())
    return r6(fusion.fuse(op, ["day"], "wbf", weight=F.col("w")).select("day", "b_safe", "b_atk", "u"))


OPS = f"{EVD}, op AS (SELECT leaf, day, p / (3 + p + s + n) AS b0, s / (3 + p + s + n) AS b1, n / (3 + p + s + n) AS b2, 3 / (3 + p + s + n) AS u FROM ev)"


@query("q_method_discount", f"WITH {OPS}, d AS (SELECT leaf, day, b0, b1, b2 * CASE WHEN leaf = 'error' THEN 0.6e0 ELSE 1 END AS b2, u FROM op) SELECT leaf, day, round(b2, 6) AS b_atk, round(CASE WHEN leaf = 'error' THEN 1 - b0 - b1 - b2 ELSE u END, 6) AS u FROM d")
def method_discount(spark, sf):
    return r6(C.method_discount(leaf_opinions(spark, sf), "leaf", {"error": 0.6, "view": 1.0}).select("leaf", "day", "b_atk", "u"))


@query("q_five_states", "WITH e AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*)::DOUBLE AS t, count(*) FILTER (value >= 60 AND value < 100)::DOUBLE AS sp, count(*) FILTER (value >= 100)::DOUBLE AS ap, count(*) FILTER (value >= 10 AND value < 40)::DOUBLE AS sn, count(*) FILTER (value < 10)::DOUBLE AS an FROM events GROUP BY ALL) SELECT leaf, day, round(sp / (t + 3) + 0.1e0 * 3 / (t + 3), 6) AS susp_pos, round(ap / (t + 3) + 0.02e0 * 3 / (t + 3), 6) AS atk_pos, round(sn / (t + 3) + 0.1e0 * 3 / (t + 3), 6) AS susp_neg, round(an / (t + 3) + 0.02e0 * 3 / (t + 3), 6) AS atk_neg FROM e")
def five_states(spark, sf):
    v = F.col("value")
    count = lambda c, n: F.sum(c.cast("double")).alias(n)
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf"), F.window("ts", "1 day")["start"].alias("day")).agg(F.count(F.lit(1)).cast("double").alias("t"), count((v >= 60) & (v < 100), "susp_pos"), count(v >= 100, "atk_pos"), count((v >= 10) & (v < 40), "susp_neg"), count(v < 10, "atk_neg"))
    states = C.five_states(F.col("t"), {s: F.col(s) for s in ("susp_pos", "atk_pos", "susp_neg", "atk_neg")}, {"susp_pos": 0.1, "atk_pos": 0.02, "susp_neg": 0.1, "atk_neg": 0.02})
    return r6(e.select("leaf", "day", *[c.alias(s) for s, c in states.items()]))


REF = f"{OPS}, al AS (SELECT op.*, a.alpha, CASE WHEN isodow(day) < 6 THEN 'ACTIVE' ELSE 'QUIET' END AS regime FROM op CROSS JOIN (VALUES (1e0), (0.8e0), (0.5e0)) a(alpha)), dc AS (SELECT day, alpha, regime, b0, b1, b2 * k AS b2, 1 - b0 - b1 - b2 * k AS u FROM (SELECT *, CASE WHEN regime = 'ACTIVE' AND leaf IN ('click', 'view') THEN alpha ELSE 1 END AS k FROM al)), fs AS (SELECT day, alpha, any_value(regime) AS regime, sum((1 - u) * 3 * b0 / u) / sum(1 - u) AS r0, sum((1 - u) * 3 * b1 / u) / sum(1 - u) AS r1, sum((1 - u) * 3 * b2 / u) / sum(1 - u) AS r2 FROM dc GROUP BY ALL), fp AS (SELECT day, alpha, regime, r2 / (3 + r0 + r1 + r2) + 1 / (3 + r0 + r1 + r2) AS pa FROM fs)"


def _refused(spark, sf):
    regime = F.when(F.weekday("day") < 5, "ACTIVE").otherwise("QUIET")
    return C.refused(leaf_opinions(spark, sf), ["day"], regime, F.col("leaf").isin("click", "view"), [1.0, 0.8, 0.5])


@query("q_alpha_refusion", f"WITH {REF} SELECT day, alpha, round(pa, 6) AS proj_atk FROM fp")
def alpha_refusion(spark, sf):
    return r6(_refused(spark, sf))


@query("q_alpha_rates", f"""WITH {CAT}, {REF}, t AS (SELECT *, (EXISTS (SELECT 1 FROM cat WHERE day >= s AND day < e))::INT AS y, (pa >= 0.157)::INT AS p FROM fp),
c AS (SELECT alpha, avg(p) FILTER (y = 0 AND regime = 'ACTIVE') AS fa, avg(p) FILTER (y = 0 AND regime = 'QUIET') AS fq, count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn FROM t GROUP BY alpha)
SELECT alpha, round(fa, 6) AS fpr_active, round(fq, 6) AS fpr_quiet, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc FROM c""")
def alpha_rates(spark, sf):
    df = J.interval_label(_refused(spark, sf), "day", catalog(spark), "y").withColumn("regime", F.when(F.weekday("day") < 5, "ACTIVE").otherwise("QUIET"))
    return r6(C.alpha_rates(df, "y", "regime", 0.157))


@query("q_n_fraction", f"WITH {EVD} SELECT leaf, day, round(CASE WHEN p + s + n > 0 THEN n / (p + s + n) ELSE n / 10 END, 6) AS share FROM ev")
def n_fraction(spark, sf):
    return r6(evidence(spark, sf).select("leaf", "day", C.n_fraction(F.col("ev_p"), F.col("ev_s"), F.col("ev_n"), 10.0).alias("share")))


@query("q_static_vote", f"WITH {EVD} SELECT day, round(coalesce(sum(s * (n / 10 > 0.05)::INT) / nullif(sum(s), 0), 0), 6) AS score FROM ev GROUP BY day")
def static_vote(spark, sf):
    return r6(C.static_vote(evidence(spark, sf), "day", "ev_n", "ev_s", 10.0, 0.05))


FADE = "WITH RECURSIVE " + EVD.replace("ev AS", "ev0 AS") + ", sq AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i FROM ev0), la AS (SELECT * FROM (VALUES (0.5e0), (0.85e0)) x(rate)), z AS (SELECT leaf, rate, i, day, p, s, n FROM sq, la WHERE i = 1 UNION ALL SELECT q.leaf, z.rate, q.i, q.day, z.rate * z.p + CASE WHEN q.i % 5 = 0 THEN 0 ELSE q.p END, z.rate * z.s + CASE WHEN q.i % 5 = 0 THEN 0 ELSE q.s END, z.rate * z.n + CASE WHEN q.i % 5 = 0 THEN 0 ELSE q.n END FROM z JOIN sq q ON q.leaf = z.leaf AND q.i = z.i + 1)"


@query("q_lost_windows", FADE + " SELECT leaf, rate, count(*) AS n, round(avg(n / (3 + p + s + n)), 6) AS mean_atk, round(max(n / (3 + p + s + n)), 6) AS most_atk FROM z GROUP BY ALL")
def lost_windows(spark, sf):
    """How well beliefs stand up to lost windows, for several memories."""
    from pyspark.sql import Window

    lost = F.row_number().over(Window.partitionBy("leaf").orderBy("day")) % 5 == 0
    df = evidence(spark, sf).withColumn("_l", lost).withColumns({c: F.when(F.col("_l"), 0.0).otherwise(F.col(c)) for c in ("ev_p", "ev_s", "ev_n")}).drop("_l")
    rows = df.select("*", F.explode(F.array(F.lit(0.5), F.lit(0.85))).alias("rate"))
    out = None
    for rate in (0.5, 0.85):  # two stated memories
        aged = ageing.age(rows.filter(F.col("rate") == rate), "leaf", "day", params=ageing.Ageing(rate=rate, conflict="none"))
        b = F.col("acc_atk") / (3 + F.col("acc_safe") + F.col("acc_susp") + F.col("acc_atk"))
        part = aged.groupBy("leaf").agg(F.lit(rate).alias("rate"), F.count(F.lit(1)).alias("n"), F.avg(b).alias("mean_atk"), F.max(b).alias("most_atk"))
        out = part if out is None else out.unionByName(part)
    return r6(out)


@query("q_fill_limits", "WITH d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS y, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT *, CASE WHEN (n + day(day)) % 4 = 0 OR day(day) % 7 < 3 THEN NULL ELSE y END AS x FROM d) " + " UNION ALL ".join(f"SELECT {k} AS fill, count(*) FILTER (f IS NULL) AS n_null, round(avg(f), 6) AS mean FROM (SELECT last_value(x IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) AS f FROM h)" for k in (1, 2, 5)))
def fill_limits(spark, sf):
    """Nulls left and the mean after filling with several limits."""
    from .q_series import daily

    df = daily(spark, sf).withColumn("x", F.when(F.dayofmonth("day") % 7 >= 3, F.col("x")))
    out = None
    for k in (1, 2, 5):  # stated limits
        f = timeseries.forward_fill(df, ["event_type"], "day", ["x"], k).agg(F.lit(k).alias("fill"), F.sum(F.col("x").isNull().cast("long")).alias("n_null"), F.avg("x").alias("mean"))
        out = f if out is None else out.unionByName(f)
    return r6(out)


@query("q_fusion_modes")
def fusion_modes(spark, sf):
    """Attack probability under each way of fusing leaves; each way has its own query with SQL."""
    op = leaf_opinions(spark, sf).persist()
    out = None
    for mode in fusion.MODES:
        p = fusion.fuse(op, ["day"], mode).select(F.lit(mode).alias("mode"), O.Opinion.of().projected()[2].alias("p"))
        g = p.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), F.max("p").alias("most"))
        out = g if out is None else out.unionByName(g)
    return r6(out)


@query("q_decluster_shift", "WITH p AS (SELECT event_type AS leaf, event_id, value FROM events WHERE value > 100), r AS (SELECT unnest([1, 20, 60]) AS run), n AS (SELECT r.run, p.*, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY r.run, leaf ORDER BY event_id) <= r.run THEN 0 ELSE 1 END AS nw FROM p CROSS JOIN r), c AS (SELECT *, sum(nw) OVER (PARTITION BY run, leaf ORDER BY event_id) AS c FROM n), m AS (SELECT run, leaf, c, max(value) AS v FROM c GROUP BY ALL), t AS (SELECT run, leaf, quantile_cont(v, 0.9) AS t FROM m GROUP BY ALL) SELECT leaf, run, round((t - first_value(t) OVER w) / first_value(t) OVER w, 6) AS shift FROM t WINDOW w AS (PARTITION BY leaf ORDER BY run)")
def decluster_shift(spark, sf):
    p = table(spark, sf, "events").filter("value > 100").select(F.col("event_type").alias("leaf"), "event_id", "value")
    out = None
    for run in (1, 20, 60):  # stated run lengths
        t = C.quantiles(tails.decluster(p, ["leaf"], "event_id", "value", run), ["leaf"], "value", [0.9]).select("leaf", F.lit(run).alias("run"), F.col("q0").alias("t"))
        out = t if out is None else out.unionByName(t)
    return r6(C.decluster_shift(out, ["leaf"], "run", "t"))




#: Leaves of several kinds of tails from the events: as they are, beyond a distance, capped, few.
EVT_ROWS = "ek AS (SELECT event_id, CASE WHEN event_id % 997 = 1 THEN 'rare' ELSE event_type END AS leaf, CASE event_type WHEN 'view' THEN 1000 + exp(value / 20) WHEN 'error' THEN least(value, 60) - 50 ELSE value - 50 END AS r, CASE event_type WHEN 'click' THEN 'both' WHEN 'view' THEN 'pos' ELSE 'sym' END AS d FROM events), eq AS (SELECT *, count(*) FILTER (r >= 0) OVER w AS up, count(*) FILTER (CASE WHEN d = 'both' THEN r < 0 ELSE r <= 0 END) OVER w AS dn FROM ek WINDOW w AS (PARTITION BY leaf)), er AS MATERIALIZED (SELECT leaf, 'pos' AS branch, abs(r) AS e FROM eq WHERE d IN ('pos', 'both') AND (r >= 0 OR up < 10) UNION ALL SELECT leaf, 'neg', abs(r) FROM eq WHERE d = 'both' AND (r < 0 OR dn < 10) UNION ALL SELECT leaf, 'sym', abs(r) FROM eq WHERE d = 'sym')"


def _evt_sql(passes: int = 10, points: int = 16) -> str:
    """The same chain in SQL: the grid of the likelihood is narrowed in as many steps."""
    ctes = []
    for i in range(passes):
        ctes.append(f"""
l{i} AS MATERIALIZED (SELECT leaf, branch, np, sign, low, high, j, sign * exp(low + (high - low) * (j / {points - 1}e0)) AS theta, avg(ln(1 + sign * exp(low + (high - low) * (j / {points - 1}e0)) * x)) AS xi FROM g{i} JOIN x USING (leaf, branch) CROSS JOIN (SELECT unnest(range({points})) AS j) GROUP BY ALL),
b{i} AS MATERIALIZED (SELECT *, -np * (ln(xi / theta) + xi + 1) AS ll FROM l{i} WHERE xi / theta > 0 QUALIFY row_number() OVER (PARTITION BY leaf, branch, sign ORDER BY -np * (ln(xi / theta) + xi + 1) DESC, j DESC) = 1),
g{i + 1} AS MATERIALIZED (SELECT leaf, branch, np, sign, greatest(low, low + (high - low) / {points - 1}e0 * (j - 1)) AS low, least(high, low + (high - low) / {points - 1}e0 * (j + 1)) AS high FROM b{i})""")
    return f"""WITH {EVT_ROWS}, q AS (SELECT leaf, branch, count(*) AS n, quantile_cont(e, 0.9) AS t0, quantile_cont(e, 0.98) AS qs, quantile_cont(e, 0.99) AS qa FROM er GROUP BY ALL),
x AS MATERIALIZED (SELECT leaf, branch, e - t0 AS x FROM er JOIN q USING (leaf, branch) WHERE e > t0 AND n >= 10), st AS (SELECT leaf, branch, count(*) AS np, avg(x) AS mean, max(x) AS top FROM x GROUP BY ALL),
g0 AS MATERIALIZED (SELECT leaf, branch, np, -1e0 AS sign, ln(1e-9 / top) AS low, ln((1 - 1e-6) / top) AS high FROM st UNION ALL SELECT leaf, branch, np, 1e0, ln(1e-9 / top), ln(10 / mean) FROM st),{",".join(ctes)},
sd AS (SELECT leaf, branch, max(ll) AS ll, arg_max(xi, ll) AS xi, arg_max(theta, ll) AS theta FROM b{passes - 1} GROUP BY ALL),
f AS (SELECT q.*, coalesce(np, 0) AS np, CASE WHEN sd.ll > -np * (ln(mean) + 1) THEN sd.xi ELSE 0 END AS xi, CASE WHEN sd.ll > -np * (ln(mean) + 1) THEN sd.xi / theta ELSE mean END AS sigma FROM q LEFT JOIN st USING (leaf, branch) LEFT JOIN sd USING (leaf, branch)),
rk AS (SELECT *, row_number() OVER (PARTITION BY leaf, branch ORDER BY x) AS i, count(*) OVER (PARTITION BY leaf, branch) AS k FROM x), pw AS (SELECT leaf, branch, avg(x) AS a0, avg(x * (1 - (i - 0.35e0) / k)) AS a1 FROM rk GROUP BY ALL), pm AS (SELECT leaf, branch, 2 - a0 / nullif(a0 - 2 * a1, 0) AS xp, 2 * a0 * a1 / nullif(a0 - 2 * a1, 0) AS sp FROM pw),
ps AS (SELECT leaf, branch, i, x, greatest(0, 1 - 0.02e0 * n / k) * (k - 1) AS ks, greatest(0, 1 - 0.01e0 * n / k) * (k - 1) AS ka FROM rk JOIN q USING (leaf, branch)), em AS (SELECT leaf, branch, min(x) FILTER (i > floor(ks)) + (min(x) FILTER (i > ceil(ks)) - min(x) FILTER (i > floor(ks))) * any_value(ks - floor(ks)) AS zs, min(x) FILTER (i > floor(ka)) + (min(x) FILTER (i > ceil(ka)) - min(x) FILTER (i > floor(ka))) * any_value(ka - floor(ka)) AS za FROM ps GROUP BY ALL),
r0 AS (SELECT f.*, xp, sp, zs, za, CASE WHEN n < 10 THEN 'few rows' WHEN np < 50 THEN 'few peaks' WHEN sigma - xi * t0 <= 0 THEN 'heavy tail' WHEN sigma > 0 AND xi > -1 THEN 'likelihood' WHEN sp > 0 AND xp > -1 THEN 'moments' ELSE 'empirical' END AS reason FROM f LEFT JOIN pm USING (leaf, branch) LEFT JOIN em USING (leaf, branch)),
r AS (SELECT * REPLACE (CASE WHEN reason = 'moments' THEN xp ELSE xi END AS xi, CASE WHEN reason = 'moments' THEN sp ELSE sigma END AS sigma) FROM r0),
t AS (SELECT *, CASE WHEN reason = 'few rows' THEN 1e-9 WHEN reason IN ('likelihood', 'moments') THEN t0 + greatest(0, CASE WHEN abs(xi) < 1e-8 THEN -sigma * ln(0.02e0 * n / np) ELSE sigma / xi * (pow(0.02e0 * n / np, -xi) - 1) END) WHEN reason = 'empirical' THEN t0 + zs ELSE qs END AS s, CASE WHEN reason = 'few rows' THEN 1e-9 WHEN reason IN ('likelihood', 'moments') THEN t0 + greatest(0, CASE WHEN abs(xi) < 1e-8 THEN -sigma * ln(0.01e0 * n / np) ELSE sigma / xi * (pow(0.01e0 * n / np, -xi) - 1) END) WHEN reason = 'empirical' THEN t0 + za ELSE qa END AS a FROM r)
SELECT leaf, branch, n, np AS n_peaks, round(t0, 6) AS t0, round(greatest(s, 1e-9), 3) AS t_susp, round(greatest(a, 1.1 * s, 1e-9), 3) AS t_atk, reason FROM t"""


@query("q_evt_thresholds", _evt_sql())
def evt_thresholds(spark, sf):
    """Tail thresholds with the reason of each; tests take every branch of the chain."""
    v, kind = F.col("value"), F.col("event_type")
    r = F.when(kind == "view", 1000 + F.exp(v / 20)).when(kind == "error", F.least(v, F.lit(60.0)) - 50).otherwise(v - 50)
    way = F.when(kind == "click", "both").when(kind == "view", "pos").otherwise("sym")
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 997 == 1, "rare").otherwise(kind).alias("leaf"), r.alias("r"), way.alias("d"))
    out = tails.evt_thresholds(C.sides(rows, ["leaf"], "r", F.col("d")), ["leaf", "branch"], "e")
    return out.select("leaf", "branch", "n", "n_peaks", F.round("t0", 6).alias("t0"), F.round("t_susp", 3).alias("t_susp"), F.round("t_atk", 3).alias("t_atk"), "reason")
