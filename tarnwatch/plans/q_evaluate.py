"""Queries of evaluation: protocols, base rates, repeats, tables of incidents, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import evaluation as E
from ..operators import metrics
from .q_metrics import COUNTS, RATES, SC, scored
from .q_series import CATALOG, DAILY, HIGH, catalog, daily, high_spans
from .registry import query, r6, table

#: Families and outages of the catalog: fixed values of the queries.
NAMES = {"A": "SCAN", "B": "NETWORK_OUTAGE_R1", "C": "SCAN_R2"}
FAM = "fm(name, s, e) AS (VALUES " + ", ".join(f"('{NAMES[n]}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in CATALOG) + ")"
MARK = f"{FAM}, mk AS (SELECT event_id, event_type, ts, user_id, value AS score, (EXISTS (SELECT 1 FROM fm WHERE name NOT LIKE 'NETWORK_OUTAGE%' AND ts >= s AND ts < e))::INT AS a, (EXISTS (SELECT 1 FROM fm WHERE name LIKE 'NETWORK_OUTAGE%' AND ts >= s AND ts < e))::INT AS o FROM events)"


def families(spark):
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return catalog(spark).select(names[F.col("name")].alias("name"), "start", "end")


def _marked_catalog(spark):
    return E.outage_parts(families(spark), "name")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "ts", "user_id", F.col("value").alias("score"))


@query("q_outage_parts", f"WITH {HIGH} SELECT CASE user_id % 3 WHEN 0 THEN 'network_outage_R' || user_id WHEN 1 THEN 'NETWORK_OUTAGE' ELSE name END AS name, user_id % 3 <> 2 AS is_outage FROM hi")
def outage_parts(spark, sf):
    """Spans of users under names of several kinds."""
    kind = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("network_outage_R"), F.col("user_id").cast("string"))).when(F.col("user_id") % 3 == 1, "NETWORK_OUTAGE").otherwise(F.col("name"))
    return E.outage_parts(high_spans(spark, sf).withColumn("name", kind), "name").select("name", "is_outage")


@query("q_two_protocols", f"""WITH {MARK}, r AS (SELECT 'outages excluded' AS protocol, (score >= 100)::INT AS p, a AS y FROM mk WHERE NOT (o = 1 AND a = 0) UNION ALL SELECT 'outages positive', (score >= 100)::INT, greatest(a, o) FROM mk)
SELECT protocol, tp, fp, tn, fn, {RATES} FROM (SELECT protocol, {COUNTS} FROM r GROUP BY protocol)""")
def two_protocols(spark, sf):
    return r6(E.two_protocols(_events(spark, sf), _marked_catalog(spark), "ts", "score", 100.0))


@query("q_global_stats", f"""WITH {MARK}, r AS (SELECT (score >= 100)::INT AS g, CASE WHEN a = 1 THEN 'a' WHEN o = 1 THEN 'o' ELSE 'n' END AS k FROM mk),
c AS (SELECT count(*) FILTER (k = 'a') AS n_attack, count(*) FILTER (k = 'o') AS n_outage, count(*) FILTER (k = 'n') AS n_normal, count(*) FILTER (k = 'a' AND g = 1) AS open_attack, count(*) FILTER (k = 'o' AND g = 1) AS open_outage, count(*) FILTER (k = 'n' AND g = 1) AS open_normal FROM r),
d AS (SELECT *, open_attack::DOUBLE AS tp, open_normal::DOUBLE AS fp, (n_attack - open_attack)::DOUBLE AS fn, (n_normal - open_normal)::DOUBLE AS tn FROM c)
SELECT n_attack, n_outage, n_normal, open_attack, open_outage, open_normal, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS detection_rate, round(coalesce(fp / nullif(n_normal, 0), 0), 6) AS false_alarm_rate,
round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc, round(coalesce(open_outage / nullif(n_outage, 0)::DOUBLE, 0), 6) AS outage_rate FROM d""")
def global_stats(spark, sf):
    df = _events(spark, sf).withColumn("gate", F.col("score") >= 100)
    return r6(E.global_stats(df, _marked_catalog(spark), "ts", "gate"))


@query("q_base_rates", f"""WITH {FAM}, h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS v FROM events GROUP BY 1),
j AS (SELECT name, ts, v, s, e FROM fm JOIN h ON ts >= s - INTERVAL 2 HOURS AND ts < e + INTERVAL 2 HOURS)
SELECT fm.name, round(arg_max(v, ts) FILTER (ts < j.s), 6) AS before, round(max(v) FILTER (ts >= j.s AND ts < j.e), 6) AS max_during, round(avg(v) FILTER (ts >= j.s AND ts < j.e), 6) AS mean_during, round(avg(v) FILTER (ts >= j.e), 6) AS mean_after FROM fm LEFT JOIN j USING (name) GROUP BY fm.name""")
def base_rates(spark, sf):
    h = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("v"))
    return r6(E.base_rates(h, families(spark), "ts", "v", 7200, 7200))


@query("q_learning", f"""WITH {FAM}, x AS (SELECT name, s, value, ts FROM fm LEFT JOIN events ON ts >= s AND ts < e), a AS (SELECT name, count(value) AS n, avg((value >= 100)::INT) AS c, min(CASE WHEN value >= 100 THEN epoch_us(ts) - epoch_us(s) END) / 1e6 AS t FROM x GROUP BY name),
f AS (SELECT regexp_replace(name, '_R[0-9]+$', '') AS family, coalesce(nullif(regexp_extract(name, '_R([0-9]+)$', 1), '')::INT, 1) AS occurrence, * FROM a)
SELECT family, occurrence, name, n, round(c, 6) AS coverage, round(t, 6) AS ttd_s FROM f WHERE family IN (SELECT family FROM f GROUP BY family HAVING count(*) >= 2)""")
def learning(spark, sf):
    return r6(E.learning(_events(spark, sf), families(spark), "ts", "score", 100.0))


@query("q_ppv_table", f"""WITH {SC}, g AS (SELECT count(*)::DOUBLE AS al, coalesce(count(*) FILTER (score >= 100 AND y = 0) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE, 0) AS fpr FROM sc),
c AS (SELECT name, count(score) AS n, count(*) FILTER (score >= 100)::DOUBLE AS k FROM cat LEFT JOIN sc ON ts >= s AND ts < e GROUP BY name), r AS (SELECT *, n / al AS rate, k / nullif(n, 0) AS tpr, 1.959963984540054e0 AS z FROM c, g)
SELECT name, n, round(CASE WHEN n > 0 THEN rate END, 6) AS base_rate, round(tpr, 6) AS tpr, round(greatest((tpr + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(tpr*(1-tpr)/n + z*z/(4e0*n*n)) / (1 + z*z/n), 0), 6) AS tpr_low, round(least((tpr + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(tpr*(1-tpr)/n + z*z/(4e0*n*n)) / (1 + z*z/n), 1), 6) AS tpr_high, round(fpr, 6) AS fpr,
round(CASE WHEN n > 0 THEN coalesce(tpr * rate / nullif(tpr * rate + fpr * (1 - rate), 0), 0) END, 6) AS ppv, round(tpr * rate * 0.2e0 / (0.8e0 * (1 - rate)), 6) AS needed_fpr FROM r""")
def ppv_table(spark, sf):
    df = scored(spark, sf).withColumn("p", (F.col("score") >= 100).cast("int"))
    return r6(E.ppv_table(df, catalog(spark), "ts", "p", "y"))


@query("q_window_votes", f"WITH {SC} SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS win, count(*) AS n, sum((score >= 50)::INT)::BIGINT AS votes, round(max(score), 6) AS score, max(y) AS y, (sum((score >= 50)::INT) >= 2)::INT AS p FROM sc GROUP BY ALL")
def window_votes(spark, sf):
    df = scored(spark, sf).withColumns({"win": F.date_trunc("hour", "ts"), "vote": F.col("score") >= 50})
    return r6(E.window_votes(df, ["event_type", "win"], "vote", "score", "y", 2))


@query("q_label_windows", "WITH ev AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL) SELECT leaf, date_trunc('week', day)::TIMESTAMP AS week, round(sum(p), 6) AS ev_p, round(sum(n), 6) AS ev_n, round(avg(p), 6) AS mean_p FROM ev GROUP BY ALL")
def label_windows(spark, sf):
    from .q_opinions import evidence

    df = evidence(spark, sf).withColumns({"week": F.date_trunc("week", "day"), "mean_p": F.col("ev_p")})
    return r6(E.label_windows(df, ["leaf", "week"], ["ev_p", "ev_n"], ["mean_p"]))


def _vus_sql(kind: str) -> str:
    c = "SELECT b, score AS s, sum(yy) AS p, count(*) AS n FROM w GROUP BY ALL"
    if kind == "roc":
        v = "SELECT b, sum(p * (below + (n - p) / 2e0)) / (sum(p)::DOUBLE * sum(n - p)) AS v FROM (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) GROUP BY b"
    else:
        v = "SELECT b, sum(p * tp / al::DOUBLE) / sum(p) AS v FROM (SELECT b, p, sum(p) OVER q AS tp, sum(n) OVER q AS al FROM c WINDOW q AS (PARTITION BY b ORDER BY s DESC)) GROUP BY b"
    return f"""WITH {SC}, k AS (SELECT unnest(range(0, 5)) AS b), o AS (SELECT user_id, event_id, score, y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM sc),
f AS (SELECT *, least(i - max(CASE WHEN y = 1 THEN i END) OVER (PARTITION BY user_id ORDER BY event_id), min(CASE WHEN y = 1 THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i) AS d FROM o),
w AS (SELECT b, score, (coalesce(d, 99) <= b)::INT AS yy FROM f CROSS JOIN k), c AS ({c}), v AS ({v}), t AS (SELECT (v + lag(v) OVER (ORDER BY b)) / 2 AS a FROM v)
SELECT round(sum(a) / 4, 6) AS vus_{kind} FROM t"""


@query("q_vus_roc", _vus_sql("roc"))
def vus_roc(spark, sf):
    return r6(metrics.vus(scored(spark, sf), ["user_id"], "event_id", "y", "score", 4, 5))


@query("q_vus_pr", _vus_sql("pr"))
def vus_pr(spark, sf):
    return r6(metrics.vus(scored(spark, sf), ["user_id"], "event_id", "y", "score", 4, 5, "pr"))


@query("q_vus_summary")
def vus_summary(spark, sf):
    """Tests hold the parts against each other and the median run against brute force."""
    df = scored(spark, sf).withColumn("p", (F.col("score") >= 150).cast("int"))
    return r6(E.vus_summary(df, ["user_id"], "event_id", "y", "score", "p", steps=3))


@query("q_triviality", f"""WITH {SC}, m AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM sc WHERE ts < TIMESTAMP '2024-01-10'), r AS (SELECT y, (score >= 100)::INT AS p, (abs((score - mu) / sd) > 1.5)::INT AS z FROM sc, m WHERE ts >= TIMESTAMP '2024-01-10'),
f AS (SELECT coalesce(2 * count(*) FILTER (y = 1 AND p = 1) / nullif(sum(y) + sum(p), 0)::DOUBLE, 0) AS f1, coalesce(2 * count(*) FILTER (y = 1 AND z = 1) / nullif(sum(y) + sum(z), 0)::DOUBLE, 0) AS f1_trivial FROM r) SELECT round(f1, 6) AS f1, round(f1_trivial, 6) AS f1_trivial, f1_trivial >= 0.9e0 * f1 AS trivial FROM f""")
def triviality(spark, sf):
    df = scored(spark, sf).withColumn("p", (F.col("score") >= 100).cast("int"))
    return r6(E.triviality(df, "y", "p", ["score"], F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), 1.5))


SWEEPS = f"WITH {SC}, s AS (SELECT event_type AS run, threshold, {COUNTS} FROM (SELECT event_type, t.threshold, y, (score >= threshold)::INT AS p FROM sc CROSS JOIN (VALUES (10e0), (50e0), (100e0), (200e0)) t(threshold)) GROUP BY ALL), r AS (SELECT run, threshold, {RATES} FROM s)"


def _sweeps(spark, sf):
    df = scored(spark, sf)
    rows = df.select(F.col("event_type").alias("run"), "y", "score", F.explode(F.array(*[F.lit(float(t)) for t in (10, 50, 100, 200)])).alias("threshold"))
    return r6(metrics.rates_by(rows, ["run", "threshold"], F.col("y"), (F.col("score") >= F.col("threshold")).cast("int"))).select("run", "threshold", "f1", "fpr")


@query("q_best_of_runs", f"{SWEEPS} SELECT run, threshold, f1, fpr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) AS k FROM r) WHERE k = 1")
def best_of_runs(spark, sf):
    return E.best_of_runs(_sweeps(spark, sf))


@query("q_operating_point", f"{SWEEPS} SELECT run, threshold, f1, fpr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(threshold - 90), threshold) AS k FROM r) WHERE k = 1")
def operating_point(spark, sf):
    return E.at_operating_point(_sweeps(spark, sf), 90.0)


@query("q_recommend", f"{SWEEPS}, b AS (SELECT run, f1, fpr FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) AS k FROM r) WHERE k = 1) SELECT run, f1, fpr, fpr <= 0.9 AS within FROM b ORDER BY (fpr <= 0.9)::INT DESC, f1 DESC, run LIMIT 1")
def recommend(spark, sf):
    return E.recommend(E.best_of_runs(_sweeps(spark, sf)), most_fpr=0.9)


@query("q_mcnemar_p", f"WITH {SC}, c AS (SELECT event_type, (score >= 100)::INT = y AS a, (user_id % 2) = y AS b FROM sc), n AS (SELECT event_type, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10 FROM c GROUP BY 1), m AS (SELECT *, greatest(abs(n01 - n10) - 1, 0)::DOUBLE / sqrt((n01 + n10)::DOUBLE) / sqrt(2e0) AS x FROM n), t AS (SELECT *, 1 / (1 + 0.3275911e0 * x) AS t FROM m) SELECT event_type, n01, n10, round(t * (0.254829592e0 + t * (-0.284496736e0 + t * (1.421413741e0 + t * (-1.453152027e0 + t * 1.061405429e0)))) * exp(-x * x), 6) AS p FROM t")
def mcnemar_p(spark, sf):
    df = scored(spark, sf).withColumn("a", (F.col("score") >= 100).cast("int") == F.col("y")).withColumn("b", F.col("user_id") % 2 == F.col("y"))
    one = lambda c, n: F.sum(c.cast("long")).alias(n)
    g = df.groupBy("event_type").agg(one(~F.col("a") & F.col("b"), "n01"), one(F.col("a") & ~F.col("b"), "n10"))
    return r6(g.withColumn("p", E.mcnemar_p(F.col("n01"), F.col("n10"), exact_below=0)))


GI = "ev AS (SELECT event_type AS g, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 30 AND value < 100) / 4e0 AS s, count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL), lo AS (SELECT g, day, 'ev_p' AS state, p AS v FROM ev UNION ALL SELECT g, day, 'ev_s', s FROM ev UNION ALL SELECT g, day, 'ev_n', n FROM ev)"


@query("q_group_independence", f"WITH {GI}, r AS (SELECT a.g AS grp_x, b.g AS grp_y, a.state AS state_x, b.state AS state_y, count(*) AS n, covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0) AS rho FROM lo a JOIN lo b ON a.day = b.day AND a.g < b.g GROUP BY ALL) SELECT grp_x, grp_y, state_x, state_y, n, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY grp_x, grp_y ORDER BY abs(coalesce(rho, 0)) DESC, state_x DESC, state_y DESC) AS k FROM r) WHERE k = 1")
def group_independence(spark, sf):
    from .q_opinions import evidence

    return r6(E.group_independence(evidence(spark, sf), "day", "leaf", ["ev_p", "ev_s", "ev_n"]))


@query("q_first_correct", f"WITH {FAM} SELECT fm.name, round((min(epoch_us(ts)) - epoch_us(any_value(fm.s))) / 1e6, 6) AS ttq_s FROM fm LEFT JOIN events ON ts >= s AND ts < e AND event_type = 'error' GROUP BY fm.name")
def first_correct(spark, sf):
    return r6(E.first_correct(table(spark, sf, "events"), families(spark).withColumn("expected", F.lit("error")), "ts", "event_type"))


@query("q_suspects", "WITH f AS (SELECT event_id, (value > 100)::INT + (user_id % 5 = 0)::INT + (event_type = 'error')::INT AS n_flags FROM events) SELECT event_id, n_flags, CASE WHEN n_flags >= 3 THEN 'high' WHEN n_flags = 2 THEN 'medium' ELSE 'low' END AS severity FROM f WHERE n_flags > 0 ORDER BY n_flags DESC, event_id LIMIT 20")
def suspects(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") > 100).alias("a"), (F.col("user_id") % 5 == 0).alias("b"), (F.col("event_type") == "error").alias("c"))
    return E.suspects(df, "event_id", ["a", "b", "c"], 20)


@query("q_metric_votes", "WITH m AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS win, event_type, max((value > 80)::INT) AS v FROM events GROUP BY ALL) SELECT win, sum(v)::BIGINT AS n, (sum(v) >= 2)::INT AS label FROM m GROUP BY win")
def metric_votes(spark, sf):
    return E.metric_votes(table(spark, sf, "events").withColumn("vote", F.col("value") > 80), "ts", "1 hour", "event_type", "vote", 2)


@query("q_outage_check", f"""WITH {FAM}, t AS (SELECT avg(value) AS m1, stddev_pop(value) AS d1, avg(user_id) AS m2, stddev_pop(user_id) AS d2 FROM events WHERE ts < TIMESTAMP '2024-01-05'), j AS (SELECT name, count(*) AS n, avg(value) AS a, avg(user_id) AS b FROM events JOIN fm ON ts >= s AND ts < e GROUP BY name),
z AS (SELECT name, n, 'value' AS metric, (a - m1) / d1 AS z FROM j, t UNION ALL SELECT name, n, 'user_id', (b - m2) / d2 FROM j, t) SELECT name, metric, n, round(z, 6) AS z, CASE WHEN z < -1 THEN 'down' WHEN z > 1 THEN 'up' ELSE 'flat' END AS direction FROM z""")
def outage_check(spark, sf):
    return r6(E.outage_check(table(spark, sf, "events"), F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"), families(spark), "ts", ["value", "user_id"]))


@query("q_leaf_profile", f"WITH {FAM}, d AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS h, avg(value) AS v FROM events GROUP BY ALL) SELECT name, event_type, count(*) AS n, round(arg_min(v, h), 6) AS first, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM d JOIN fm ON h >= s AND h < e GROUP BY ALL")
def leaf_profile(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    return r6(E.leaf_profile(d, families(spark), "h", "event_type", "v"))


@query("q_regime_verdict", "WITH e AS (SELECT event_type, avg((value >= 100)::INT) FILTER (isodow(ts) < 6 AND hour(ts) >= 8 AND hour(ts) < 18) AS a, avg((value >= 100)::INT) FILTER (NOT (isodow(ts) < 6 AND hour(ts) >= 8 AND hour(ts) < 18)) AS b FROM events GROUP BY 1) SELECT event_type, round(coalesce(a, 0), 6) AS busy, round(coalesce(b, 0), 6) AS quiet, CASE WHEN coalesce(a, 0) > 1.2 * coalesce(b, 0) THEN 'busy' WHEN coalesce(b, 0) > 1.2 * coalesce(a, 0) THEN 'quiet' ELSE 'even' END AS verdict FROM e")
def regime_verdict(spark, sf):
    e = table(spark, sf, "events").groupBy(calendar.regime_of(F.col("ts")).alias("regime"), "event_type").agg(F.avg((F.col("value") >= 100).cast("double")).alias("rate"))
    return r6(E.regime_verdict(e, "regime", "event_type", "rate", factor=1.2))


@query("q_previous_row", f"WITH {DAILY} SELECT event_type, day, round(lag(y) OVER (PARTITION BY event_type ORDER BY day), 6) AS y_before FROM d")
def previous_row(spark, sf):
    return r6(E.previous_row(daily(spark, sf), ["event_type"], "day", ["y"]).select("event_type", "day", "y_before"))


def _one(spark, name: str, got: dict):
    return spark.createDataFrame([(name, got["value"], got["low"], got["high"])], "metric string, value double, low double, high double")


@query("q_bca_f1")
def bca_f1(spark, sf):
    """Tests hold the interval against resampling in numpy."""
    df = scored(spark, sf).withColumn("p", (F.col("score") >= 100).cast("int"))
    return r6(_one(spark, "f1", E.bca_interval(df, "y", ["p"], E.f1_of)))


@query("q_bca_blocks")
def bca_blocks(spark, sf):
    df = scored(spark, sf).withColumn("p", (F.col("score") >= 100).cast("int"))
    low = df.agg(F.min("event_id")).first()[0] or 0
    return r6(_one(spark, "f1", E.bca_interval(df.withColumn("i", F.col("event_id") - low), "y", ["p"], E.f1_of, "i", 50, 200)))


@query("q_bca_paired")
def bca_paired(spark, sf):
    df = scored(spark, sf).withColumn("a", (F.col("score") >= 100).cast("int")).withColumn("b", (F.col("user_id") % 2).cast("int"))
    return r6(_one(spark, "f1 gain", E.bca_interval(df, "y", ["a", "b"], E.f1_gain)))
