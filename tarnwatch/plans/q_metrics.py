"""Queries of evaluation metrics, tails, injection and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import attribution as A
from ..operators import joins, metrics, tails
from ..operators.calibration import quantiles
from ..operators.segments import meet
from .q_series import CAT, HIGH, catalog, high_spans
from .registry import query, r6, table

L = "l AS (SELECT doc_id, quality, toxic FROM labels)"
#: Events scored by value, with the catalog's intervals as truth.
SC = f"{CAT}, sc AS (SELECT event_id, event_type, ts, user_id, value AS score, (EXISTS (SELECT 1 FROM cat WHERE ts >= s AND ts < e))::INT AS y FROM events)"
RATES = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS fpr,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0), 6) AS f1_neg,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2, 6) AS f1_macro, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0), 6) AS mcc"""
COUNTS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn"


def scored(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "user_id", F.col("value").alias("score"))
    return joins.interval_label(e, "ts", catalog(spark), "y")


@query("q_confusion", f"SELECT tp, fp, tn, fn, {RATES} FROM (SELECT {COUNTS} FROM (SELECT toxic AS y, 1 - quality AS p FROM labels))")
def confusion(spark, sf):
    return r6(metrics.with_rates(table(spark, sf, "labels").agg(*metrics.confusion(F.col("toxic"), 1 - F.col("quality")))))


@query("q_threshold_sweep", f"WITH {SC} SELECT threshold, tp, fp, tn, fn, {RATES} FROM (SELECT threshold, {COUNTS} FROM (SELECT t.threshold, y, (score >= threshold)::INT AS p FROM sc CROSS JOIN (VALUES (10e0), (50e0), (100e0), (200e0)) t(threshold)) GROUP BY threshold)")
def threshold_sweep(spark, sf):
    return r6(metrics.sweep(scored(spark, sf), [10, 50, 100, 200]))


@query("q_best_threshold", f"WITH {SC}, w AS (SELECT threshold, {COUNTS} FROM (SELECT t.threshold, y, (score >= threshold)::INT AS p FROM sc CROSS JOIN (VALUES (10e0), (50e0), (100e0), (200e0)) t(threshold)) GROUP BY threshold), r AS (SELECT threshold, {RATES} FROM w) SELECT threshold, f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return metrics.best_row(r6(metrics.sweep(scored(spark, sf), [10, 50, 100, 200])).select("threshold", "f1"), "f1", "threshold")


@query("q_attack_summary", f"WITH {SC} SELECT name, count(*) AS n, count(*) FILTER (score >= 100) AS n_detected, round(avg((score >= 100)::INT), 6) AS coverage, round(min(CASE WHEN score >= 100 THEN epoch_us(ts) - epoch_us(s) END) / 1e6, 6) AS ttd_s, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM sc JOIN cat ON ts >= s AND ts < e GROUP BY name")
def attack_summary(spark, sf):
    return r6(metrics.attack_summary(scored(spark, sf), catalog(spark), "ts", "score", 100.0))


@query("q_kappa", "WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) AS same FROM labels), x AS (SELECT quality AS k, count(*) AS c FROM labels GROUP BY 1), y AS (SELECT toxic AS k, count(*) AS c FROM labels GROUP BY 1), e AS (SELECT sum(x.c::DOUBLE * y.c) AS c FROM x JOIN y USING (k)) SELECT n::BIGINT AS n, round(same / n, 6) AS p_observed, round(c / (n * n), 6) AS p_expected, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, e")
def kappa(spark, sf):
    return r6(metrics.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic"))


@query("q_gate_agreement", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def gate_agreement(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("q_mcnemar", f"WITH {SC}, c AS (SELECT (score >= 100)::INT = y AS a, (user_id % 2) = y AS b FROM sc), n AS (SELECT count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (a AND b) AS n11 FROM c) SELECT *, round(greatest(abs(n01 - n10) - 1, 0)::DOUBLE * greatest(abs(n01 - n10) - 1, 0) / (n01 + n10), 6) AS chi2 FROM n")
def mcnemar(spark, sf):
    df = scored(spark, sf).withColumn("a", (F.col("score") >= 100).cast("int")).withColumn("b", (F.col("user_id") % 2).cast("int"))
    return r6(metrics.mcnemar(df, "y", "a", "b"))


@query(
    "q_proportion_ci",
    """WITH k AS (SELECT event_type, count(*) FILTER (value > 100) AS k, count(*)::DOUBLE AS n, 1.959963984540054e0 AS z FROM events GROUP BY 1)
SELECT event_type, round(greatest(((k/n) + z*z/(2*n)) / (1 + z*z/n) - z * sqrt((k/n)*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n), 0), 6) AS wilson_low, round(least(((k/n) + z*z/(2*n)) / (1 + z*z/n) + z * sqrt((k/n)*(1-k/n)/n + z*z/(4*n*n)) / (1 + z*z/n), 1), 6) AS wilson_high,
round(greatest((k + z*z/2)/(n + z*z) - z * sqrt((k + z*z/2)/(n + z*z) * (1 - (k + z*z/2)/(n + z*z)) / (n + z*z)), 0), 6) AS ac_low FROM k""",
)
def proportion_ci(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.sum((F.col("value") > 100).cast("long")).alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return r6(g.select("event_type", low.alias("wilson_low"), high.alias("wilson_high"), metrics.agresti_coull(F.col("k"), F.col("n"))[0].alias("ac_low")))


@query("q_bayes_ppv", f"WITH {SC}, c AS (SELECT event_type, count(*) FILTER (y = 1 AND score >= 100) / count(*) FILTER (y = 1)::DOUBLE AS tpr, count(*) FILTER (y = 0 AND score >= 100) / count(*) FILTER (y = 0)::DOUBLE AS fpr, avg(y) AS r FROM sc GROUP BY 1) SELECT event_type, round(tpr * r / (tpr * r + fpr * (1 - r)), 6) AS ppv, round(tpr * r * 0.2e0 / (0.8e0 * (1 - r)), 6) AS fpr_for_80 FROM c")
def bayes_ppv(spark, sf):
    hit, y = F.col("score") >= 100, F.col("y")
    rate = lambda v: F.avg(F.when(y == v, hit.cast("double")))
    g = scored(spark, sf).groupBy("event_type").agg(rate(1).alias("tpr"), rate(0).alias("fpr"), F.avg(y.cast("double")).alias("r"))
    return r6(g.select("event_type", metrics.bayes_ppv(F.col("tpr"), F.col("fpr"), F.col("r")).alias("ppv"), metrics.required_fpr(F.lit(0.8), F.col("tpr"), F.col("r")).alias("fpr_for_80")))


@query("q_roc_auc", f"WITH {SC}, c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2e0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM b")
def roc_auc(spark, sf):
    return r6(metrics.roc_auc(scored(spark, sf), "y", "score"))


@query("q_average_precision", f"WITH {SC}, c AS (SELECT score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1), b AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / al::DOUBLE) / sum(p), 6) AS ap FROM b")
def average_precision(spark, sf):
    return r6(metrics.average_precision(scored(spark, sf), "y", "score"))


@query("q_threshold_at_most", "WITH c AS (SELECT value AS s, count(*) AS n FROM events GROUP BY 1), b AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS up FROM c) SELECT round(min(s), 6) AS threshold FROM b WHERE up <= 0.01 * (SELECT count(*) FROM events)")
def threshold_at_most(spark, sf):
    return r6(metrics.threshold_at_most(table(spark, sf, "events"), "value", 0.01))


@query("q_range_auc", f"WITH {SC}, w AS (SELECT score, max(y) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM sc), c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM w GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2e0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM b")
def range_auc(spark, sf):
    return r6(metrics.range_auc(scored(spark, sf), ["user_id"], "event_id", "y", "score", 2))


@query("q_regime_fpr", f"WITH {SC} SELECT regime, count(*) AS n, round(avg((score >= 100)::INT), 6) AS fpr FROM (SELECT *, CASE WHEN isodow(ts) < 6 AND hour(ts) >= 8 AND hour(ts) < 18 THEN 'ACTIVE' ELSE 'QUIET' END AS regime FROM sc WHERE y = 0) GROUP BY regime")
def regime_fpr(spark, sf):
    df = scored(spark, sf).filter("y = 0").groupBy(calendar.regime_of(F.col("ts")).alias("regime"))
    return r6(df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= 100).cast("double")).alias("fpr")))


@query("q_score_distribution", f"WITH {SC} SELECT event_type, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS top FROM sc WHERE y = 0 GROUP BY 1")
def score_distribution(spark, sf):
    rows = scored(spark, sf).filter("y = 0")
    q = quantiles(rows, ["event_type"], "score", [0.5, 0.9, 0.99]).select("event_type", *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p50", "p90", "p99"))])
    g = rows.groupBy("event_type").agg(F.avg("score").alias("mean"), F.max("score").alias("top"))
    return r6(meet(g, q, ["event_type"]).select("event_type", "mean", "p50", "p90", "p99", "top"))


D = "d AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS y FROM events GROUP BY ALL)"


@query("q_pairwise_corr", f"WITH {D} SELECT a.leaf AS leaf_x, b.leaf AS leaf_y, count(*) AS n, round(corr(a.y, b.y), 6) AS rho FROM d a JOIN d b ON a.day = b.day AND a.leaf < b.leaf GROUP BY ALL")
def pairwise_corr(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf"), F.window("ts", "1 day")["start"].alias("day")).agg(F.sum("value").alias("y"))
    a, b = d.select("day", F.col("leaf").alias("leaf_x"), F.col("y").alias("x")), d.select("day", F.col("leaf").alias("leaf_y"), "y")
    return r6(a.join(b, "day").filter("leaf_x < leaf_y").groupBy("leaf_x", "leaf_y").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("rho")))


PEAKS = "t AS (SELECT event_type AS leaf, quantile_cont(value, 0.9) AS t0, count(*) AS n_total FROM events GROUP BY 1), x AS (SELECT e.event_type AS leaf, t0, n_total, value - t0 AS x FROM events e JOIN t ON t.leaf = e.event_type WHERE value > t0), i AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY x) AS i, count(*) OVER (PARTITION BY leaf) AS n FROM x), w AS (SELECT leaf, any_value(t0) AS t0, any_value(n_total) AS m, any_value(n) AS n, avg(x) AS a0, avg(x * (1 - (i - 0.35e0) / n)) AS a1 FROM i GROUP BY leaf)"


def _peaks(spark, sf):
    return tails.peaks_over(table(spark, sf, "events").select(F.col("event_type").alias("leaf"), "value"), ["leaf"], "value")


@query("q_pwm_threshold", f"WITH {PEAKS}, g AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS sigma FROM w) SELECT leaf, n, round(a0, 6) AS a0, round(a1, 6) AS a1, round(xi, 6) AS xi, round(sigma, 6) AS sigma, round(t0 + sigma / xi * (pow(0.001e0 * m / n, -xi) - 1), 5) AS t_atk FROM g")
def pwm_threshold(spark, sf):
    fit = tails.pwm_fit(_peaks(spark, sf), ["leaf", "t0", "n_total"], "excess")
    t = tails.pareto_quantile(F.col("t0"), F.col("xi"), F.col("sigma"), 0.001, F.col("n_total"), F.col("n"))
    return fit.select("leaf", "n", *[F.round(c, 6).alias(c) for c in ("a0", "a1", "xi", "sigma")], F.round(t, 5).alias("t_atk"))


@query("q_likelihood_fit")
def likelihood_fit(spark, sf):
    return r6(tails.maximum_likelihood(_peaks(spark, sf), "leaf", "excess")).select("leaf", "n", F.round("xi", 3).alias("xi"), F.round("sigma", 2).alias("sigma"))


@query("q_ramp", "WITH d AS (SELECT event_type AS leaf, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT leaf, day, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i, count(*) OVER (PARTITION BY leaf) AS c FROM d) SELECT leaf, day, round(least(1, i / greatest(floor(c * 0.3e0), 1), (c - i + 1) / greatest(floor(c * 0.3e0), 1)), 6) AS w FROM w")
def ramp(spark, sf):
    """The ramp of an attack over all days of each leaf."""
    from pyspark.sql import Window

    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("leaf"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("leaf")  # a row for each day
    return r6(d.select("leaf", "day", A.ramp(F.row_number().over(w.orderBy("day")), F.count(F.lit(1)).over(w), F.lit(0.3)).alias("w")))


EV = "ev AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 30 AND value < 100) / 4e0 AS s, count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL)"


@query(
    "q_inject",
    f"""WITH {EV}, hit AS (SELECT *, CASE WHEN leaf IN ('click', 'view') AND day >= TIMESTAMP '2024-01-10' AND day < TIMESTAMP '2024-01-16' THEN 1 END AS h FROM ev),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER w AS c FROM hit WINDOW w AS (PARTITION BY leaf, h ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, least(1, i / greatest(floor(c * 0.4e0), 1), (c - i + 1) / greatest(floor(c * 0.4e0), 1)) AS k FROM r)
SELECT leaf, day, round(CASE WHEN h = 1 THEN (1 - k) * 10 + k * 2 ELSE p END, 6) AS ev_p, round(CASE WHEN h = 1 THEN k * 2 ELSE s END, 6) AS ev_s, round(CASE WHEN h = 1 THEN k * 6 ELSE n END, 6) AS ev_n, CASE WHEN h = 1 THEN 'X' END AS event FROM q""",
)
def inject(spark, sf):
    from .q_opinions import evidence

    rows = [("X", "2024-01-10", "2024-01-16", leaf, 0.4, 1.0, 1.0, 3.0) for leaf in ("click", "view")]
    ev = spark.createDataFrame(rows, "name string, start string, end string, leaf string, ramp_frac double, sig_p double, sig_s double, sig_n double")
    ev = ev.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    return r6(A.inject(evidence(spark, sf), ev, "leaf", "day", 10.0))


#: Templates of the queries: type, its place, group, and the state expected of the group.
TEMPLATES = (("flood", 0, "count", 0.1, 0.2, 0.7), ("flood", 0, "mean", 0.6, 0.3, 0.1), ("leak", 1, "count", 0.6, 0.3, 0.1), ("leak", 1, "mean", 0.1, 0.2, 0.7), ("calm", 2, "count", 0.8, 0.1, 0.1), ("calm", 2, "mean", 0.8, 0.1, 0.1))
GRP = "CASE WHEN leaf IN ('click', 'view') THEN 'count' ELSE 'mean' END"
ATT = f"""{EV}, pj AS (SELECT {GRP} AS grp, day, (p + 1) / (3 + p + s + n) AS p0, (s + 1) / (3 + p + s + n) AS p1, (n + 1) / (3 + p + s + n) AS p2 FROM ev),
po AS (SELECT grp, day, exp(avg(ln(p0))) AS g0, exp(avg(ln(p1))) AS g1, exp(avg(ln(p2))) AS g2 FROM pj GROUP BY ALL),
tp(type, type_idx, grp, c0, c1, c2) AS (VALUES {", ".join(f"('{t}', {i}, '{g}', {a}e0, {b}e0, {c}e0)" for t, i, g, a, b, c in TEMPLATES)}),
sco AS (SELECT day, type, type_idx, grp, (g0 * c0 + g1 * c1 + g2 * c2) / (g0 + g1 + g2) AS score FROM po JOIN tp USING (grp)),
evd AS (SELECT day, type, type_idx, sum(greatest(score - 1e0 / 3, 0) * 3) AS e FROM sco GROUP BY ALL),
bel AS (SELECT *, e / (3 + sum(e) OVER w) AS b, 3 / (3 + sum(e) OVER w) AS u FROM evd WINDOW w AS (PARTITION BY day)),
um AS (SELECT *, least(1, min((b + u / 3) * 3) OVER (PARTITION BY day)) AS u_um FROM bel)"""


def _scores(spark, sf):
    from ..functions import opinions as O
    from .q_opinions import leaf_opinions

    p = O.Opinion.of().projected()
    grp = F.when(F.col("leaf").isin("click", "view"), "count").otherwise("mean")
    proj = leaf_opinions(spark, sf).select(grp.alias("grp"), "day", *[x.alias(f"p_{s}") for x, s in zip(p, A.STATES, strict=True)])
    t = spark.createDataFrame(TEMPLATES, "type string, type_idx int, grp string, c_safe double, c_susp double, c_atk double")
    return A.template_scores(A.pooled(proj, ["day", "grp"]), t, "day")


@query("q_template_score", f"WITH {ATT} SELECT day, type, type_idx, grp, round(score, 6) AS score FROM sco")
def template_score(spark, sf):
    return r6(_scores(spark, sf))


@query("q_beliefs", f"WITH {ATT} SELECT day, type, type_idx, round(e, 6) AS evidence, round(b, 6) AS b, round(u, 6) AS u, round(u_um, 6) AS u_um, round(greatest(b + u / 3 - u_um / 3, 0), 6) AS b_um FROM um")
def beliefs(spark, sf):
    return r6(A.beliefs(_scores(spark, sf), "day"))


@query("q_top_type", f"WITH {ATT} SELECT day, (arg_max(type, b - type_idx * 1e-12)) AS top1_type, round(max(b), 6) AS top1_b, round(any_value(u), 6) AS u_raw, round(coalesce(avg(e) / nullif(max(e), 0), 1), 6) AS novelty_lr FROM bel GROUP BY day")
def top_type(spark, sf):
    return r6(A.top_type(A.beliefs(_scores(spark, sf), "day"), "day"))


@query("q_argmax_baseline", f"WITH {ATT}, m AS (SELECT day, type, exp(avg(ln(score))) AS x FROM sco GROUP BY ALL), s AS (SELECT *, x / sum(x) OVER (PARTITION BY day) AS p FROM m) SELECT day, arg_max(type, p) AS top1_type, round(max(p), 6) AS p FROM s GROUP BY day")
def argmax_baseline(spark, sf):
    return r6(A.argmax_baseline(_scores(spark, sf), "day"))


@query("q_divergence_weights", f"WITH {ATT}, t AS (SELECT grp, c0 / (c0 + c1 + c2) AS a, c1 / (c0 + c1 + c2) AS b, c2 / (c0 + c1 + c2) AS c FROM tp), g AS (SELECT grp, -(avg(a) * log2(avg(a)) + avg(b) * log2(avg(b)) + avg(c) * log2(avg(c))) + avg(a * log2(a) + b * log2(b) + c * log2(c)) AS j FROM t GROUP BY grp) SELECT grp, round(j / (SELECT avg(j) FROM g), 6) AS weight FROM g")
def divergence_weights(spark, sf):
    t = spark.createDataFrame(TEMPLATES, "type string, type_idx int, grp string, c_safe double, c_susp double, c_atk double")
    return r6(A.divergence_weights(t))


@query("q_catalog_overlap", f"WITH {HIGH} SELECT a.name AS name_1, b.name AS name_2 FROM hi a JOIN hi b ON a.name < b.name AND a.s < b.e AND a.e > b.s")
def catalog_overlap(spark, sf):
    return A.overlapping(high_spans(spark, sf)).select("name_1", "name_2")


@query("q_best_cut", f"WITH {SC}, c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY 1), w AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c) SELECT round(score, 6) AS threshold, round(tp::DOUBLE / ap - fp::DOUBLE / an, 6) AS youden FROM w ORDER BY tp::DOUBLE / ap - fp::DOUBLE / an DESC, score DESC LIMIT 1")
def best_cut(spark, sf):
    return r6(metrics.best_cut(scored(spark, sf), "y", "score"))


@query("q_existence_recall", f"WITH {SC}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM sc), m AS (SELECT user_id, score, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f WHERE y = 1), r AS (SELECT max((score >= 150)::INT) AS hit FROM m GROUP BY user_id, g) SELECT count(*) AS n_runs, sum(hit)::BIGINT AS n_hit, round(coalesce(sum(hit) / nullif(count(*), 0)::DOUBLE, 0), 6) AS recall FROM r")
def existence_recall(spark, sf):
    return r6(metrics.existence_recall(scored(spark, sf).withColumn("p", (F.col("score") >= 150).cast("int")), ["user_id"], "event_id", "y", "p"))


@query("q_leaf_rates", f"WITH {SC} SELECT event_type, tp, fp, tn, fn, {RATES} FROM (SELECT event_type, {COUNTS} FROM (SELECT event_type, y, (score >= 100)::INT AS p FROM sc) GROUP BY event_type)")
def leaf_rates(spark, sf):
    return r6(metrics.rates_by(scored(spark, sf), ["event_type"], F.col("y"), (F.col("score") >= 100).cast("int")))


@query("q_window_scores", "WITH l AS (SELECT ts::DATE AS day, event_type, avg((value >= 100)::INT) AS f, count(*) AS n FROM events GROUP BY ALL) SELECT day, round(avg(f), 6) AS mean, round(max(f), 6) AS max, round(list_avg(list_reverse_sort(list(f))[1:3]), 6) AS top3, round(sum(n * f) / sum(n), 6) AS weighted, round(avg((f >= 0.4)::INT), 6) AS votes FROM l GROUP BY day")
def window_scores(spark, sf):
    leaves = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg((F.col("value") >= 100).cast("double")).alias("f"), F.count(F.lit(1)).alias("n"))
    return r6(metrics.window_scores(leaves, "day", "f", "n", 0.4))


@query("q_signature", f"WITH {CAT} SELECT name, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM events JOIN cat ON ts >= s AND ts < e GROUP BY ALL")
def signature(spark, sf):
    e = joins.interval_join(table(spark, sf, "events").select("event_type", "ts", "value"), "ts", catalog(spark), ["name"])
    return r6(quantiles(e, ["name", "event_type"], "value", [0.5]).withColumnRenamed("q0", "median"))
