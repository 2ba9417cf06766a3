"""Queries of qualification: causes of daily alarms by templates, and how good they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import opinions as O
from ..operators import attribution as A
from ..operators import qualification as Q
from .q_metrics import ATT, TEMPLATES, _scores
from .q_series import CATALOG
from .registry import query, r6

#: Gate, limit of novelty, and the cause that each event of the catalog is expected to show: fixed values of the queries.
GATE, NOVELTY, EXPECTED = 0.1575, 0.8, {"A": "flood", "B": "leak", "C": "calm"}
QU = f"""{ATT}, sy AS (SELECT day, avg(p2) AS p FROM pj GROUP BY day),
tq AS (SELECT day, arg_max(type, bm - type_idx * 1e-12) AS t, max(bm) AS tb, any_value(u) AS u, any_value(u_um) AS uu, coalesce(avg(e) / nullif(max(e), 0), 1) AS lr FROM (SELECT *, greatest(b + u / 3 - u_um / 3, 0) AS bm FROM um) GROUP BY day),
qu AS (SELECT day, p, p >= {GATE} AS gate_open, CASE WHEN p < {GATE} THEN 'normal' WHEN u > {NOVELTY} THEN 'autre_anomalie' ELSE 'qualified' END AS qual_status, CASE WHEN p >= {GATE} THEN t END AS top1_type,
  CASE WHEN p >= {GATE} THEN tb END AS top1_b, CASE WHEN p >= {GATE} THEN tb + uu / 3 END AS top1_proj, CASE WHEN p >= {GATE} THEN u END AS u_raw, CASE WHEN p >= {GATE} THEN uu END AS u, CASE WHEN p >= {GATE} THEN lr END AS novelty_lr FROM sy JOIN tq USING (day))"""
EXP = "ex(name, expected, s, e) AS (VALUES " + ", ".join(f"('{n}', '{EXPECTED[n]}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in CATALOG) + ")"
ATTACKS = f"""{EXP}, sm AS (SELECT name, count(*) AS n, count(*) FILTER (gate_open) AS d, count(*) FILTER (gate_open AND top1_type = expected) AS c, min(CASE WHEN gate_open AND top1_type = expected THEN epoch_us(day) END) AS f FROM qu JOIN ex ON day >= s AND day < e GROUP BY name),
mt AS (SELECT ex.name, expected, s, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(c, 0) AS c, f, coalesce(d / nullif(n, 0)::DOUBLE, 0) AS dr, coalesce(c / nullif(d, 0)::DOUBLE, 0) AS qp FROM ex LEFT JOIN sm USING (name)),
mf AS (SELECT *, coalesce(2 * dr * qp / nullif(dr + qp, 0), 0) AS f1, coalesce(5 * dr * qp / nullif(4 * dr + qp, 0), 0) AS fb FROM mt)"""


def _system(spark, sf):
    from .q_opinions import leaf_opinions

    return leaf_opinions(spark, sf).select("day", O.Opinion.of().projected()[2].alias("p")).groupBy("day").agg(F.avg("p").alias("p"))


def qualified(spark, sf):
    return Q.qualify(_system(spark, sf), _scores(spark, sf), "day", GATE, NOVELTY, p="p")


def expected(spark):
    rows = [(n, EXPECTED[n], a, b) for n, a, b in CATALOG]
    return spark.createDataFrame(rows, "name string, expected string, s string, e string").select("name", "expected", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))


def _attacks(spark, sf):
    return Q.metrics_by_attack(qualified(spark, sf), expected(spark), "day")


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "type string, type_idx int, grp string, c_safe double, c_susp double, c_atk double")


def _groups(spark, sf):
    from .q_opinions import leaf_opinions

    grp = F.when(F.col("leaf").isin("click", "view"), "count").otherwise("mean")
    return A.pooled(leaf_opinions(spark, sf).select(grp.alias("grp"), "day", *[x.alias(f"p_{s}") for x, s in zip(O.Opinion.of().projected(), A.STATES, strict=True)]), ["day", "grp"])


ROW = ", ".join(f"round({c}, 6) AS {c}" for c in ("p", "top1_b", "top1_proj", "u_raw", "u", "novelty_lr"))


@query("q_qualify", f"WITH {QU} SELECT day, gate_open, qual_status, top1_type, {ROW} FROM qu")
def qualify(spark, sf):
    return r6(qualified(spark, sf))


@query("q_maximised", f"WITH {ATT} SELECT day, type, round(u_um, 6) AS u_um, round(greatest(b + u / 3 - u_um / 3, 0), 6) AS b_um FROM um")
def maximised(spark, sf):
    return r6(Q.maximised(A.beliefs(_scores(spark, sf), "day").select("day", "type", "b", "u"), "day").select("day", "type", "u_um", "b_um"))


@query("q_novelty_ratio", f"WITH {ATT} SELECT day, round(coalesce(avg(e) / nullif(max(e), 0), 1), 6) AS novelty_lr FROM evd GROUP BY day")
def novelty_ratio(spark, sf):
    return r6(Q.novelty_ratio(A.beliefs(_scores(spark, sf), "day"), "day"))


@query("q_qualified_rows", f"WITH {QU} SELECT CASE WHEN gate_open THEN 'qualified' ELSE 'closed' END AS part, count(*) AS n FROM qu GROUP BY 1")
def qualified_rows(spark, sf):
    return Q.split_rows(qualified(spark, sf)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("q_qualify_metrics", f"WITH {QU}, {ATTACKS} SELECT name, expected, n, d AS n_detected, d AS n_qualified, c AS n_correct, round(dr, 6) AS dr, round(qp, 6) AS qp, round(f1, 6) AS f1, round(fb, 6) AS fb, round((f - epoch_us(s)) / 6e7, 6) AS ttq_min FROM mf")
def qualify_metrics(spark, sf):
    return r6(_attacks(spark, sf))


@query("q_qualify_summary", f"""WITH {QU}, {ATTACKS}, mi AS (SELECT sum(d) / nullif(sum(n), 0)::DOUBLE AS dr, coalesce(sum(c) / nullif(sum(d), 0)::DOUBLE, 0) AS qp FROM mf)
SELECT 'macro' AS kind, round(avg(dr), 6) AS dr, round(avg(qp), 6) AS qp, round(avg(f1), 6) AS f1, round(avg(fb), 6) AS fb FROM mf
UNION ALL SELECT 'micro', round(dr, 6), round(qp, 6), round(coalesce(2 * dr * qp / nullif(dr + qp, 0), 0), 6), round(coalesce(5 * dr * qp / nullif(4 * dr + qp, 0), 0), 6) FROM mi""")
def qualify_summary(spark, sf):
    return r6(Q.summary(_attacks(spark, sf)))


@query("q_qualify_closed", f"WITH {QU}, {EXP} SELECT name, count(*) AS n, count(*) FILTER (gate_open) AS n_detected, count(*) FILTER (gate_open AND top1_type = expected) AS n_correct FROM qu JOIN ex ON day >= s AND day <= e GROUP BY name")
def qualify_closed(spark, sf):
    return Q.metrics_by_attack(qualified(spark, sf), expected(spark), "day", closed=True).select("name", "n", "n_detected", "n_correct")


WEEK = "CASE WHEN isodow(day) >= 6 THEN 'leak' ELSE 'flood' END"


def _with_truth(spark, sf):
    return qualified(spark, sf).withColumn("expected", F.when(F.weekday("day") >= 5, "leak").otherwise("flood"))


@query("q_type_performance", f"""WITH {QU}, r AS (SELECT {WEEK} AS t, top1_type AS p FROM qu WHERE gate_open), k AS (SELECT DISTINCT t AS type FROM r UNION SELECT DISTINCT p FROM r),
c AS (SELECT type, count(*) FILTER (t = type) AS n, count(*) FILTER (p = type) AS n_named, count(*) FILTER (t = type AND p = type) AS tp FROM k CROSS JOIN r GROUP BY type)
SELECT type, n, n_named, tp, round(coalesce(tp / nullif(n, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(tp / nullif(n_named, 0)::DOUBLE, 0), 6) AS precision FROM c""")
def type_performance(spark, sf):
    return r6(Q.type_performance(_with_truth(spark, sf)))


@query("q_novelty_auc", f"""WITH {QU}, r AS (SELECT (isodow(day) >= 6)::INT AS y, novelty_lr AS s FROM qu WHERE gate_open), c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM r GROUP BY 1),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c)
SELECT round(sum(p * (below + n / 2e0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc, round(max(tp::DOUBLE / ap - fp::DOUBLE / an), 6) AS youden FROM b""")
def novelty_auc(spark, sf):
    df = qualified(spark, sf).filter("gate_open").withColumn("novel", (F.weekday("day") >= 5).cast("int"))
    return r6(Q.novelty_auc(df, "novel", "novelty_lr").select("auc", "youden"))


def _top(trial: str, source: str) -> str:
    return f"""sc2 AS (SELECT {trial}, day, type, type_idx, sum(greatest(sc - 1e0 / 3, 0) * 3) AS e FROM (SELECT t.{trial}, day, type, type_idx, CASE WHEN c0 + c1 + c2 > 0 THEN (g0 * c0 + g1 * c1 + g2 * c2) / (g0 + g1 + g2) / (c0 + c1 + c2) ELSE 1e0 / 3 END AS sc FROM po JOIN {source} t USING (grp)) GROUP BY ALL),
tops AS (SELECT {trial}, day, arg_max(type, round(e, 9) - type_idx * 1e-12) AS top1_type, max(e) AS e FROM sc2 GROUP BY ALL)"""


MOVES = "mv(trial, m0, m1, m2) AS (VALUES (0, 0e0, 0e0, 0e0), (1, 5e-2, 0, 0), (2, -5e-2, 0, 0), (3, 0, 5e-2, 0), (4, 0, -5e-2, 0), (5, 0, 0, 5e-2), (6, 0, 0, -5e-2)), pt AS (SELECT trial, type, type_idx, grp, greatest(c0 + m0, 0) AS c0, greatest(c1 + m1, 0) AS c1, greatest(c2 + m2, 0) AS c2 FROM tp CROSS JOIN mv)"


@query("q_template_sensitivity", f"WITH {ATT}, {MOVES}, {_top('trial', 'pt')} SELECT a.trial, round(avg((a.top1_type = b.top1_type)::INT), 6) AS stable FROM tops a JOIN tops b ON a.day = b.day AND b.trial = 0 WHERE a.trial > 0 GROUP BY a.trial")
def template_sensitivity(spark, sf):
    return r6(Q.sensitivity(_groups(spark, sf), _templates(spark), "day"))


@query("q_leave_one_out", f"WITH {ATT}, lo AS (SELECT d.type AS trial, tp.* FROM tp JOIN (SELECT DISTINCT type FROM tp) d ON d.type <> tp.type UNION ALL SELECT '', tp.* FROM tp), {_top('trial', 'lo')} SELECT nullif(trial, '') AS dropped, day, top1_type, round(e, 6) AS evidence FROM tops")
def leave_one_out(spark, sf):
    return r6(Q.leave_one_out(_groups(spark, sf), _templates(spark), "day"))


@query("q_parameter_grid", f"WITH {ATT}, w AS (SELECT day, sum(e) / 3 AS e FROM evd GROUP BY day) SELECT scale, u_limit, count(*) AS n, count(*) FILTER (3 / (e * scale + 3) > u_limit) AS n_novel FROM w CROSS JOIN (VALUES (1e0), (3e0), (6e0)) a(scale) CROSS JOIN (VALUES (0.7e0), (0.8e0), (0.9e0)) b(u_limit) GROUP BY ALL")
def parameter_grid(spark, sf):
    return Q.parameter_grid(_scores(spark, sf), "day", [1, 3, 6], [0.7, 0.8, 0.9])


SOFT = "so AS (SELECT day, type, exp(avg(ln(score))) AS x FROM sco GROUP BY ALL), am AS (SELECT day, arg_max(type, x) AS t FROM so GROUP BY day)"


def _argmax(spark, sf):
    named = A.argmax_baseline(_scores(spark, sf), "day").select("day", "top1_type")
    return qualified(spark, sf).drop("top1_type").join(named, "day")


@query("q_name_agreement", f"WITH {QU}, {SOFT}, r AS (SELECT top1_type = t AS same FROM qu JOIN am USING (day) WHERE gate_open) SELECT count(*) AS n, count(*) FILTER (same) AS n_same, round(coalesce(count(*) FILTER (same) / nullif(count(*), 0)::DOUBLE, 0), 6) AS share FROM r")
def name_agreement(spark, sf):
    return r6(Q.agreement(qualified(spark, sf), _argmax(spark, sf), "day"))


@query("q_uncertainty_spread", f"WITH {QU} SELECT top1_type, count(*) AS n, round(avg(u_raw), 6) AS mean, round(stddev_samp(u_raw), 6) AS std, round(quantile_cont(u_raw, 0.25), 6) AS q25, round(quantile_cont(u_raw, 0.5), 6) AS median, round(quantile_cont(u_raw, 0.75), 6) AS q75, round(max(u_raw), 6) AS most FROM qu WHERE gate_open GROUP BY 1")
def uncertainty_spread(spark, sf):
    return r6(Q.spread(qualified(spark, sf).filter("gate_open"), ["top1_type"], "u_raw"))


CARD = f"""{EXP}, two AS (SELECT 'templates' AS m, day, gate_open, top1_type FROM qu UNION ALL SELECT 'argmax', day, gate_open, t FROM qu JOIN am USING (day)),
sm AS (SELECT m, name, count(*) AS n, count(*) FILTER (gate_open) AS d, count(*) FILTER (gate_open AND top1_type = expected) AS c, min(CASE WHEN gate_open AND top1_type = expected THEN epoch_us(day) END) AS f FROM two JOIN ex ON day >= s AND day < e GROUP BY ALL),
g AS (SELECT m, avg(coalesce(d / nullif(n, 0)::DOUBLE, 0)) AS recall, avg(coalesce(c / nullif(d, 0)::DOUBLE, 0)) AS precision, avg((f - epoch_us(s)) / 6e7) AS minutes FROM (SELECT DISTINCT m FROM two) CROSS JOIN ex LEFT JOIN sm USING (m, name) GROUP BY m),
u AS (SELECT metric, max(v) FILTER (m = 'templates') AS templates, max(v) FILTER (m = 'argmax') AS argmax FROM g UNPIVOT INCLUDE NULLS (v FOR metric IN (recall, precision, minutes)) GROUP BY metric),
w AS (SELECT *, (templates - argmax) * (CASE WHEN metric = 'minutes' THEN -1 ELSE 1 END) AS gap, CASE WHEN metric = 'minutes' THEN 1 ELSE 0.01 END AS mg FROM u)
SELECT metric, round(templates, 6) AS templates, round(argmax, 6) AS argmax, CASE WHEN gap > mg THEN 'templates' WHEN -gap > mg THEN 'argmax' ELSE 'tie' END AS winner FROM w"""


@query("q_scorecard", f"WITH {QU}, {SOFT}, {CARD}")
def scorecard(spark, sf):
    b = Q.metrics_by_attack(_argmax(spark, sf), expected(spark), "day")
    return r6(Q.scorecard(_attacks(spark, sf), b, ("templates", "argmax")))


@query("q_opinion_sanity", f"WITH {ATT}, s AS (SELECT day, sum(b) + any_value(u) - 1 AS d FROM bel GROUP BY day) SELECT count(*) AS n, round(max(abs(d)), 6) AS worst, 0::BIGINT AS n_outside FROM s")
def opinion_sanity(spark, sf):
    b = A.beliefs(_scores(spark, sf), "day")
    wide = b.groupBy("day").pivot("type", ["flood", "leak", "calm"]).agg(F.first("b")).join(b.groupBy("day").agg(F.first("u").alias("u")), "day")
    return r6(Q.opinion_sanity(wide, ["flood", "leak", "calm"], "u"))


PRIOR = f"""WITH RECURSIVE {QU}, wd AS (SELECT day, max(b) FILTER (type = 'flood') AS f, max(b) FILTER (type = 'leak') AS l, max(b) FILTER (type = 'calm') AS c, any_value(bel.u) AS u, any_value(qu.gate_open) AS g FROM bel JOIN qu USING (day) GROUP BY day),
sq AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM wd),
z AS (SELECT 0::BIGINT AS i, NULL::TIMESTAMP AS day, 0e0 AS f, 0e0 AS l, 0e0 AS c, 1e0 AS u, 0 AS gap, false AS has, false AS g UNION ALL
  SELECT q.i, q.day, CASE WHEN NOT q.g THEN z.f WHEN z.has THEN 0.7e0 * q.f + 0.3e0 * d * (0.8e0 / 1.05e0 * z.f + 0.1e0 * z.l + 0.1e0 * z.c) ELSE q.f END, CASE WHEN NOT q.g THEN z.l WHEN z.has THEN 0.7e0 * q.l + 0.3e0 * d * (0.15e0 / 1.05e0 * z.f + 0.8e0 * z.l + 0.1e0 * z.c) ELSE q.l END,
  CASE WHEN NOT q.g THEN z.c WHEN z.has THEN 0.7e0 * q.c + 0.3e0 * d * (0.1e0 / 1.05e0 * z.f + 0.1e0 * z.l + 0.8e0 * z.c) ELSE q.c END, CASE WHEN NOT q.g THEN z.u WHEN z.has THEN 0.7e0 * q.u + 0.3e0 * (1 - d * (1 - z.u)) ELSE q.u END,
  CASE WHEN q.g THEN 1 ELSE z.gap + 1 END, z.has OR q.g, q.g FROM (SELECT *, pow(0.9e0, gap) AS d FROM z) z JOIN sq q ON q.i = z.i + 1)
SELECT 'all' AS key, day, round(CASE WHEN g THEN f END, 6) AS flood_prior, round(CASE WHEN g THEN l END, 6) AS leak_prior, round(CASE WHEN g THEN c END, 6) AS calm_prior, round(CASE WHEN g THEN u END, 6) AS u_prior FROM z WHERE i > 0"""


@query("q_temporal_prior", PRIOR)
def temporal_prior(spark, sf):
    b = A.beliefs(_scores(spark, sf), "day")
    types = ["flood", "leak", "calm"]
    wide = b.groupBy("day").pivot("type", types).agg(F.first("b")).join(b.groupBy("day").agg(F.first("u").alias("u")), "day").join(_system(spark, sf), "day")
    wide = wide.select(F.lit("all").alias("key"), "day", *types, "u", (F.col("p") >= GATE).cast("int").alias("gate"))
    return r6(Q.with_memory(wide, "key", "day", types, "gate", A.transition_matrix(types, 0.8, {("flood", "leak"): 0.15})))
