"""Queries of studies and of what a run keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import studies as S
from ..sources import store
from .q_metrics import COUNTS, EV, RATES, SC, scored
from .q_opinions import leaf_opinions
from .q_qualify import ATT, _groups, _templates
from .q_series import CAT, HIGH, high_spans
from .registry import query, r6, table

VAR = f"WITH {SC}, v AS (SELECT 'value' AS run, y, score FROM sc UNION ALL SELECT 'half', y, score / 2 FROM sc UNION ALL SELECT 'user', y, user_id::DOUBLE FROM sc), c AS (SELECT run, threshold, {COUNTS} FROM (SELECT run, t.threshold, y, (score >= threshold)::INT AS p FROM v CROSS JOIN (VALUES (10e0), (40e0), (100e0)) t(threshold)) GROUP BY ALL), r AS (SELECT run, threshold, tp, fp, tn, fn, {RATES} FROM c)"


def _variants(spark, sf):
    return r6(S.variants(scored(spark, sf), "y", {"value": F.col("score"), "half": F.col("score") / 2, "user": F.col("user_id")}, [10, 40, 100]))


@query("q_variants", f"{VAR} SELECT * FROM r")
def variants(spark, sf):
    return _variants(spark, sf)


@query("q_variant_summary", f"{VAR} SELECT run, threshold, f1, recall FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) AS k FROM r) WHERE k = 1")
def variant_summary(spark, sf):
    return E.best_of_runs(_variants(spark, sf).select("run", "threshold", "f1", "recall"))


@query("q_wide_opinions", "WITH ev AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 30 AND value < 100) / 4e0 AS s, count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL) SELECT day, " + ", ".join(f"round(max(n / (3 + p + s + n)) FILTER (leaf = '{x}'), 6) AS {x}_b_atk, round(max(3 / (3 + p + s + n)) FILTER (leaf = '{x}'), 6) AS {x}_u" for x in ("click", "error")) + " FROM ev GROUP BY day")
def wide_opinions(spark, sf):
    wide = store.wide_opinions(leaf_opinions(spark, sf), "day", "leaf", ["click", "error"])
    return r6(wide.select("day", *[f"{x}_{c}" for x in ("click", "error") for c in ("b_atk", "u")]))


@query("q_add_events", f"WITH {HIGH} SELECT name, s AS start FROM hi WHERE user_id % 3 <> 0 UNION ALL SELECT name, s + INTERVAL 1 DAY FROM hi WHERE user_id % 3 = 0")
def add_events(spark, sf):
    """Spans of all users, a day later, added to those of some: known names stay as they are."""
    all_ = high_spans(spark, sf)
    return store.add_events(all_.filter("user_id % 3 <> 0"), all_.withColumn("start", F.col("start") + F.expr("interval 1 day"))).select("name", "start")


@query("q_schedule", f"WITH {HIGH} SELECT strftime(s, '%Y-%m-%d %H:%M') || '  ' || strftime(e, '%Y-%m-%d %H:%M') || '  ' || printf('%.2f', (epoch(date_trunc('second', e)) - epoch(date_trunc('second', s))) / 3600) || ' h  ' || name AS line FROM hi")
def schedule(spark, sf):
    return store.schedule(high_spans(spark, sf))


@query("q_faulty_events", f"WITH {HIGH}, f AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'U0' ELSE name END AS name, s, CASE WHEN user_id % 5 = 1 THEN s - INTERVAL 1 HOUR ELSE e END AS e, CASE WHEN user_id % 5 = 2 THEN 0 WHEN user_id % 5 = 3 THEN -1 ELSE 1 END AS g FROM hi), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM f), d AS (SELECT name, CASE WHEN n > 1 THEN 'name repeats' WHEN s <= TIMESTAMP '2024-01-03' THEN 'not after the split' WHEN e <= s THEN 'ends before it begins' WHEN g < 0 THEN 'negative signature' WHEN g = 0 THEN 'no signature' END AS fault FROM c) SELECT * FROM d WHERE fault IS NOT NULL")
def faulty_events(spark, sf):
    """Spans of users, some of them spoilt."""
    u = F.col("user_id") % 5
    df = high_spans(spark, sf).withColumns({
        "name": F.when(F.col("user_id") % 7 == 0, "U0").otherwise(F.col("name")), "end": F.when(u == 1, F.col("start") - F.expr("interval 1 hour")).otherwise(F.col("end")),
        "sig_p": F.when(u == 2, 0.0).when(u == 3, -1.0).otherwise(1.0), "sig_s": F.lit(0.0), "sig_n": F.lit(0.0),
    })
    return store.faulty_events(df, "2024-01-03")


@query("q_table_digest")
def table_digest(spark, sf):
    return spark.createDataFrame([(store.table_digest(table(spark, sf, "nation")),)], "digest string")


@query("q_signature_noise")
def signature_noise(spark, sf):
    """Without noise all are right; tests hold that and that more noise is no better."""
    g = _groups(spark, sf)
    from ..operators.qualification import top_by_trial

    truth = top_by_trial(g, _templates(spark).withColumn("trial", F.lit(0)), "day").select("day", F.col("top1_type").alias("truth"))
    return r6(S.signature_noise(g.join(truth, "day"), _templates(spark), "day", "truth", [0.0, 0.05, 0.3], 3))


@query("q_student_noise")
def student_noise(spark, sf):
    """The same with noise of heavy tails (Student's t of three degrees of freedom)."""
    g = _groups(spark, sf)
    from ..operators.qualification import top_by_trial

    truth = top_by_trial(g, _templates(spark).withColumn("trial", F.lit(0)), "day").select("day", F.col("top1_type").alias("truth"))
    return r6(S.signature_noise(g.join(truth, "day"), _templates(spark), "day", "truth", [0.0, 0.05, 0.3], 3, law="student"))


@query("q_severity_study")
def severity_study(spark, sf):
    """Attacks of two kinds put into the hourly readings of the table, all leaves side by side."""
    return r6(S.severity_study(_hours(spark, sf), F.col("t") < F.lit("2024-01-20").cast("timestamp_ntz"), _attacked(0), ["m_0", "m_1"], ("volumetric", "slowloris"), (1.0,)))


def _hours(spark, sf):
    """t, m_0 and m_1: the number and the sum of readings of each hour."""
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("m_0"), F.sum("value").alias("m_1"))


def _attacked(seed: int):
    """A tenth of the hours, by hash."""
    return F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(10)) == 0


@query("q_smoothing_study", f"WITH RECURSIVE {ATT}, p0 AS (SELECT leaf, day, (p + 1) / (3 + p + s + n) AS safe, (s + 1) / (3 + p + s + n) AS susp, (n + 1) / (3 + p + s + n) AS atk, CASE WHEN n > s THEN 'atk' ELSE 'safe' END AS truth, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i FROM ev), "
       "z AS (SELECT leaf, i, safe AS a, susp AS b, atk AS c FROM p0 WHERE i = 1 UNION ALL SELECT leaf, i, x / (x + y + w), y / (x + y + w), w / (x + y + w) FROM (SELECT q.leaf, q.i, q.safe * (0.9e0 * a + 0.2e0 * b + 0.05e0 * c) AS x, q.susp * (0.08e0 * a + 0.6e0 * b + 0.15e0 * c) AS y, q.atk * (0.02e0 * a + 0.2e0 * b + 0.8e0 * c) AS w FROM z JOIN p0 q ON q.leaf = z.leaf AND q.i = z.i + 1)), "
       "m AS (SELECT truth, CASE WHEN safe >= susp AND safe >= atk THEN 'safe' WHEN susp >= atk THEN 'susp' ELSE 'atk' END AS x, CASE WHEN a >= b AND a >= c THEN 'safe' WHEN b >= c THEN 'susp' ELSE 'atk' END AS y FROM p0 JOIN z USING (leaf, i)) SELECT count(*) AS n, round(avg((x = truth)::INT), 6) AS accuracy, round(avg((y = truth)::INT), 6) AS accuracy_smooth FROM m")  # fmt: skip
def smoothing_study(spark, sf):
    from ..functions import opinions as O

    p = O.Opinion.of().projected()
    df = leaf_opinions(spark, sf).select("leaf", "day", *[x.alias(n) for x, n in zip(p, ("safe", "susp", "atk"), strict=True)], F.when(F.col("b_atk") > F.col("b_susp"), "atk").otherwise("safe").alias("truth"))
    return r6(S.smoothing_study(df, "leaf", "day", ["safe", "susp", "atk"], "truth", [[0.9, 0.08, 0.02], [0.2, 0.6, 0.2], [0.05, 0.15, 0.8]]))


@query("q_run_seeds")
def run_seeds(spark, sf):
    from ..operators.evaluation import triviality

    def build(seed: int):
        train = F.col("t") < F.lit("2024-01-20").cast("timestamp_ntz")
        df = S.attacked(_hours(spark, sf), train, ~train & _attacked(seed), ["m_0", "m_1"], "volumetric", 1.0)
        limit = df.filter(train).agg((F.avg("m_0") + 2 * F.stddev_pop("m_0")).alias("_limit"))  # one row
        return triviality(df.join(F.broadcast(limit), F.lit(True)).withColumn("p", (F.col("m_0") > F.col("_limit")).cast("int")), "y", "p", ["m_0"], train)

    return r6(S.run_seeds(build, [0, 1, 2], ["f1", "f1_trivial"]))


_YD = "yd AS (SELECT ev.*, (EXISTS (SELECT 1 FROM cat WHERE day >= s AND day < e))::INT AS y FROM ev)"
_WBF = "3 / (3 + p + s + n)"


def _labelled(spark, sf):
    from ..operators.joins import interval_label
    from .q_opinions import evidence
    from .q_series import catalog

    return interval_label(evidence(spark, sf), "day", catalog(spark), "y")


@query("q_lost_window_rates", f"""WITH {CAT}, {EV}, {_YD}, d AS (SELECT day, y, share, CASE WHEN y = 0 AND (day(day) * 37 % 100) / 100e0 < share THEN 0 ELSE 1 END AS k, p, s, n FROM yd CROSS JOIN (VALUES (0e0), (0.3e0), (0.6e0)) v(share)),
o AS (SELECT day, y, share, p * k AS p, s * k AS s, n * k AS n, 3 / (3 + (p + s + n) * k) AS u FROM d), f AS (SELECT day, y, share, count(*) AS c, sum(1 - u) AS w, sum((1 - u) * p) / nullif(sum(1 - u), 0) AS p, sum((1 - u) * s) / nullif(sum(1 - u), 0) AS s, sum((1 - u) * n) / nullif(sum(1 - u), 0) AS n FROM o GROUP BY ALL),
a AS (SELECT share, y, (CASE WHEN w < 1e-12 THEN 1e0 / 3 ELSE (n + 1) / (3 + p + s + n) END >= 0.2)::INT AS p FROM f), c AS (SELECT share, {COUNTS} FROM a GROUP BY share) SELECT share, tp, fp, tn, fn, {RATES} FROM c""")
def lost_window_rates(spark, sf):
    """Rates of fused decisions when shares of the quiet days lose their evidence."""
    draw = (F.dayofmonth("day") * 37 % 100) / 100.0
    return r6(S.lost_window_rates(_labelled(spark, sf), "day", "y", draw, [0.0, 0.3, 0.6], 0.2))


@query("q_recalibrated_modes", f"""WITH {CAT}, {EV}, {_YD}, o AS (SELECT day, y, day < TIMESTAMP '2024-01-16' AS cal, p / (3 + p + s + n) AS b0, s / (3 + p + s + n) AS b1, n / (3 + p + s + n) AS b2, 3 / (3 + p + s + n) AS u, p, s, n FROM yd),
f AS (SELECT 'wbf' AS mode, day, y, cal, (sum((1 - u) * n) / sum(1 - u) + 1) / (3 + (sum((1 - u) * p) + sum((1 - u) * s) + sum((1 - u) * n)) / sum(1 - u)) AS x FROM o GROUP BY ALL UNION ALL
SELECT 'minbf', day, y, cal, min(b2) + (1 - min(b0) - min(b1) - min(b2)) / 3 FROM o GROUP BY ALL),
q AS (SELECT mode, quantile_cont(x, 0.8) AS delta FROM f WHERE cal AND y = 0 GROUP BY mode), r AS (SELECT f.mode, delta, y, (x >= delta)::INT AS p FROM f JOIN q ON q.mode = f.mode WHERE NOT cal), c AS (SELECT mode, delta, {COUNTS} FROM r GROUP BY ALL) SELECT mode, round(delta, 6) AS delta, tp, fp, tn, fn, {RATES} FROM c""")
def recalibrated_modes(spark, sf):
    y = _labelled(spark, sf).select("leaf", "day", F.col("y"))
    op = leaf_opinions(spark, sf).join(y, ["leaf", "day"])
    return r6(S.recalibrated_modes(op, "day", "y", F.col("day") < F.lit("2024-01-16").cast("timestamp_ntz"), ["wbf", "minbf"], 0.2))
