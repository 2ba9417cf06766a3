"""Queries of the detection path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import opinions as O
from ..functions.lineage import shared_folder
from ..operators import forecast, tails
from . import detection as D
from .registry import query, r6, table

SPINE = """
WITH sums AS (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS win_start, count(*) AS n_obs, avg(value) AS mean FROM events GROUP BY ALL),
span AS (SELECT min(win_start) AS a, max(win_start) AS b FROM sums),
cells AS (SELECT t.event_type, w.win_start, coalesce(s.n_obs, 0) AS n_obs, s.mean
  FROM (SELECT DISTINCT event_type FROM sums) t CROSS JOIN (SELECT unnest(generate_series(a, b, INTERVAL 6 HOURS)) AS win_start FROM span) w
  LEFT JOIN sums s USING (event_type, win_start)),
leaves AS (SELECT 'count:' || event_type AS leaf, 'count' AS grp, win_start, n_obs::DOUBLE AS y FROM cells
  UNION ALL SELECT 'mean:' || event_type, 'mean', win_start, mean FROM cells),
lv AS (SELECT l.*, (epoch(win_start) - epoch(a)) / 21600 < floor(((epoch(b) - epoch(a)) / 21600 + 1) * 0.75) AS calib,
  isodow(win_start) >= 6 AS weekend, hour(win_start) AS hour FROM leaves l, span),
fine AS (SELECT leaf, weekend, hour, avg(y) AS f FROM lv WHERE calib GROUP BY ALL),
coarse AS (SELECT leaf, avg(y) AS c FROM lv WHERE calib GROUP BY ALL),
res AS (SELECT lv.leaf, grp, win_start, calib, y, coalesce(f, c) AS yhat, y - coalesce(f, c) AS resid
  FROM lv LEFT JOIN fine USING (leaf, weekend, hour) LEFT JOIN coarse USING (leaf)),
q AS (SELECT leaf, greatest(quantile_cont(abs(resid), 0.9), 1e-9) AS t_susp, quantile_cont(abs(resid), 0.97) AS a FROM res WHERE calib AND resid IS NOT NULL GROUP BY leaf),
thr AS (SELECT leaf, t_susp, greatest(a, 1.1 * t_susp) AS t_atk, 0.9 * t_susp AS t_base FROM q),
pts AS (SELECT r.leaf, grp, calib, date_trunc('day', win_start)::TIMESTAMP AS day, abs(resid) AS e, t_susp, t_atk, t_base FROM res r JOIN thr USING (leaf) WHERE resid IS NOT NULL),
m AS (SELECT *, CASE WHEN e <= t_base THEN 1 WHEN e < t_susp THEN 1 - (e - t_base) / (t_susp - t_base) ELSE 0 END AS p,
  CASE WHEN e <= t_susp THEN 0 WHEN e < t_atk THEN (e - t_susp) / (t_atk - t_susp) ELSE 1 END AS n FROM pts),
ev AS (SELECT leaf, grp, day, min(calib) AS calib, count(*) AS n_obs, sum(p)::DOUBLE AS ev_p, sum(1 - p - n)::DOUBLE AS ev_s, sum(n)::DOUBLE AS ev_n FROM m GROUP BY ALL),
op AS (SELECT leaf, grp, day, calib, ev_p / (3e0 + ev_p + ev_s + ev_n) AS b_safe, ev_s / (3e0 + ev_p + ev_s + ev_n) AS b_susp, ev_n / (3e0 + ev_p + ev_s + ev_n) AS b_atk,
  3e0 / (3e0 + ev_p + ev_s + ev_n) AS u FROM ev),
gr AS (SELECT grp, day, calib, sum((1 - u) * 3 * b_safe / u) / sum(1 - u) AS r0, sum((1 - u) * 3 * b_susp / u) / sum(1 - u) AS r1, sum((1 - u) * 3 * b_atk / u) / sum(1 - u) AS r2 FROM op GROUP BY ALL),
go AS (SELECT grp, day, calib, r0, r1, r2, (r0 + r1 + r2) / (3 + r0 + r1 + r2) AS c FROM gr),
sy AS (SELECT day, calib, sum(c * r0) / sum(c) AS r0, sum(c * r1) / sum(c) AS r1, sum(c * r2) / sum(c) AS r2 FROM go GROUP BY ALL),
so AS (SELECT day, calib, r0 / (3 + r0 + r1 + r2) AS b_safe, r1 / (3 + r0 + r1 + r2) AS b_susp, r2 / (3 + r0 + r1 + r2) AS b_atk, 3 / (3 + r0 + r1 + r2) AS u FROM sy),
sp AS (SELECT *, b_atk + u / 3 AS proj_atk FROM so),
dl AS (SELECT quantile_cont(proj_atk, 0.95) AS delta FROM sp WHERE calib)
"""


def _events(spark, sf):
    return table(spark, sf, "events").select("ts", "event_type", "value")


@query("q_window_counts", SPINE + "SELECT event_type, win_start, n_obs, round(mean, 6) AS mean FROM cells")
def window_counts(spark, sf):
    return r6(D.cells(_events(spark, sf)))


def _res(spark, sf):
    return D.residuals(D.leaves(D.cells(_events(spark, sf))))


@query("q_residuals", SPINE + "SELECT leaf, grp, win_start, calib, round(y, 6) AS y, round(yhat, 6) AS yhat, round(resid, 6) AS resid FROM res")
def residuals(spark, sf):
    return r6(_res(spark, sf))


@query("q_thresholds", SPINE + "SELECT leaf, round(t_susp, 6) AS t_susp, round(t_atk, 6) AS t_atk, round(t_base, 6) AS t_base FROM thr")
def thresholds(spark, sf):
    return r6(tails.thresholds(_res(spark, sf).filter("calib AND resid IS NOT NULL"), ["leaf"], "resid", 0.9, 0.97))


@query("q_evidence", SPINE + "SELECT leaf, grp, day, calib, n_obs, round(ev_p, 6) AS ev_p, round(ev_s, 6) AS ev_s, round(ev_n, 6) AS ev_n FROM ev")
def evidence(spark, sf):
    return r6(D.evidence(_res(spark, sf)))


@query("q_leaf_opinion", SPINE + "SELECT leaf, day, round(b_safe, 6) AS b_safe, round(b_susp, 6) AS b_susp, round(b_atk, 6) AS b_atk, round(u, 6) AS u FROM op")
def leaf_opinion(spark, sf):
    return r6(D.leaf_opinions(D.evidence(_res(spark, sf))).select("leaf", "day", "b_safe", "b_susp", "b_atk", "u"))


@query("q_group_opinion", SPINE + "SELECT grp, day, round(r0 / (3 + r0 + r1 + r2), 6) AS b_safe, round(r2 / (3 + r0 + r1 + r2), 6) AS b_atk, round(1 - c, 6) AS u FROM go")
def group_opinion(spark, sf):
    return r6(D.group_opinions(D.leaf_opinions(D.evidence(_res(spark, sf)))).select("grp", "day", "b_safe", "b_atk", "u"))


@query("q_decision", SPINE + "SELECT day, calib, round(b_safe, 6) AS b_safe, round(b_susp, 6) AS b_susp, round(b_atk, 6) AS b_atk, round(u, 6) AS u, round(proj_atk, 6) AS proj_atk, round(delta, 6) AS delta, proj_atk >= delta - 1e-12 AS gate_open FROM sp, dl")
def decision(spark, sf):
    out = D.detect(spark, sf).withColumn("gate_open", F.col("proj_atk") >= F.col("delta") - 1e-12)
    return r6(out.select("day", "calib", "b_safe", "b_susp", "b_atk", "u", "proj_atk", "delta", "gate_open"))


#: The detection path with the evidence of each leaf aged by conflict before opinions are made.
_AT = SPINE.index("op AS (")
AGED = SPINE[:_AT].replace("WITH sums", "WITH RECURSIVE sums").replace("\nev AS (", "\nev0 AS (") + """sq AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i FROM ev0),
z AS (SELECT leaf, any_value(grp) AS grp, 0::BIGINT AS i, NULL::TIMESTAMP AS day, NULL::BOOLEAN AS calib, 0e0 AS r0, 0e0 AS r1, 0e0 AS r2 FROM ev0 GROUP BY leaf UNION ALL
  SELECT leaf, grp, i, day, calib, 0.85e0 * (1 - k) * o0 + p, 0.85e0 * (1 - k) * o1 + s, 0.85e0 * (1 - k) * o2 + n FROM (
    SELECT q.leaf, q.grp, q.i, q.day, q.calib, q.ev_p AS p, q.ev_s AS s, q.ev_n AS n, z.r0 AS o0, z.r1 AS o1, z.r2 AS o2,
      least(1, 49e0 / 16 * (z.r0 * q.ev_n + z.r2 * q.ev_p + z.r0 * q.ev_s + z.r1 * q.ev_n) / ((3 + z.r0 + z.r1 + z.r2) * (3 + q.ev_p + q.ev_s + q.ev_n))) AS k FROM z JOIN sq q ON q.leaf = z.leaf AND q.i = z.i + 1)),
ev AS (SELECT leaf, grp, day, calib, r0 AS ev_p, r1 AS ev_s, r2 AS ev_n FROM z WHERE i > 0),
""" + SPINE[_AT:]


@query("q_decision_aged", AGED + "SELECT day, round(b_atk, 6) AS b_atk, round(u, 6) AS u, round(proj_atk, 6) AS proj_atk, round(delta, 6) AS delta, proj_atk >= delta - 1e-12 AS gate_open FROM sp, dl")
def decision_aged(spark, sf):
    from ..operators.ageing import Ageing

    out = D.detect(spark, sf, D.Detection(memory=Ageing(window=4))).withColumn("gate_open", F.col("proj_atk") >= F.col("delta") - 1e-12)
    return r6(out.select("day", "b_atk", "u", "proj_atk", "delta", "gate_open"))


@query(
    "q_empirical_prior",
    SPINE + ", pr AS (SELECT leaf, avg(ev_p / 4) AS p, avg(ev_s / 4) AS s, greatest(avg(ev_n / 4), 0.005) AS n FROM ev WHERE calib GROUP BY leaf) "
    "SELECT leaf, round(p / (p + s + n), 6) AS a_safe, round(s / (p + s + n), 6) AS a_susp, round(n / (p + s + n), 6) AS a_atk FROM pr",
)
def prior(spark, sf):
    return r6(tails.empirical_prior(D.evidence(_res(spark, sf)).filter("calib"), ["leaf"], size=4))


@query("q_decision_threshold", SPINE + "SELECT grp, round(CASE WHEN quantile_cont(s, 0.9) <= min(s) + 1e-12 AND max(s) > min(s) THEN max(s) ELSE quantile_cont(s, 0.9) END, 6) AS delta FROM (SELECT grp, r2 / (3 + r0 + r1 + r2) + (1 - c) / 3 AS s FROM go WHERE calib) GROUP BY grp")
def decision_threshold(spark, sf):
    g = D.group_opinions(D.leaf_opinions(D.evidence(_res(spark, sf)))).filter("calib").withColumn("s", O.Opinion.of().projected()[2])
    return r6(tails.decision_threshold(g, ["grp"], "s", 0.1))


#: The detection path with forecasts and fitted tails in place of means and quantiles.
MODELLED = D.Detection(forecaster=forecast.Forecaster(day_terms=2, hour_terms=0, ridge=1.0), tails=True)


@query("q_decision_modelled")
def decision_modelled(spark, sf):
    """Tests hold its residuals against dense solves and its thresholds against those of the chain."""
    return r6(D.detect(spark, sf, MODELLED).select("day", "proj_atk", "delta", "gate_open"))


@query("q_stream_decision", SPINE + "SELECT day, round(b_safe, 6) AS b_safe, round(b_susp, 6) AS b_susp, round(b_atk, 6) AS b_atk, round(u, 6) AS u, round(proj_atk, 6) AS proj_atk, round(delta, 6) AS delta, proj_atk >= delta - 1e-12 AS gate_open FROM sp, dl WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 12 HOURS")
def stream_decision(spark, sf):
    """All events replayed through the stream: the days that its watermark closes."""
    from ..streaming import decisions as S

    run = f"{shared_folder(spark)}/streams/decisions-{uuid.uuid4().hex}"
    learned, out = f"{run}/learned", f"{run}/out"
    S.learn(_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), learned)
    stream = S.table_stream(spark, sf, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    S.start(stream, learned, out, f"{run}/checkpoint", late="12 hours", availableNow=True).awaitTermination()
    done = S.read_decisions(spark, out).withColumn("gate_open", F.col("proj_atk") >= F.col("delta") - 1e-12)
    return r6(done.select(F.col("day").cast("timestamp_ntz").alias("day"), "b_safe", "b_susp", "b_atk", "u", "proj_atk", "delta", "gate_open"))
