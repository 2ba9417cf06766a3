"""Queries of the opinion algebra: pairs of leaves' opinions of one day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import opinions as O
from ..operators import ageing, fusion
from .registry import query, r6, table

#: Base rates of the first and second opinion of a pair: fixed values of the queries.
AX, AY = (0.5, 0.3, 0.2), (0.2, 0.3, 0.5)

EV = """
WITH RECURSIVE ev AS (SELECT event_type AS leaf, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value < 30) / 4e0 AS p, count(*) FILTER (value >= 30 AND value < 100) / 4e0 AS s,
  count(*) FILTER (value >= 100) / 4e0 AS n FROM events GROUP BY ALL),
op AS (SELECT leaf, day, p / (3 + p + s + n) AS b0, s / (3 + p + s + n) AS b1, n / (3 + p + s + n) AS b2, 3 / (3 + p + s + n) AS u FROM ev),
pr AS (SELECT x.day, x.leaf AS leaf_x, y.leaf AS leaf_y, x.b0 AS x0, x.b1 AS x1, x.b2 AS x2, x.u AS xu, y.b0 AS y0, y.b1 AS y1, y.b2 AS y2, y.u AS yu,
  0.5e0 AS xa0, 0.3e0 AS xa1, 0.2e0 AS xa2, 0.2e0 AS ya0, 0.3e0 AS ya1, 0.5e0 AS ya2 FROM op x JOIN op y ON x.day = y.day AND x.leaf < y.leaf)
"""


def evidence(spark, sf):
    e = table(spark, sf, "events")
    count = lambda c, n: (F.sum(c.cast("long")) / 4.0).alias(n)
    v = F.col("value")
    return e.groupBy(F.col("event_type").alias("leaf"), F.window("ts", "1 day")["start"].alias("day")).agg(count(v < 30, "ev_p"), count((v >= 30) & (v < 100), "ev_s"), count(v >= 100, "ev_n"))


def leaf_opinions(spark, sf):
    return evidence(spark, sf).select("leaf", "day", *O.from_evidence(tuple(F.col(c) for c in ("ev_p", "ev_s", "ev_n"))).columns())


def pairs(spark, sf):
    op = leaf_opinions(spark, sf)
    rates = lambda a: {n: F.lit(x) for n, x in zip(O.FIELDS[4:], a, strict=True)}
    x = op.withColumns(rates(AX)).select("day", F.col("leaf").alias("leaf_x"), F.struct(*O.FIELDS).alias("x"))
    y = op.withColumns(rates(AY)).select("day", F.col("leaf").alias("leaf_y"), F.struct(*O.FIELDS).alias("y"))
    return x.join(y, "day").filter("leaf_x < leaf_y")


def _pair_query(name, build, sql):
    def run(spark, sf):
        out = build(O.Opinion.of("x."), O.Opinion.of("y."))
        columns = out if isinstance(out, list) else [(c + 1e-9).alias(n) for c, n in zip((*out.b, out.u, out.projected()[2]), ("b_safe", "b_susp", "b_atk", "u", "proj_atk"), strict=True)]
        return r6(pairs(spark, sf).select("day", "leaf_x", "leaf_y", *columns))

    query(name, EV + sql)(run)


# Counts make exact halves in the sixth place; both engines shift them off the tie.
def _final(source: str, proj: str = "b2 + a2 * u") -> str:
    return f"SELECT day, leaf_x, leaf_y, round(b0 + 1e-9, 6) AS b_safe, round(b1 + 1e-9, 6) AS b_susp, round(b2 + 1e-9, 6) AS b_atk, round(u + 1e-9, 6) AS u, round({proj} + 1e-9, 6) AS proj_atk FROM ({source})"


K = "day, leaf_x, leaf_y"
_mean_a2 = "(xa2 + ya2) / 2 AS a2"
_pair_query("q_fuse2_wbf", O.wbf, _final(f"SELECT {K}, ((1-xu)*yu*x0 + (1-yu)*xu*y0)/d AS b0, ((1-xu)*yu*x1 + (1-yu)*xu*y1)/d AS b1, ((1-xu)*yu*x2 + (1-yu)*xu*y2)/d AS b2, (2-xu-yu)*xu*yu/d AS u, ((1-xu)*xa2 + (1-yu)*ya2)/(2-xu-yu) AS a2 FROM (SELECT *, (1-xu)*yu + (1-yu)*xu AS d FROM pr)"))
_pair_query("q_fuse2_cbf", O.cbf, _final(f"SELECT {K}, (x0*yu + y0*xu)/d AS b0, (x1*yu + y1*xu)/d AS b1, (x2*yu + y2*xu)/d AS b2, xu*yu/d AS u, (xa2*yu + ya2*xu - (xa2+ya2)/2*xu*yu)/d AS a2 FROM (SELECT *, xu + yu - xu*yu AS d FROM pr)"))
_pair_query("q_fuse2_abf", O.abf, _final(f"SELECT {K}, (x0*yu + y0*xu)/(xu+yu) AS b0, (x1*yu + y1*xu)/(xu+yu) AS b1, (x2*yu + y2*xu)/(xu+yu) AS b2, 2*xu*yu/(xu+yu) AS u, {_mean_a2} FROM pr"))
_pair_query("q_fuse2_bcf", O.bcf, _final(f"SELECT {K}, (x0*y0 + x0*yu + xu*y0)/d AS b0, (x1*y1 + x1*yu + xu*y1)/d AS b1, (x2*y2 + x2*yu + xu*y2)/d AS b2, xu*yu/d AS u, ((1-xu)*xa2 + (1-yu)*ya2)/(2-xu-yu) AS a2 FROM (SELECT *, 1 - ((1-xu)*(1-yu) - x0*y0 - x1*y1 - x2*y2) AS d FROM pr)"))
_r = "SELECT *, least(x0,y0) AS c0, least(x1,y1) AS c1, least(x2,y2) AS c2, x0-least(x0,y0) AS r0, x1-least(x1,y1) AS r1, x2-least(x2,y2) AS r2, y0-least(x0,y0) AS s0, y1-least(x1,y1) AS s1, y2-least(x2,y2) AS s2, 0.35e0 AS a0, 0.3e0 AS a1, 0.35e0 AS a2 FROM pr"
_c = f"SELECT {K}, c0 + r0*yu + s0*xu + r0*s0 + (r0*s1+r1*s0)*a0/(a0+a1) + (r0*s2+r2*s0)*a0/(a0+a2) AS b0, c1 + r1*yu + s1*xu + r1*s1 + (r1*s0+r0*s1)*a1/(a0+a1) + (r1*s2+r2*s1)*a1/(a1+a2) AS b1, c2 + r2*yu + s2*xu + r2*s2 + (r2*s0+r0*s2)*a2/(a0+a2) + (r2*s1+r1*s2)*a2/(a1+a2) AS b2, xu*yu AS u, a2 FROM ({_r})"
_pair_query("q_fuse2_ccf", O.ccf, _final(f"SELECT {K}, b0/(b0+b1+b2+u) AS b0, b1/(b0+b1+b2+u) AS b1, b2/(b0+b1+b2+u) AS b2, u/(b0+b1+b2+u) AS u, a2 FROM ({_c})"))
_pair_query("q_fuse2_minbf", O.minbf, _final(f"SELECT {K}, least(x0,y0) AS b0, least(x1,y1) AS b1, least(x2,y2) AS b2, 1-least(x0,y0)-least(x1,y1)-least(x2,y2) AS u, {_mean_a2} FROM pr"))
_pair_query("q_fuse2_maxbf", O.maxbf, _final(f"SELECT {K}, m0/greatest(s,1) AS b0, m1/greatest(s,1) AS b1, m2/greatest(s,1) AS b2, greatest(1-s,0) AS u, {_mean_a2} FROM (SELECT *, m0+m1+m2 AS s FROM (SELECT *, greatest(x0,y0) AS m0, greatest(x1,y1) AS m1, greatest(x2,y2) AS m2 FROM pr))"))
_pair_query(
    "q_conflict",
    lambda x, y: [O.conflict_escalation(x.b, y.b).alias("escalation"), O.conflict_canonical(x.b, y.b).alias("canonical"), O.conflict_projected(x, y).alias("projected"), O.conflict_kl(x, y).alias("kl")],
    f"""SELECT {K}, round(x0*y2 + x2*y0 + x0*y1 + x1*y2, 6) AS escalation, round(x0*(y1+y2) + x1*(y0+y2) + x2*(y0+y1), 6) AS canonical,
    round(p0*q2 + p2*q0 + p0*q1 + p1*q2, 6) AS projected, round(1 - exp(-((p0-q0)*ln(p0/q0) + (p1-q1)*ln(p1/q1) + (p2-q2)*ln(p2/q2))), 6) AS kl
    FROM (SELECT *, x0+xa0*xu AS p0, x1+xa1*xu AS p1, x2+xa2*xu AS p2, y0+ya0*yu AS q0, y1+ya1*yu AS q1, y2+ya2*yu AS q2 FROM pr)""",
)
_pair_query(
    "q_unary",
    lambda x, y: [
        *[c.alias(n) for c, n in zip((O.uncertainty_maximised(x).u, O.uncertainty_maximised(x).b[0]), ("um_u", "um_safe"), strict=True)],
        O.trust_discount(x, 0.5).u.alias("trust_u"), O.contextual_discount(x, (1.0, 1.0, 0.25)).u.alias("ctx_u"), O.boost(x, 2.0).u.alias("boost_u"), O.to_evidence(x)[0].alias("r_safe"),
    ],
    f"""SELECT {K}, round(m, 6) AS um_u, round(greatest(x0 + xa0*xu - xa0*m, 0), 6) AS um_safe, round(1 - 0.5e0*(1-xu), 6) AS trust_u, round(1 - x0 - x1 - 0.25e0*x2, 6) AS ctx_u,
    round(3 / (3 + 2*3*(x0+x1+x2)/xu), 6) AS boost_u, round(3*x0/xu, 6) AS r_safe
    FROM (SELECT *, least((x0+xa0*xu)/xa0, (x1+xa1*xu)/xa1, (x2+xa2*xu)/xa2, 1) AS m FROM pr)""",
)


def _n_query(mode, sql):
    @query(f"q_fuse_{mode}", EV + sql)
    def run(spark, sf):
        out = fusion.fuse(leaf_opinions(spark, sf), ["day"], mode)
        return r6(out.select("day", "b_safe", "b_susp", "b_atk", "u"))


_N = "SELECT day, round(r0/(3+r0+r1+r2), 6) AS b_safe, round(r1/(3+r0+r1+r2), 6) AS b_susp, round(r2/(3+r0+r1+r2), 6) AS b_atk, round(3/(3+r0+r1+r2), 6) AS u FROM "
_n_query("wbf", _N + "(SELECT day, sum((1-u)*3*b0/u)/sum(1-u) AS r0, sum((1-u)*3*b1/u)/sum(1-u) AS r1, sum((1-u)*3*b2/u)/sum(1-u) AS r2 FROM op GROUP BY day)")
_n_query("hierarchical", _N + "(SELECT day, avg(3*b0/u) AS r0, avg(3*b1/u) AS r1, avg(3*b2/u) AS r2 FROM op GROUP BY day)")
_n_query("abf", "SELECT day, round(sum(b0/u)/sum(1/u), 6) AS b_safe, round(sum(b1/u)/sum(1/u), 6) AS b_susp, round(sum(b2/u)/sum(1/u), 6) AS b_atk, round(count(*)/sum(1/u), 6) AS u FROM op GROUP BY day")
_n_query("minbf", "SELECT day, round(min(b0), 6) AS b_safe, round(min(b1), 6) AS b_susp, round(min(b2), 6) AS b_atk, round(1-min(b0)-min(b1)-min(b2), 6) AS u FROM op GROUP BY day")
_n_query("maxbf", "SELECT day, round(max(b0)/greatest(max(b0)+max(b1)+max(b2), 1), 6) AS b_safe, round(max(b1)/greatest(max(b0)+max(b1)+max(b2), 1), 6) AS b_susp, round(max(b2)/greatest(max(b0)+max(b1)+max(b2), 1), 6) AS b_atk, round(greatest(1-max(b0)-max(b1)-max(b2), 0), 6) AS u FROM op GROUP BY day")
# Cumulative fusion adds the evidence of its sources.
_n_query("cbf", _N + "(SELECT day, sum(p) AS r0, sum(s) AS r1, sum(n) AS r2 FROM ev GROUP BY day)")
_seq = ", sq AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY leaf) AS i FROM op)"
_bcf = _seq + """, f AS (SELECT day, i, b0, b1, b2, u FROM sq WHERE i = 1 UNION ALL
  SELECT day, i, n0/d, n1/d, n2/d, nu/d FROM (SELECT s.day, s.i, f.b0*s.b0 + f.b0*s.u + f.u*s.b0 AS n0, f.b1*s.b1 + f.b1*s.u + f.u*s.b1 AS n1, f.b2*s.b2 + f.b2*s.u + f.u*s.b2 AS n2, f.u*s.u AS nu,
  1 - ((f.b0+f.b1+f.b2)*(s.b0+s.b1+s.b2) - f.b0*s.b0 - f.b1*s.b1 - f.b2*s.b2) AS d FROM f JOIN sq s ON s.day = f.day AND s.i = f.i + 1))
SELECT day, round(arg_max(b0, i), 6) AS b_safe, round(arg_max(b1, i), 6) AS b_susp, round(arg_max(b2, i), 6) AS b_atk, round(arg_max(u, i), 6) AS u FROM f GROUP BY day"""
_n_query("bcf", _bcf)


@query("q_fuse_ccf")
def fuse_ccf(spark, sf):
    return r6(fusion.fuse(leaf_opinions(spark, sf), ["day"], "ccf"))


def _aged(rate: str) -> str:
    return f""", sq AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i FROM ev),
z AS (SELECT leaf, 0::BIGINT AS i, NULL::TIMESTAMP AS day, 0e0 AS k, 0e0 AS l, 0e0 AS r0, 0e0 AS r1, 0e0 AS r2 FROM ev GROUP BY leaf UNION ALL
  SELECT leaf, i, day, k, {rate}, {rate} * o0 + p, {rate} * o1 + s, {rate} * o2 + n FROM (
    SELECT q.leaf, q.i, q.day, q.p, q.s, q.n, z.r0 AS o0, z.r1 AS o1, z.r2 AS o2,
      least(1, 1 / (100e0 / 169) * (z.r0*q.n + z.r2*q.p + z.r0*q.s + z.r1*q.n) / ((3+z.r0+z.r1+z.r2) * (3+q.p+q.s+q.n))) AS k
    FROM z JOIN sq q ON q.leaf = z.leaf AND q.i = z.i + 1))
"""


@query("q_ageing_adaptive", EV + _aged("0.85e0 * (1 - k)") + "SELECT leaf, day, round(k, 6) AS k_eff, round(l, 6) AS lambda_dyn, round(r0, 6) AS acc_safe, round(r1, 6) AS acc_susp, round(r2, 6) AS acc_atk FROM z WHERE i > 0")
def ageing_adaptive(spark, sf):
    return r6(_aged_df(spark, sf, ageing.Ageing(window=10)))


def _aged_df(spark, sf, params):
    return ageing.age(evidence(spark, sf), "leaf", "day", params=params)


@query("q_ageing_fixed", EV + _aged("0.85e0") + "SELECT leaf, day, round(l, 6) AS lambda_dyn, round(r0, 6) AS acc_safe, round(r1, 6) AS acc_susp, round(r2, 6) AS acc_atk FROM z WHERE i > 0")
def ageing_fixed(spark, sf):
    return r6(_aged_df(spark, sf, ageing.Ageing(conflict="none")).drop("k_eff"))


@query("q_ageing_last", EV + _aged("0.85e0 * (1 - k)") + "SELECT leaf, round(arg_max(r0, i), 6) AS acc_safe, round(arg_max(r1, i), 6) AS acc_susp, round(arg_max(r2, i), 6) AS acc_atk FROM z WHERE i > 0 GROUP BY leaf")
def ageing_last(spark, sf):
    return r6(ageing.age_small(evidence(spark, sf), "leaf", "day"))


SEQ = EV + ", sq AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY day) AS i FROM ev)"


@query("q_online_rmse", SEQ + ", z AS (SELECT DISTINCT leaf, 0::BIGINT AS i, NULL::TIMESTAMP AS day, -1e0 AS m, 1 AS ok FROM ev UNION ALL SELECT q.leaf, q.i, q.day, CASE WHEN q.n >= 2 THEN z.m WHEN z.m < 0 OR z.ok = 0 THEN q.s * q.s ELSE 0.9e0 * z.m + 0.1e0 * q.s * q.s END, (q.n < 2)::INT FROM z JOIN sq q ON q.leaf = z.leaf AND q.i = z.i + 1) SELECT leaf, day, round(CASE WHEN m >= 0 THEN sqrt(m) END, 6) AS ewma_rmse FROM z WHERE i > 0")
def online_rmse(spark, sf):
    df = evidence(spark, sf).withColumn("safe", (F.col("ev_n") < 2).cast("int"))
    return r6(ageing.online_rmse(df, "leaf", "day", "ev_s", "safe"))


@query("q_hmm_smooth", SEQ + ", p0 AS (SELECT leaf, day, i, (p + 1) / (3 + p + s + n) AS a, (s + 1) / (3 + p + s + n) AS b, (n + 1) / (3 + p + s + n) AS c FROM sq), z AS (SELECT leaf, i, day, a, b, c FROM p0 WHERE i = 1 UNION ALL SELECT leaf, i, day, x / (x + y + w), y / (x + y + w), w / (x + y + w) FROM (SELECT q.leaf, q.i, q.day, q.a * (0.9e0 * z.a + 0.2e0 * z.b + 0.05e0 * z.c) AS x, q.b * (0.08e0 * z.a + 0.6e0 * z.b + 0.15e0 * z.c) AS y, q.c * (0.02e0 * z.a + 0.2e0 * z.b + 0.8e0 * z.c) AS w FROM z JOIN p0 q ON q.leaf = z.leaf AND q.i = z.i + 1)) SELECT leaf, day, round(a, 6) AS smooth_safe, round(b, 6) AS smooth_susp, round(c, 6) AS smooth_atk FROM z")
def hmm(spark, sf):
    df = leaf_opinions(spark, sf)
    p = O.Opinion.of().projected()
    df = df.select("leaf", "day", *[x.alias(n) for x, n in zip(p, ("safe", "susp", "atk"), strict=True)])
    return r6(ageing.smooth(df, "leaf", "day", ["safe", "susp", "atk"], [[0.9, 0.08, 0.02], [0.2, 0.6, 0.2], [0.05, 0.15, 0.8]]))
