"""Tail thresholds: generalised Pareto fits of excesses, empirical quantiles, decision rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .calibration import quantiles
from .metrics import running_by
from .segments import SEGMENT, framed, meet, numbered, summed


def pwm_fit(excesses: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """by, n, a0, a1, xi, sigma by probability-weighted moments, plotting position (i - 0.35) / n.
    Equal values are counted first; the ranks i of c equal ones after r others add up to
    c r + c (c + 1) / 2."""
    counts = excesses.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    c = F.col("_c").cast("double")
    ranks = c * (F.col("run__c") - c) + c * (c + 1) / 2 - 0.35 * c
    sums = running_by(counts, by, "_x", ["_c"]).groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_x") * c).alias("_s"), F.sum(F.col("_x") * ranks).alias("_r"))
    m = sums.select(*by, "n", (F.col("_s") / F.col("n")).alias("a0"), ((F.col("_s") - F.col("_r") / F.col("n")) / F.col("n")).alias("a1"))
    d = F.col("a0") - 2 * F.col("a1")
    return m.withColumn("xi", -(F.try_divide("a0", d) - 2)).withColumn("sigma", F.try_divide(2 * F.col("a0") * F.col("a1"), d))


def pareto_quantile(t0: Column, xi: Column, sigma: Column, q: Column | float, n: Column, peaks: Column) -> Column:
    """t0 plus the excess that a share q of all n rows passes; t0 if q n >= peaks."""
    share = (q if isinstance(q, Column) else F.lit(q)) * n / peaks
    tail = F.when(F.abs(xi) < 1e-8, -sigma * F.ln(share)).otherwise(F.try_divide(sigma, xi) * (F.pow(share, -xi) - 1))
    return F.when(share >= 1, t0).otherwise(t0 + tail)


def peaks_over(df: DataFrame, by: Sequence[str], x: str, quantile: float = 0.9) -> DataFrame:
    """by, t0, n_total and excess of the rows beyond the quantile of their group."""
    base = quantiles(df, by, x, [quantile]).select(*by, F.col("q0").alias("t0"), F.col("n").alias("n_total"))
    return df.join(base, list(by)).filter(F.col(x) > F.col("t0")).select(*by, "t0", "n_total", (F.col(x) - F.col("t0")).alias("excess"))


def decluster(df: DataFrame, by: Sequence[str], order: str, x: str, run: int, rows: int = SEGMENT) -> DataFrame:
    """The largest row of each cluster; run rows without an exceedance end a cluster."""
    df = framed(df, by, order, 1, 0, lambda w: {"_new": F.coalesce(F.col(order) - F.lag(order).over(w) > run, F.lit(True)).cast("long")}, rows=rows)
    df = summed(df, by, order, {"_c": F.col("_new")}, rows=rows)
    return df.groupBy(*by, "_c").agg(F.max_by(order, F.struct(F.col(x), -F.col(order))).alias(order), F.max(x).alias(x)).drop("_c")


def likelihood_fit(x: np.ndarray) -> tuple[float, float]:
    """(xi, sigma) of the largest likelihood: a profile search over theta = xi / sigma, with
    the exponential as a candidate."""
    x = np.asarray(x, dtype=float)
    n, mean, top = len(x), float(x.mean()), float(x.max())
    best = (0.0, mean, -n * (np.log(mean) + 1)) if mean > 0 else (0.0, 1e-9, -np.inf)

    def profile(theta: float) -> tuple[float, float, float]:
        inner = 1 + theta * x
        if abs(theta) < 1e-12 or (inner <= 0).any():
            return 0.0, mean, -np.inf
        xi = float(np.log(inner).mean())
        sigma = xi / theta
        return xi, sigma, -n * (np.log(sigma) + xi + 1) if sigma > 0 else -np.inf

    for low, high in ((-1 / top * (1 - 1e-6), -1e-9 / top), (1e-9 / top, 10 / mean)):
        grid = np.sign(low + high) * np.geomspace(min(abs(low), abs(high)), max(abs(low), abs(high)), 80)
        scores = [profile(t)[2] for t in grid]
        at = int(np.argmax(scores))
        a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        g = (5**0.5 - 1) / 2
        for _ in range(80):
            c, d = b - g * (b - a), a + g * (b - a)
            if profile(c)[2] > profile(d)[2]:
                b = d
            else:
                a = c
        found = profile((a + b) / 2)
        if found[2] > best[2] and found[0] > -1:
            best = found
    return best[0], best[1]


def maximum_likelihood(excesses: DataFrame, by: str, x: str, passes: int = 5, points: int = 16, least_xi: float | None = -1.0) -> DataFrame:
    """by, n, xi, sigma of the largest likelihood for each key, as likelihood_fit() finds it. Shapes
    up to least_xi, where the likelihood has no bound, are left out, unless it is None.

    Each pass sums ln(1 + theta x) for a grid of theta on either side of zero as partial aggregates,
    and the next grid lies around the best point; so no task holds the rows of a key."""
    rows = excesses.filter(F.col(x).isNotNull()).select(by, F.col(x).cast("double").alias("_x"))
    stats = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_mean"), F.max("_x").alias("_top")).filter("_top > 0")
    ends = lambda sign, low, high: F.struct(F.lit(sign).alias("sign"), F.ln(low).alias("low"), F.ln(high).alias("high"))
    top, mean = F.col("_top"), F.col("_mean")
    grid = stats.select(by, "n", "_mean", "_top", F.explode(F.array(ends(-1.0, 1e-9 / top, (1 - 1e-6) / top), ends(1.0, 1e-9 / top, 10 / mean))).alias("g")).select(by, "n", "_mean", "_top", "g.*")
    n = F.col("n").cast("double")
    for _ in range(passes):
        theta = lambda j: F.col("sign") * F.exp(F.col("low") + (F.col("high") - F.col("low")) * (j / (points - 1)))
        keyed = rows.join(grid, by).groupBy(by, "n", "_mean", "_top", "sign", "low", "high").agg(*[F.avg(F.log1p(theta(j) * F.col("_x"))).alias(f"_l{j}") for j in range(points)])
        xi = [F.col(f"_l{j}") for j in range(points)]
        fit = lambda j: F.struct((-n * (F.ln(xi[j] / theta(j)) + xi[j] + 1)).alias("ll"), F.lit(j).alias("j"), xi[j].alias("xi"), theta(j).alias("theta"))
        ok = F.filter(F.array(*[fit(j) for j in range(points)]), lambda f: f["ll"].isNotNull() & ~F.isnan(f["ll"]))
        best = F.array_max(ok)
        step = (F.col("high") - F.col("low")) / (points - 1)
        keyed = keyed.withColumn("_b", best).withColumn("_step", step).filter("_b IS NOT NULL")
        at = F.col("low") + F.col("_step") * F.col("_b.j")
        grid = keyed.select(by, "n", "_mean", "_top", "sign", F.greatest(F.col("low"), at - F.col("_step")).alias("low"), F.least(F.col("high"), at + F.col("_step")).alias("high"), "_b")
        last, grid = grid, grid.drop("_b")
    sides = (last if least_xi is None else last.filter(F.col("_b.xi") > least_xi)).groupBy(by).agg(F.max("_b").alias("_b"))
    exponential = -F.col("n") * (F.ln("_mean") + 1)
    out = stats.join(sides, by, "left")
    use = F.coalesce(F.col("_b.ll") > exponential, F.lit(False))
    return out.select(by, "n", F.when(use, F.col("_b.xi")).otherwise(0.0).alias("xi"), F.when(use, F.col("_b.xi") / F.col("_b.theta")).otherwise(mean).alias("sigma"))


def quantile_at(df: DataFrame, by: Sequence[str], value: str, shares: DataFrame, share: str) -> DataFrame:
    """by and q: the exact interpolated quantile of each group at a share of its own, from counts of
    the distinct values, which no task has to order as a whole."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    pos = F.col(share) * (F.col("_n") - 1)
    at = meet(meet(running_by(counts, by, "_x", ["_c"]), total, by), shares.select(*by, share), by)
    pick = lambda k: F.min(F.when(F.col("run__c") > k, F.col("_x")))
    ends = at.groupBy(*by).agg(pick(F.floor(pos)).alias("_a"), pick(F.ceil(pos)).alias("_b"), F.first(pos - F.floor(pos)).alias("_f"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))


#: What a pair of tail thresholds comes from, in the order in which they are tried.
FEW_ROWS, FEW_PEAKS, HEAVY, LIKELIHOOD, MOMENTS, EMPIRICAL = "few rows", "few peaks", "heavy tail", "likelihood", "moments", "empirical"


def evt_thresholds(df: DataFrame, by: Sequence[str], e: str, q_susp: float = 0.02, q_atk: float = 0.01, order: str | None = None, run: int = -1, start: float = 0.9, peaks: int = 50, least: int = 10, ratio: float = 1.1, base: float = 0.9, passes: int = 10) -> DataFrame:
    """by, n, n_peaks, t0, xi, sigma, t_susp, t_atk, t_base and reason for each leaf and branch of
    sizes e >= 0 (see calibration.directed()).

    Peaks are the excesses over t0, the start quantile; with run from 0 on, clusters of them give
    their largest (order then says which rows follow each other). The tail is fitted by likelihood,
    and each threshold is the size that q of all rows pass. The chain, with the reason that stands
    in the result:

    few rows     fewer than least: the floor 1e-9 and ratio times it
    few peaks    fewer than peaks: quantiles of e itself
    heavy tail   sigma - xi t0 <= 0, so that the tail could not have begun at zero: quantiles of e
    likelihood   the fit, with a shape over -1
    moments      a likelihood of shape -1 or less has no maximum: probability-weighted moments
    empirical    those give no scale or shape either: t0 plus a quantile of the excesses

    Each step is an aggregate by key over rows stored once; no task holds the rows of a key."""
    keys = list(by)
    rows = df.filter(F.col(e).isNotNull()).select(*keys, *([order] if order else []), F.col(e).cast("double").alias("_e"))
    named = cut(rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))
    q = quantiles(named, ["_key"], "_e", [start, 1 - q_susp, 1 - q_atk]).select("_key", F.col("n"), F.col("q0").alias("t0"), F.col("q1").alias("_qs"), F.col("q2").alias("_qa"))
    q = cut(meet(q, named.groupBy("_key").agg(*[F.first(k).alias(k) for k in keys]), ["_key"]))
    over = meet(named, q.select("_key", "t0", "n"), ["_key"])
    if run >= 0:
        if order is None:
            raise ValueError("clusters need an order")
        over = numbered(over, ["_key"], order, "_row").filter("_e > t0")
        over = meet(decluster(over.select("_key", "_row", "_e"), ["_key"], "_row", "_e", run), q.select("_key", "t0", "n"), ["_key"])
    over = cut(over.filter("_e > t0 AND n >= %d" % least).select("_key", (F.col("_e") - F.col("t0")).alias("_x")))
    ml = maximum_likelihood(over, "_key", "_x", passes, least_xi=None).select("_key", F.col("n").alias("n_peaks"), F.col("xi").alias("_xm"), F.col("sigma").alias("_sm"))
    pw = pwm_fit(over, ["_key"], "_x").select("_key", F.col("xi").alias("_xp"), F.col("sigma").alias("_sp"))
    f = meet(meet(q, ml, ["_key"]), pw, ["_key"]).withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    good = lambda xi, sigma: F.coalesce((F.col(sigma) > 0) & (F.col(xi) > -1) & ~F.isnan(xi), F.lit(False))
    reason = F.when(F.col("n") < least, FEW_ROWS).when(F.col("n_peaks") < peaks, FEW_PEAKS)
    reason = reason.when(F.coalesce(F.col("_sm") - F.col("_xm") * F.col("t0") <= 0, F.lit(False)), HEAVY)
    reason = reason.when(good("_xm", "_sm"), LIKELIHOOD).when(good("_xp", "_sp"), MOMENTS).otherwise(EMPIRICAL)
    f = cut(f.withColumn("reason", reason))
    fitted = F.col("reason").isin(LIKELIHOOD, MOMENTS)
    xi = F.when(fitted, F.when(F.col("reason") == LIKELIHOOD, F.col("_xm")).otherwise(F.col("_xp")))
    sigma = F.when(fitted, F.when(F.col("reason") == LIKELIHOOD, F.col("_sm")).otherwise(F.col("_sp")))
    out = f.withColumns({"xi": xi, "sigma": sigma})
    last = over.join(f.filter(F.col("reason") == EMPIRICAL).select("_key"), "_key", "left_semi")
    for name, share in (("_zs", q_susp), ("_za", q_atk)):
        place = f.select("_key", F.greatest(F.lit(0.0), F.least(1 - share * F.col("n") / F.greatest("n_peaks", F.lit(1)), F.lit(1 - 1e-9))).alias("_share"))
        out = meet(out, quantile_at(last, ["_key"], "_x", place, "_share").withColumnRenamed("q", name), ["_key"])

    def threshold(share: float, own: str, excess: str) -> Column:
        beyond = pareto_quantile(F.col("t0"), F.col("xi"), F.col("sigma"), share, F.col("n"), F.col("n_peaks"))
        rest = F.col("t0") + F.when(share * F.col("n") >= F.col("n_peaks"), 0.0).otherwise(F.col(excess))
        return F.when(F.col("reason") == FEW_ROWS, 1e-9).when(F.col("reason").isin(FEW_PEAKS, HEAVY), F.col(own)).when(fitted, F.greatest(beyond, F.col("t0"))).otherwise(rest)

    susp = threshold(q_susp, "_qs", "_zs")
    out = out.withColumns({"_susp": susp, "_atk": threshold(q_atk, "_qa", "_za")})
    t_susp = F.greatest("_susp", F.lit(1e-9))
    return out.select(*keys, "n", "n_peaks", "t0", "xi", "sigma", t_susp.alias("t_susp"), F.greatest("_atk", ratio * F.col("_susp"), F.lit(1e-9)).alias("t_atk"), (base * t_susp).alias("t_base"), "reason")


def thresholds(df: DataFrame, by: Sequence[str], residual: str, q_susp: float = 0.9, q_atk: float = 0.97, ratio: float = 1.1, base: float = 0.9) -> DataFrame:
    """by, t_susp, t_atk, t_base from empirical quantiles of absolute residuals."""
    q = quantiles(df.select(*by, F.abs(residual).alias("_r")), by, "_r", [q_susp, q_atk])
    susp = F.greatest(F.col("q0"), F.lit(1e-9))
    return q.select(*by, susp.alias("t_susp"), F.greatest(F.col("q1"), ratio * susp).alias("t_atk"), (base * susp).alias("t_base"))


def with_thresholds(df: DataFrame, by: Sequence[str], residual: str, where: Column, q_susp: float = 0.9, q_atk: float = 0.97, ratio: float = 1.1, base: float = 0.9) -> DataFrame:
    """df with the thresholds of its group, from its rows where the condition holds: the same as
    thresholds() without a join, for groups of few rows such as the windows of a leaf."""
    w = Window.partitionBy(*by)
    at = lambda q: F.percentile(F.when(where, F.abs(residual)), F.lit(q)).over(w)
    df = df.withColumn("t_susp", F.when(at(q_susp).isNotNull(), F.greatest(at(q_susp), F.lit(1e-9)))).withColumn("t_atk", at(q_atk))
    return df.withColumns({"t_atk": F.greatest(F.col("t_atk"), ratio * F.col("t_susp")), "t_base": base * F.col("t_susp")})


def decision_threshold(scores: DataFrame, by: Sequence[str], score: str, fpr: float, least: float = 1e-6) -> DataFrame:
    """by, delta: the quantile 1 - fpr of calibration scores; the largest score where that is
    the floor that most windows share, and never below least."""
    ends = scores.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    q = meet(ends, quantiles(scores, by, score, [1 - fpr]).select(*by, F.col("q0").alias("_q")), by)
    delta = F.when((F.col("_q") <= F.col("_low") + 1e-12) & (F.col("_high") > F.col("_low")), F.col("_high")).otherwise(F.col("_q"))
    return q.select(*by, F.greatest(delta, F.lit(least)).alias("delta"))


def empirical_prior(windows: DataFrame, by: Sequence[str], evidence: Sequence[str] = ("ev_p", "ev_s", "ev_n"), size: int = 10, floor: float = 0.005) -> DataFrame:
    """by and a_safe, a_susp, a_atk: mean shares over windows, attack not below the floor."""
    m = windows.groupBy(*by).agg(*[F.avg(F.col(e) / size).alias(f"_{i}") for i, e in enumerate(evidence)])
    parts = [F.col("_0"), F.col("_1"), F.greatest(F.col("_2"), F.lit(floor))]
    s = parts[0] + parts[1] + parts[2]
    return m.select(*by, *[F.try_divide(p, s).alias(n) for p, n in zip(parts, ("a_safe", "a_susp", "a_atk"), strict=True)])
