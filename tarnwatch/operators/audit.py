"""Audits of alarms: exceedances, episodes, false alarms, distribution shift, sensitivities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, kolmogorov_tail
from ..functions.stats import correlation
from ..functions.times import micros
from .calibration import quantiles
from .joins import interval_join
from .metrics import running


def joint_exceedance(df: DataFrame, by: Sequence[str], win: str, score: Column, delta: float, most: int = 8) -> DataFrame:
    """by, k, share: of the windows, those where k rows or more reach delta, k = 1..most."""
    n = df.groupBy(*by, win).agg(F.sum((score >= delta).cast("int")).alias("n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    return n.select(*by, "n", k).groupBy(*by, "k").agg(F.avg((F.col("n") >= F.col("k")).cast("double")).alias("share"))


def near_miss(df: DataFrame, ts: str, score: str, delta: float) -> DataFrame:
    """(day, n, high): rows of at least delta / 2 and below delta, and those of its upper half."""
    near = df.filter((F.col(score) >= delta / 2) & (F.col(score) < delta))
    return near.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(score) >= 0.75 * delta).cast("long")).alias("high"))


def episode_profile(df: DataFrame, keys: Sequence[str], ts: str, kind: str, score: str) -> DataFrame:
    """keys, duration_s, modal kind (first by name of equals), mean and max score, severity."""
    kinds = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"), F.max(score).alias("_m"), F.min(micros(ts)).alias("_a"), F.max(micros(ts)).alias("_b"))
    best = F.min_by(kind, F.struct(-F.col("_n"), F.col(kind)))
    out = kinds.groupBy(*keys).agg(((F.max("_b") - F.min("_a")) / 1e6).alias("duration_s"), best.alias("modal"), (F.sum("_s") / F.sum("_n")).alias("mean_score"), F.max("_m").alias("max_score"))
    return out.withColumn("severity", F.col("duration_s") * F.col("max_score"))


def around_events(df: DataFrame, ts: str, score: str, events: DataFrame, before_s: float, after_s: float) -> DataFrame:
    """(name, before, during, after): mean scores around the stated events."""
    a, b, t = micros("_s"), micros("_e"), micros(ts)
    wide = events.select("name", F.col("start").alias("_s"), F.col("end").alias("_e"), (F.col("start") - F.expr(f"interval {float(before_s)} seconds")).alias("start"), (F.col("end") + F.expr(f"interval {float(after_s)} seconds")).alias("end"))
    joined = interval_join(df.select(ts, score), ts, wide, ["name", "_s", "_e"])
    mean = lambda c: F.avg(F.when(c, F.col(score)))
    return joined.groupBy("name").agg(mean(t < a).alias("before"), mean((t >= a) & (t < b)).alias("during"), mean(t >= b).alias("after"))


def annual_projection(rates: DataFrame, n: str, fpr: str, windows: int = 105_120) -> DataFrame:
    """One row: false alarms a year, regimes weighted by their share of windows."""
    return rates.agg((F.sum(F.col(n) * F.col(fpr)) / F.sum(n) * windows).alias("fp_per_year"))


def ks_distance(df: DataFrame, x: str, group: Column) -> DataFrame:
    """One row: ks, the largest distance of the two groups' distribution functions, and its p.
    Both are null where a group has no rows."""
    c = df.groupBy(F.col(x).alias("x")).agg(F.sum(group.cast("long")).alias("a"), F.sum((~group).cast("long")).alias("b"))
    total = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # one row
    c = running(c, "x", ["a", "b"]).crossJoin(F.broadcast(total))
    out = c.agg(F.max(F.abs(F.try_divide("run_a", "na") - F.try_divide("run_b", "nb"))).alias("ks"), F.max("na").alias("_na"), F.max("nb").alias("_nb"))
    return out.select("ks", kolmogorov_tail(F.col("ks"), F.col("_na"), F.col("_nb")).alias("p"))


def time_to_detect(safe: float | Column, attack: float | Column, rate: float, threshold: float, w: float = 3.0, most: int = 50) -> Column:
    """Windows of constant evidence until the attack belief reaches the threshold; null if never."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("a"), F.lit(None).cast("int").alias("hit"))

    def step(acc: Column, i: Column) -> Column:
        s, a = rate * acc["s"] + safe, rate * acc["a"] + attack
        return F.struct(s.alias("s"), a.alias("a"), F.coalesce(acc["hit"], F.when(a / (w + s + a) >= threshold, i)).alias("hit"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step)["hit"]


def drop_windows(df: DataFrame, keys: Sequence[str], share: float, columns: Sequence[str], seed: int = 1) -> DataFrame:
    """df with the evidence of a share of its windows set to zero, chosen by hash of the keys."""
    lost = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.withColumns({c: F.when(lost, F.lit(0.0)).otherwise(F.col(c)) for c in columns}).withColumn("lost", lost)


def perturb(df: DataFrame, columns: Sequence[str], sigma: float, seed: int = 1) -> DataFrame:
    """Gaussian noise on state shares, clipped at zero and scaled back to their sum."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    df = df.withColumn("_t", total).withColumns({f"_p_{c}": F.greatest(F.col(c) + sigma * F.col("_t") * F.randn(seed + i), F.lit(0.0)) for i, c in enumerate(columns)})
    new = sum((F.col(f"_p_{c}") for c in columns), F.lit(0.0))
    return df.withColumn("_u", new).withColumns({c: F.when(F.col("_u") > 0, F.col(f"_p_{c}") * F.col("_t") / F.col("_u")).otherwise(F.col(c)) for c in columns}).drop("_t", "_u", *[f"_p_{c}" for c in columns])


def correlation_summary(df: DataFrame, metrics: Sequence[str]) -> dict:
    """Correlations of stated metrics in one pass, and what follows from the small matrix:
    mean and max |rho|, spectral radius, variance inflation, Bartlett's statistic and its p (a
    singular matrix has an infinite statistic and p 0)."""
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i)]
    row = df.agg(F.count(F.lit(1)), *[correlation(metrics[i], metrics[j]) for i, j in pairs]).first()
    r = np.eye(len(metrics))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        r[i, j] = r[j, i] = v or 0.0
    off = np.abs(r[np.tril_indices(len(metrics), -1)])
    k, n = len(metrics), row[0]
    vif = 1 / np.maximum(1 / np.maximum(np.diag(np.linalg.pinv(r)), 1e-12), 1e-9)
    sign, log_det = np.linalg.slogdet(r)
    chi2 = -(n - 1 - (2 * k + 5) / 6) * float(log_det) if sign > 0 and np.isfinite(log_det) else math.inf
    one = df.sparkSession.range(1)
    p = 0.0 if math.isinf(chi2) else one.select(chi2_tail(F.lit(max(chi2, 0.0)), F.lit(k * (k - 1) // 2))).first()[0] if k > 1 else 1.0
    top = float(off.max()) if len(off) else 0.0
    return {"n": n, "mean_abs": float(off.mean()) if len(off) else 0.0, "max_abs": top, "radius": float(np.abs(np.linalg.eigvalsh(r)).max()), "vif": dict(zip(metrics, vif.tolist())), "bartlett": chi2, "bartlett_p": p, "band": "LOW" if top < 0.3 else "MODERATE" if top < 0.6 else "HIGH"}


def over_runs(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """metric, n, mean, std, low, high over runs."""
    return runs.groupBy(metric).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def regime_diagnosis(leaves: DataFrame, fused: DataFrame, regime: str, leaf: str, win: str, score: str, delta: float, k: int = 3, factor: float = 2.0, busy: str = "ACTIVE", quiet: str = "QUIET") -> DataFrame:
    """One row: where the alarms of the busy regime come from. leaves has a row for each window and
    leaf, fused one for each window, both with regime and score.

    evidence_ratio is the median over leaves of the busy rate of exceedances over the quiet one,
    fused_ratio that of the fused score's 99.9 % quantiles, joint_ratio that of the shares of windows
    in which k leaves or more exceed. The first beyond the factor, in this order, names the
    verdict: evidence, fusion, correlation, else inconclusive. A ratio to zero is null."""
    over = (F.col(score) >= delta).cast("double")
    side = lambda name, c: F.avg(F.when(F.col(regime) == name, c))
    rates = leaves.groupBy(leaf).agg(side(busy, over).alias("a"), side(quiet, over).alias("b"))
    ratios = rates.select(F.try_divide("a", F.when(F.col("b") > 0, F.col("b"))).alias("r"))
    evidence = ratios.agg(F.percentile("r", F.lit(0.5)).alias("evidence_ratio"))  # a row for each leaf
    tails = quantiles(fused.filter(F.col(regime).isin(busy, quiet)), [regime], score, [0.999]).agg(F.max(F.when(F.col(regime) == busy, F.col("q0"))).alias("a"), F.max(F.when(F.col(regime) == quiet, F.col("q0"))).alias("b"))
    counts = leaves.groupBy(regime, win).agg(F.sum(over).alias("n"))
    joint = counts.agg(side(busy, (F.col("n") >= k).cast("double")).alias("c"), side(quiet, (F.col("n") >= k).cast("double")).alias("d"))
    ratio_ = lambda x, y: F.try_divide(x, F.when(F.col(y) > 0, F.col(y)))
    out = evidence.join(tails, F.lit(True)).join(joint, F.lit(True)).select("evidence_ratio", ratio_("a", "b").alias("fused_ratio"), ratio_("c", "d").alias("joint_ratio"))  # one row each
    verdict = F.when(F.col("evidence_ratio") > factor, "evidence").when(F.col("fused_ratio") > factor, "fusion").when(F.col("joint_ratio") > factor, "correlation").otherwise("inconclusive")
    return out.withColumn("verdict", verdict)
