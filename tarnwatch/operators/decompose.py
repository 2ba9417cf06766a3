"""Seasonal-trend decomposition by LOESS, robust to outliers, of series of any length.

The decomposition of a series y = season + trend + rest runs two loops. The inner one smooths
each position of the period along the periods, takes the low-pass of that away and smooths what
is left to the trend. The outer one gives readings of a large rest (against six medians of
its size) less weight. Given weights and trend, an inner pass reaches a bounded number of periods
to either side: REACH of them. So a series is cut into blocks which take that many periods of
their neighbours along, each block is worked on in numpy by its own task, and a block's own rows
come out as those of the whole series. The medians are those of the whole series.

Local lines are fitted to the nearest points by tricube weights. Where a window's points have next
to no spread left, its weighted mean stands for the line.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .calibration import quantiles
from .segments import meet, numbered
from .timeseries import interpolate

#: Periods that two inner passes reach to either side.
REACH = 12
#: Rows of a series in a block, without those of its neighbours.
BLOCK_ROWS = 500_000


def odd_above(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def tricube(distance: np.ndarray, width: float) -> np.ndarray:
    r = distance / width
    return np.where(r >= 0.999, 0.0, np.where(r <= 0.001, 1.0, (1 - np.minimum(r, 1) ** 3) ** 3))


def _line(s0, s1, s2, b0, b1, width):
    """Value at zero of the weighted line from its sums; the mean without spread."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, centre = b0 / s0, s1 / s0
        spread = s2 / s0 - centre**2
        slope = np.where(spread > (1e-3 * width) ** 2, (b1 / s0 - centre * mean) / spread, 0.0)
    return mean - slope * centre


def loess(y: np.ndarray, weights: np.ndarray, span: int, extend: int = 0) -> np.ndarray:
    """Local lines at the positions -extend ... n - 1 + extend of an evenly spaced series."""
    n = len(y)
    q = min(span, n)
    out = np.empty(n + 2 * extend)
    half = span // 2
    wy = weights * y
    inner = np.empty(0, int)
    if n > span:
        # Away from the ends every window has the same weights: five correlations.
        d = np.arange(-half, half + 1)
        k = tricube(np.abs(d), max(half, 1))
        sums = [np.correlate(v, k * d**p, "valid") for v, p in ((weights, 0), (weights, 1), (weights, 2), (wy, 0), (wy, 1))]
        inner = np.arange(half, n - half)
        out[inner + extend] = _line(*sums, max(half, 1))
    for at in sorted(set(range(-extend, n + extend)) - set(inner.tolist())) if len(inner) < 64 else [*range(-extend, half), *range(n - half, n + extend)]:
        left = min(max(at - half, 0), n - q)
        d = np.arange(left, left + q) - at
        width = max(np.abs(d).max() + max(0, (span - n) // 2), 1)
        k = tricube(np.abs(d), width)
        w, v = weights[left : left + q] * k, wy[left : left + q] * k
        out[at + extend] = _line(w.sum(), (w * d).sum(), (w * d * d).sum(), v.sum(), (v * d).sum(), width)
    # A window whose points have all lost their weight keeps the reading itself.
    whole = np.concatenate([np.full(extend, y[0]), y, np.full(extend, y[-1])])
    return np.where(np.isfinite(out), out, whole)


def _average(x: np.ndarray, size: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[size:] - c[:-size]) / size


def inner_passes(y: np.ndarray, weights: np.ndarray, trend: np.ndarray, period: int, seasonal: int = 7, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Season and trend after so many inner passes."""
    n, season = len(y), np.zeros(len(y))
    low, wide = odd_above(period + 1), odd_above(1.5 * period / (1 - 1.5 / seasonal))
    for _ in range(passes):
        cycle = np.empty(n + 2 * period)
        flat = y - trend
        for phase in range(period):
            cycle[phase::period] = loess(flat[phase::period], weights[phase::period], seasonal, 1)
        passed = _average(_average(_average(cycle, period), period), 3)
        season = cycle[period : period + n] - loess(passed, np.ones(n), low)
        trend = loess(y - season, weights, wide)
    return season, trend


def robust_weights(rest: np.ndarray, width: np.ndarray | float) -> np.ndarray:
    """Bisquare weights; width: six medians of the size of the rest."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.abs(rest) / width
    return np.where(~(np.asarray(width) > 0) | (u <= 0.001), 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))


def decompose(df: DataFrame, by: Sequence[str], order: str, column: str, period: int, seasonal: int = 7, outer: int = 15, settled: float = 1e-3, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with season, trend and rest. Nulls are filled by position first. At most outer passes
    with new weights, fewer once no weight moves by more than settled. A series of fewer than two
    periods, or without any value, has nulls."""
    by = list(by)
    df = interpolate(numbered(df, by, order, "_pos"), by, "_pos", column)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count(column).alias("_known"))
    long = F.coalesce((F.col("_n") >= 2 * period) & (F.col("_known") > 0), F.lit(False))
    df = cut(meet(df, size, by).withColumn("_long", long).drop("_n", "_known"))
    state = df.filter("_long").select(*by, "_pos", F.col(column).cast("double").alias("_y"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_t"))
    kinds = ", ".join(f"{n} {t}" for n, t in state.select(*by, "_pos").dtypes)
    halo = REACH * period + 1
    block = max(rows, halo)

    def work(pdf):
        pdf = pdf.sort_values("_pos")
        y, w, t = (pdf[c].to_numpy(dtype=float) for c in ("_y", "_w", "_t"))
        season, trend = inner_passes(y, w, t, period, seasonal)
        return pdf.assign(_s=season, _t=trend)[pdf["_own"]].drop(columns=["_own", "_block"])

    for step in range(outer + 1):
        at, inside = F.floor(F.col("_pos") / block), F.col("_pos") % block
        near = F.array_compact(F.array(at, F.when(inside >= block - halo, at + 1), F.when((inside < halo) & (at > 0), at - 1)))
        wide = state.withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == at)
        # A block that only holds neighbours' rows has nothing of its own to give.
        done = wide.groupBy(*by, "_block").applyInPandas(work, f"{kinds}, _y double, _w double, _t double, _s double")
        done = cut(done.withColumn("_r", F.col("_y") - F.col("_s") - F.col("_t")))
        if step == outer:
            break
        median = quantiles(done.select(*by, F.abs("_r").alias("_a")), by, "_a", [0.5]).select(*by, (6 * F.col("q0")).alias("_h"))
        u = F.abs("_r") / F.col("_h")
        weight = F.when(~(F.col("_h") > 0) | (u <= 0.001), 1.0).when(u <= 0.999, F.pow(1 - u * u, F.lit(2))).otherwise(0.0)
        done = cut(meet(done, median, by).withColumn("_new", weight))
        moved = done.agg(F.max(F.abs(F.col("_new") - F.col("_w")))).first()[0]  # one number
        state = done.select(*by, "_pos", "_y", F.col("_new").alias("_w"), "_t")
        if moved is None or moved <= settled:
            break
    parts = done.select(*by, "_pos", F.col("_s").alias("season"), F.col("_t").alias("trend"), F.col("_r").alias("rest"))
    return meet(df, parts, [*by, "_pos"]).drop("_pos", "_long")


def stl_vote(df: DataFrame, by: Sequence[str], order: str, column: str, period: int, sigmas: float = 3.0, **options) -> DataFrame:
    """df with season, trend, rest and vote: 1 where the rest of the robust decomposition is
    beyond sigmas of its deviations in the series; null (no vote) where there is no decomposition."""
    out = decompose(df, by, order, column, period, **options)
    out = meet(out, out.groupBy(*by).agg(F.stddev_pop("rest").alias("_d")), by)
    return out.withColumn("vote", (F.abs("rest") > sigmas * F.col("_d")).cast("int")).drop("_d")
