"""Residual models and reference detectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.times import seconds
from .calibration import quantiles
from .metrics import running_by
from .segments import meet, numbered


def fourier(ts: Column, period_seconds: float, order: int) -> list[Column]:
    angle = 2 * math.pi * seconds(ts) / period_seconds
    return [f(angle * k) for k in range(1, order + 1) for f in (F.sin, F.cos)]


def seasonal_fit(df: DataFrame, key: str, ts: str, y: str, seasons: Sequence[tuple[float, int]] = ((7 * 86400.0, 3), (86400.0, 4)), ridge: float = 1e-3) -> DataFrame:
    """(key, beta): ridge regression on Fourier terms. The sums X'X and X'y are plain partial
    aggregates, so any number of rows gives one small matrix for each key to solve."""
    x = [F.lit(1.0), *(c for period, order in seasons for c in fourier(F.col(ts), period, order))]
    n = len(x)
    rows = df.filter(F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(n) for j in range(i, n)] + [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(n)]
    packed = rows.groupBy(key).agg(F.array(*sums).alias("sums"))

    @F.pandas_udf("array<double>")
    def solve(s):
        out = []
        for v in s:
            a = np.zeros((n, n))
            a[np.triu_indices(n)] = v[: n * (n + 1) // 2]
            a = a + np.triu(a, 1).T
            out.append(np.linalg.solve(a + ridge * np.diag([0.0] + [1.0] * (n - 1)) + 1e-12 * np.eye(n), v[n * (n + 1) // 2 :]).tolist())
        import pandas as pd

        return pd.Series(out)

    return packed.select(key, solve("sums").alias("beta"))


def seasonal_predict(df: DataFrame, fit: DataFrame, key: str, ts: str, seasons: Sequence[tuple[float, int]] = ((7 * 86400.0, 3), (86400.0, 4))) -> DataFrame:
    """df with yhat: one projection, no Python."""
    x = [F.lit(1.0), *(c for period, order in seasons for c in fourier(F.col(ts), period, order))]
    yhat = F.lit(0.0)
    for i, c in enumerate(x):
        yhat = yhat + F.get("beta", F.lit(i)) * c
    return df.join(fit, key, "left").withColumn("yhat", yhat).drop("beta")


def lad_slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, slope) of the least absolute residuals of y on x through the origin: the median of
    y / x weighted by |x|."""
    r = df.filter((F.col(x) != 0) & F.col(y).isNotNull()).select(*by, (F.col(y) / F.col(x)).alias("_r"), F.abs(F.col(x)).alias("_w"))
    g = running_by(r.groupBy(*by, "_r").agg(F.sum("_w").alias("_w")), by, "_r", ["_w"])
    total = r.groupBy(*by).agg(F.sum("_w").alias("_t"))
    return g.join(total, list(by)).filter(F.col("run__w") >= F.col("_t") / 2).groupBy(*by).agg(F.min("_r").alias("slope"))


#: Slopes that one pass tries for each key.
SLOPES = 16


def _medians(rows: DataFrame, by: Sequence[str], tried: DataFrame) -> DataFrame:
    """by, slope, intercept for each slope of tried: the best intercept is the median of y - slope x."""
    long = meet(rows, tried.groupBy(*by).agg(F.collect_list("slope").alias("_l")), by).select(*by, "_x", "_y", F.explode("_l").alias("slope"))
    rest = F.col("_y") - F.col("slope") * F.col("_x")
    return quantiles(long.select(*by, "slope", rest.alias("_r")), [*by, "slope"], "_r", [0.5]).select(*by, "slope", F.col("q0").alias("intercept"))


def _losses(rows: DataFrame, by: Sequence[str], lines: DataFrame) -> DataFrame:
    """lines (by, slope, intercept; a few for each key) with loss, the sum of absolute residuals."""
    many = meet(rows, lines.groupBy(*by).agg(F.collect_list(F.struct("slope", "intercept")).alias("_l")), by).select(*by, "_x", "_y", F.explode("_l").alias("_c"))
    many = many.select(*by, "_x", "_y", "_c.*")
    return many.groupBy(*by, "slope", "intercept").agg(F.sum(F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))).alias("loss"))


_LINE = ("slope", "intercept", "loss")


def lad_line(df: DataFrame, by: Sequence[str], x: str, y: str, passes: int = 9) -> DataFrame:
    """by, n, slope, intercept, loss of the least absolute residuals.

    The loss, with the best intercept for each slope (a median), is convex in the slope. Each pass
    tries SLOPES slopes for every key at once and keeps the two neighbours of the best; it
    starts around the line of least squares and widens until the best lies inside. Last, the line
    turns about the reading that it passes through, to the weighted median of the slopes to all
    other readings, which is the exact place of the least; a pair of readings then carries it.
    Medians are exact and come from counted brackets, sums are partial aggregates; a pass keeps
    two numbers a key. A key whose x is constant has slope 0 and the median."""
    by = list(by)
    given = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    means = given.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mx"), F.regr_slope("_y", "_x").alias("_b"), F.stddev_pop("_y").alias("_sy"), F.stddev_pop("_x").alias("_sx"))
    ls = cut(means)
    # Centred, so that a slope's rounding isn't multiplied by a large mean of x.
    rows = cut(meet(given, ls.select(*by, "_mx"), by).select(*by, (F.col("_x") - F.col("_mx")).alias("_x"), "_y"))
    start = F.when(F.col("_sx") > 0, F.coalesce("_b", F.lit(0.0))).otherwise(0.0)
    width = F.when(F.col("_sx") > 0, F.col("_sy") / F.col("_sx") + F.abs(start) * 1e-3).otherwise(0.0)
    state = cut(ls.select(*by, (start - width).alias("low"), (start + width).alias("high")))
    best = None
    for _ in range(passes):
        step = (F.col("high") - F.col("low")) / (SLOPES - 1)
        tried = state.select(*by, F.explode(F.array_distinct(F.array(*[F.col("low") + step * i for i in range(SLOPES - 1)], F.col("high")))).alias("slope"))
        found = cut(_losses(rows, by, _medians(rows, by, tried)))
        best = cut(found.groupBy(*by).agg(F.min_by(F.struct(*_LINE), F.struct("loss", "slope")).alias("_t")).select(*by, "_t.*"))
        sides = meet(found.select(*by, F.col("slope").alias("_s")), best, by).groupBy(*by).agg(F.max(F.when(F.col("_s") < F.col("slope"), F.col("_s"))).alias("_l"), F.min(F.when(F.col("_s") > F.col("slope"), F.col("_s"))).alias("_h"), F.first("slope").alias("_m"))
        size = F.col("high") - F.col("low")
        still = size <= 0  # a constant x
        low, high = F.coalesce("_l", F.col("_m") - size * 8), F.coalesce("_h", F.col("_m") + size * 8)
        state = cut(meet(sides, state, by).select(*by, F.when(still, F.col("low")).otherwise(low).alias("low"), F.when(still, F.col("high")).otherwise(high).alias("high")))
    # Turn about the nearest reading, then about the one that the line meets there.
    for _ in range(2):
        off = F.abs(F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))
        pivot = cut(meet(rows, best, by).withColumn("_r", off).groupBy(*by).agg(F.min_by(F.struct(F.col("_x").alias("px"), F.col("_y").alias("py")), F.struct("_r", "_x", "_y")).alias("_p")))
        moved = meet(rows, pivot, by).select(*by, (F.col("_x") - F.col("_p.px")).alias("_u"), (F.col("_y") - F.col("_p.py")).alias("_v"))
        turned = meet(pivot, lad_slope(moved, by, "_u", "_v"), by).filter("slope IS NOT NULL")
        turned = turned.select(*by, "slope", (F.col("_p.py") - F.col("slope") * F.col("_p.px")).alias("intercept"))
        both = best.select(*by, *_LINE).unionByName(_losses(rows, by, turned))
        best = cut(both.groupBy(*by).agg(F.min_by(F.struct(*_LINE), F.struct("loss", "slope")).alias("_t")).select(*by, "_t.*"))
    out = meet(best, ls.select(*by, "_n", "_mx"), by)
    return out.select(*by, F.col("_n").alias("n"), "slope", (F.col("intercept") - F.col("slope") * F.col("_mx")).alias("intercept"), "loss")


def lad_r2(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, folds: int = 5, least: int = 50) -> DataFrame:
    """by, n, r2: mean over expanding folds of 1 - mse / variance of lad_line() fitted to the parts
    before each part; with fewer than least rows, of one line on its own rows. Parts are of equal
    size, the first longer by the remainder."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = numbered(rows, by, order, "_i")
    rows = meet(rows, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    size = F.floor(F.col("_m") / (folds + 1))
    first = F.col("_m") - size * folds
    part = F.when(F.col("_i") < first, 0).otherwise(1 + F.floor((F.col("_i") - first) / F.greatest(size, F.lit(1)))).cast("int")
    rows = cut(rows.select(*by, "_x", "_y", "_m", F.when(F.col("_m") < least, -1).otherwise(part).alias("_part")))
    ahead = F.when(F.col("_part") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("_part") + 1, F.lit(folds)))
    learn = rows.filter(F.col("_part") < folds).select(*by, "_x", "_y", F.explode(ahead).alias("_part"))
    lines = lad_line(learn, [*by, "_part"], "_x", "_y").select(*by, "_part", "slope", "intercept")
    test = meet(rows.filter("_part <> 0"), lines, [*by, "_part"])
    error = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")
    spread = F.var_pop("_y") * F.count("_y")
    scores = test.groupBy(*by, "_part").agg((1 - F.try_divide(F.sum(error * error), F.when(spread > 1e-12, spread))).alias("_r2"), F.first("_m").alias("_m"))
    return scores.groupBy(*by).agg(F.first("_m").alias("n"), F.avg("_r2").alias("r2"))


def robust_z(df: DataFrame, train: Column, metrics: Sequence[str]) -> DataFrame:
    """df with score: the largest |x - median| / (1.4826 MAD) over metrics, from training rows."""

    def medians(values: dict[str, Column]) -> dict[str, float]:
        """Two passes over counted brackets; one number for each metric comes back."""
        long = df.filter(train).select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), v.cast("double").alias("v")) for m, v in values.items()])).alias("r")).select("r.*")
        return {r["m"]: r["q0"] for r in quantiles(long, ["m"], "v", [0.5]).collect()}

    med = medians({m: F.col(m) for m in metrics})
    away = {m: F.abs(F.col(m) - F.lit(med.get(m))) for m in metrics}
    mad = medians(away)
    z = [F.coalesce(away[m] / F.greatest(F.lit(1.4826 * (mad.get(m) or 0.0)), F.lit(1e-9)), F.lit(0.0)) for m in metrics]
    return df.withColumn("score", F.greatest(*z) if len(z) > 1 else z[0])


def shewhart(df: DataFrame, train: Column, metrics: Sequence[str], limit: float = 3.0) -> DataFrame:
    """df with score: the mean positive z over limit, each at most one."""
    s = df.filter(train).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_d_{m}") for m in metrics])
    z = [F.least(F.greatest(F.coalesce(F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_d_{m}")), F.lit(0.0)), F.lit(0.0)) / limit, F.lit(1.0)) for m in metrics]
    total = z[0]
    for c in z[1:]:
        total = total + c
    return df.crossJoin(F.broadcast(s)).withColumn("score", total / len(z)).drop(*[f"_{p}_{m}" for p in "md" for m in metrics])


def pca_error(df: DataFrame, train: Column, metrics: Sequence[str], components: int = 2) -> DataFrame:
    """df with score: squared distance from the leading components of the training rows. The
    covariance is one row of sums; its eigenvectors come back as literals."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    row = df.filter(train).agg(*[F.avg(m) for m in metrics], *[F.covar_pop(a, b) for a, b in pairs]).first()
    mean = [float(v or 0.0) for v in row[: len(metrics)]]
    cov = np.zeros((len(metrics), len(metrics)))
    for (a, b), v in zip(pairs, row[len(metrics) :], strict=True):
        i, j = metrics.index(a), metrics.index(b)
        cov[i, j] = cov[j, i] = v or 0.0
    _, vectors = np.linalg.eigh(cov)
    c = [F.coalesce(F.col(m), F.lit(mu)) - mu for m, mu in zip(metrics, mean, strict=True)]
    dot = lambda v: sum((x * float(k) for x, k in zip(c, v, strict=True)), F.lit(0.0))
    full = sum((x * x for x in c), F.lit(0.0))
    part = sum((dot(v) * dot(v) for v in vectors[:, ::-1][:, :components].T), F.lit(0.0))
    return df.withColumn("score", F.greatest(full - part, F.lit(0.0)))


#: Copies of one row that are numbered in one go.
COPIES = 10_000


def _draw(df: DataFrame, train: Column, metrics: Sequence[str], most: int, seed: int) -> np.ndarray:
    """At most so many training rows, each with the same chance: equal rows are counted and
    numbered, and the smallest hashes of values and number are taken. So a row of many copies is
    drawn in proportion to them, and the draw doesn't depend on how the table is cut into tasks."""
    rows = df.filter(train).select(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, m in enumerate(metrics)])
    values = rows.columns
    counts = rows.groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    # The copies of a row are dealt out in runs, so that no task numbers all of a common one.
    runs = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts, *values, "_from")
    copies = runs.select(*values, F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, "_n") - 1)).alias("_copy"))
    rank = F.xxhash64(*values, "_copy", F.lit(seed))
    drawn = copies.orderBy(rank, *values, "_copy").limit(most).select(*values).collect()
    return np.array([tuple(r) for r in drawn], dtype=float).reshape(-1, len(metrics))


def isolation_forest(df: DataFrame, train: Column, metrics: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """df with score in (0, 1). Each tree sees sample rows of a bounded draw (trees * sample
    training rows, each with the same chance); scoring is vectorised over Arrow batches."""
    drawn = _draw(df, train, metrics, trees * sample, seed)
    rng = np.random.default_rng(seed)
    depth = max(1, math.ceil(math.log2(max(2, min(sample, len(drawn))))))
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, level: int):
        wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
        if level >= depth or not len(wide):
            return level + c(len(x))
        k = int(rng.choice(wide))
        cut = float(rng.uniform(x[:, k].min(), x[:, k].max()))
        return k, cut, grow(x[x[:, k] < cut], level + 1), grow(x[x[:, k] >= cut], level + 1)

    size = min(sample, len(drawn))
    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], 0) for _ in range(trees)] if size else []
    norm = c(size) or 1.0

    def walk(node, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] += node
        elif len(at):
            left = x[at, node[0]] < node[1]
            walk(node[2], x, at[left], out)
            walk(node[3], x, at[~left], out)

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            x, out = np.nan_to_num(pdf[list(metrics)].to_numpy(dtype=float)), np.zeros(len(pdf))
            for tree in forest:
                walk(tree, x, np.arange(len(x)), out)
            yield pdf.assign(score=2.0 ** (-out / max(1, len(forest)) / norm))

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInPandas(run, schema)


def bootstrap_f1(df: DataFrame, order: str, y: str, p: str, block: int = 50, replicates: int = 500, seed: int = 42) -> DataFrame:
    """One row: f1 and its percentile interval from a block bootstrap. Blocks of rows give four
    counts each; a replicate draws blocks (Poisson weights by hash), so rows never move again."""
    from . import metrics as M

    counts = df.withColumn("win_no", F.floor(F.col(order) / block)).groupBy("win_no").agg(*M.confusion(F.col(y), F.col(p)))
    draws = counts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64("win_no", "rep", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    total, weight = 0.0, F.lit(0)
    for i in range(7):  # Poisson(1) by inversion
        total += math.exp(-1) / math.factorial(i)
        weight = weight + (u >= total).cast("int")
    reps = draws.groupBy("rep").agg(*[F.sum(F.col(c) * weight).alias(c) for c in ("tp", "fp", "tn", "fn")])
    f1 = M.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    interval = reps.agg(F.percentile(f1, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]).select(f1.alias("f1")).crossJoin(F.broadcast(interval)).select("f1", F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"))


def _drawn(df: DataFrame, train: Column, metrics: Sequence[str], most: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most so many training rows, standardised; and their mean and scale."""
    x = _draw(df, train, metrics, most, seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(len(metrics))
    scale = x.std(axis=0) if len(x) else np.ones(len(metrics))
    scale = np.where(scale > 0, scale, 1.0)
    return (x - mean) / scale, mean, scale


def _scored(df: DataFrame, metrics: Sequence[str], mean: np.ndarray, scale: np.ndarray, score) -> DataFrame:
    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            x = (np.nan_to_num(pdf[list(metrics)].to_numpy(dtype=float)) - mean) / scale
            yield pdf.assign(score=score(x) if len(x) else np.zeros(0))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def one_class(df: DataFrame, train: Column, metrics: Sequence[str], nu: float = 0.05, features: int = 64, sample: int = 20_000, epochs: int = 20, seed: int = 7) -> DataFrame:
    """df with score: how far a row lies outside a one-class linear model over random Fourier
    features, fitted by stochastic gradient on at most sample training rows."""
    x, mean, scale = _drawn(df, train, metrics, sample, seed)
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(len(metrics), features)) * math.sqrt(2 / max(1, len(metrics)))
    b = rng.uniform(0, 2 * math.pi, features)
    phi = lambda v: math.sqrt(2 / features) * np.cos(v @ w + b)
    z, weights, rho, t = phi(x), np.zeros(features), 0.0, 0
    for _ in range(epochs if len(z) else 0):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            t += 1
            inside = z[at] @ weights < rho
            rate = 1 / (1 + 0.1 * t)
            weights -= rate * (nu * weights - (z[at] * inside[:, None]).mean(axis=0))
            rho -= rate * (inside.mean() - nu)
    return _scored(df, metrics, mean, scale, lambda v: rho - phi(v) @ weights)


def support_vectors(x: np.ndarray, nu: float, gamma: float, tolerance: float = 1e-6, steps: int = 200_000) -> tuple[np.ndarray, float]:
    """(alpha, rho) of the one-class machine with a Gaussian kernel: the dual, alpha in [0, 1 / (nu n)]
    with sum one, by moving weight between the pair of rows that violates the optimum most."""
    n = len(x)
    square = (x * x).sum(axis=1)
    kernel = np.exp(-gamma * np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
    most = 1 / (nu * n)
    alpha = np.zeros(n)
    full = int(nu * n)
    alpha[:full] = most
    if full < n:
        alpha[full] = max(0.0, 1 - full * most)
    gradient = kernel @ alpha
    for _ in range(steps):
        up, down = alpha < most - 1e-15, alpha > 1e-15
        i = int(np.where(up, gradient, np.inf).argmin())
        j = int(np.where(down, gradient, -np.inf).argmax())
        if gradient[j] - gradient[i] < tolerance:
            break
        curve = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min((gradient[j] - gradient[i]) / curve, most - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        gradient += step * (kernel[i] - kernel[j])
    free = (alpha > 1e-12) & (alpha < most - 1e-12)
    if free.any():
        return alpha, float(gradient[free].mean())
    low, high = gradient[alpha <= 1e-12], gradient[alpha >= most - 1e-12]
    ends = [v for v in (high.max() if len(high) else None, low.min() if len(low) else None) if v is not None]
    return alpha, float(np.mean(ends))


def one_class_kernel(df: DataFrame, train: Column, metrics: Sequence[str], nu: float = 0.05, gamma: float | None = None, sample: int = 2000, seed: int = 7) -> DataFrame:
    """df with score: how far a row lies outside the one-class machine with a Gaussian kernel,
    trained on at most sample training rows, drawn with equal chances (with fewer, on all of
    them). gamma is one over the number of metrics by default, as the rows are standardised."""
    x, mean, scale = _drawn(df, train, metrics, sample, seed)
    if not len(x):
        return df.withColumn("score", F.lit(0.0))
    gamma = 1 / (len(metrics) * max(float(x.var()), 1e-12)) if gamma is None else gamma
    alpha, rho = support_vectors(x, nu, gamma)
    held = alpha > 1e-12
    support, weight = x[held], alpha[held]

    def score(v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v))
        for at in range(0, len(v), 1024):
            d = ((v[at : at + 1024, None, :] - support[None]) ** 2).sum(axis=2)
            out[at : at + 1024] = rho - np.exp(-gamma * d) @ weight
        return out

    return _scored(df, metrics, mean, scale, score)
