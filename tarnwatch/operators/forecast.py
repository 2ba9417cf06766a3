"""A seasonal forecaster with an interval, holidays and days of two kinds; and its refits over time.

The level is flat; seasons are Fourier terms: one over the week, one over the day for working days
and another for weekends and holidays, one over the hour; each holiday has a term of its own. A
normal prior on all terms but the level (their variance over that of the noise is 1 / ridge) gives
a ridge regression with the covariance of its coefficients, and so the interval of a forecast.
Multiplicative seasons are additive ones of the logarithm; only positive readings can have those.

All terms depend on the second of the week and the holiday alone. Readings are first summed by
day and second, and a day's sums give one small matrix, X'X with X'y and y'y. A fit adds the
matrices of a key's days; a fit for each fold of a rolling origin adds those before its origin; and
the error on a test day follows from that day's matrix. Readings are read once, and no task holds
more than the seconds of one day or the matrices of one key's days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds
from .segments import meet

WEEK, DAY = 604_800, 86_400


@dataclass(frozen=True)
class Forecaster:
    week_terms: int = 3
    day_terms: int = 12
    hour_terms: int = 5
    holidays: dict[str, str] = field(default_factory=dict)  # date (yyyy-mm-dd) to name
    multiplicative: bool = False
    ridge: float = 1e-2
    level: float = 0.95

    @property
    def names(self) -> list[str]:
        return sorted(set(self.holidays.values()))

    @property
    def size(self) -> int:
        return 1 + 2 * self.week_terms + 4 * self.day_terms + 2 * self.hour_terms + len(self.names)

    def design(self, second: np.ndarray, holiday: np.ndarray) -> np.ndarray:
        """Terms at seconds of the week (which begins on a Thursday, as 1970 did) and holidays
        (numbers of names, -1 for none)."""

        def season(period: float, terms: int) -> np.ndarray:
            angle = 2 * np.pi * np.outer(second / period, np.arange(1, terms + 1))
            return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)

        off = (np.isin(second // DAY, (2, 3)) | (holiday >= 0))[:, None]
        day = season(DAY, self.day_terms)
        marks = holiday[:, None] == np.arange(len(self.names))
        return np.concatenate([np.ones((len(second), 1)), season(WEEK, self.week_terms), day * ~off, day * off, season(3600, self.hour_terms), marks], axis=1)

    def solve(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Coefficients, the inverse of X'X with the prior, and the variance of the noise; gram
        holds X'X bordered by X'y and y'y."""
        k = self.size
        a, b, yy = gram[:k, :k], gram[:k, k], gram[k, k]
        inverse = np.linalg.inv(a + self.ridge * np.diag([1e-9] + [1.0] * (k - 1)))
        beta = inverse @ b
        error = max(float(yy - 2 * beta @ b + beta @ a @ beta), 0.0)
        spent = float(np.trace(inverse @ a))  # effective number of coefficients
        return beta, inverse, error / max(gram[0, 0] - spent, 1.0)


def _value(p: Forecaster, y: str) -> Column:
    v = F.col(y).cast("double")
    v = F.when(~F.isnan(v), v)
    return F.when(v > 0, F.ln(v)) if p.multiplicative else v


def _holiday(p: Forecaster, ts: str) -> Column:
    out = F.lit(-1)
    for date, name in p.holidays.items():
        out = F.when(F.to_date(ts) == F.lit(date).cast("date"), p.names.index(name)).otherwise(out)
    return out.cast("int")


def _cells(df: DataFrame, by: Sequence[str], ts: str, y: str, p: Forecaster) -> DataFrame:
    """Sums by key, day and second."""
    rows = df.select(*by, seconds(ts).alias("_t"), _holiday(p, ts).alias("_h"), _value(p, y).alias("_y")).filter("_y IS NOT NULL AND _t IS NOT NULL")
    at = [F.floor(F.col("_t") / DAY).cast("long").alias("_day"), F.pmod("_t", F.lit(WEEK)).cast("int").alias("_second")]
    return rows.groupBy(*by, *at, "_h").agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))


def day_matrices(df: DataFrame, by: Sequence[str], ts: str, y: str, p: Forecaster) -> DataFrame:
    """by, _day and _m, the bordered matrix of the day's readings."""
    cells = _cells(df, by, ts, y, p)
    kinds = ", ".join(f"{n} {t}" for n, t in cells.select(*by, "_day").dtypes)

    def work(pdf):
        x = p.design(pdf["_second"].to_numpy(dtype=np.int64), pdf["_h"].to_numpy(dtype=np.int64))
        n, s = pdf["_c"].to_numpy(dtype=float), pdf["_s"].to_numpy(dtype=float)
        m = np.empty((p.size + 1, p.size + 1))
        m[:-1, :-1] = x.T @ (n[:, None] * x)
        m[:-1, -1] = m[-1, :-1] = x.T @ s
        m[-1, -1] = pdf["_q"].sum()
        out = pdf.iloc[:1][[*by, "_day"]].copy()
        out["_m"] = [m.reshape(-1)]
        return out

    return cells.groupBy(*by, "_day").applyInPandas(work, f"{kinds}, _m array<double>")


def fit(df: DataFrame, by: Sequence[str], ts: str, y: str, p: Forecaster = Forecaster()) -> DataFrame:
    """by, n, beta, inverse and noise (variance): one row a key, of a fixed size."""
    days = day_matrices(df, by, ts, y, p)
    kinds = "".join(f"{n} {t}, " for n, t in days.select(*by).dtypes)

    def work(pdf):
        m = np.sum([np.asarray(v) for v in pdf["_m"]], axis=0).reshape(p.size + 1, p.size + 1)
        beta, inverse, noise = p.solve(m)
        out = pdf.iloc[:1][list(by)].copy()
        return out.assign(n=int(round(m[0, 0])), beta=[beta], inverse=[inverse.reshape(-1)], noise=noise)

    return days.groupBy(*by).applyInPandas(work, f"{kinds}n long, beta array<double>, inverse array<double>, noise double")


def predict(df: DataFrame, fitted: DataFrame, by: Sequence[str], ts: str, p: Forecaster = Forecaster()) -> DataFrame:
    """df with yhat, low and high, the ends of the interval for a new reading; null where the key
    has no fit. Each distinct second of the week is worked out once for a key."""
    at = df.withColumn("_second", F.pmod(seconds(ts), F.lit(WEEK)).cast("int")).withColumn("_h", _holiday(p, ts))
    cells = at.filter("_second IS NOT NULL").select(*by, "_second", "_h").distinct().withColumn("_part", F.floor(F.col("_second") / DAY).cast("int"))
    fits = fitted.select(*by, "beta", "inverse", "noise", F.explode(F.array(*map(F.lit, range(7)))).alias("_part"))
    kinds = "".join(f"{n} {t}, " for n, t in cells.select(*by).dtypes)
    z = NormalDist().inv_cdf(0.5 + p.level / 2)

    def work(pdf, model):
        if not len(model) or not len(pdf):
            return pdf.iloc[:0][[*by, "_second", "_h"]].assign(yhat=[], low=[], high=[])
        beta, inverse = np.asarray(model["beta"].iloc[0]), np.asarray(model["inverse"].iloc[0]).reshape(p.size, p.size)
        x = p.design(pdf["_second"].to_numpy(dtype=np.int64), pdf["_h"].to_numpy(dtype=np.int64))
        mean = x @ beta
        wide = z * np.sqrt(model["noise"].iloc[0] * (1 + np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x, optimize=True), 0)))
        out = [mean, mean - wide, mean + wide]
        if p.multiplicative:
            out = [np.exp(v) for v in out]
        return pdf[[*by, "_second", "_h"]].assign(yhat=out[0], low=out[1], high=out[2])

    # A fit goes once to each day of the week of its key, to meet that day's seconds.
    slots = cells.groupBy(*by, "_part").cogroup(fits.groupBy(*by, "_part")).applyInPandas(work, f"{kinds}_second int, _h int, yhat double, low double, high double")
    return meet(at, slots, [*by, "_second", "_h"]).drop("_second", "_h")


def rolling_refits(df: DataFrame, by: Sequence[str], ts: str, y: str, p: Forecaster = Forecaster(), initial_days: int = 14, step_days: int = 3, horizon_days: int = 1) -> DataFrame:
    """by, n_folds, n, mse, r2: the model is fitted anew before each origin and judged on the
    horizon after it. Origins lie step_days apart, counted back from the last horizon of the data,
    with initial_days of data span before them. r2 is one less mse over the variance of all
    readings; with no origin it is that of the fit on its own readings, and n_folds is 0.
    Multiplicative models are judged on the logarithm."""
    days = day_matrices(df, by, ts, y, p)
    kinds = "".join(f"{n} {t}, " for n, t in days.select(*by).dtypes)
    k = p.size

    def error(m: np.ndarray, beta: np.ndarray) -> float:
        return float(m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta)

    def work(pdf):
        pdf = pdf.sort_values("_day")
        day = pdf["_day"].to_numpy()
        m = np.stack([np.asarray(v).reshape(k + 1, k + 1) for v in pdf["_m"]])
        upto = np.cumsum(m, axis=0)
        total, first, end = upto[-1], day[0], day[-1] + 1
        variance = total[k, k] / total[0, 0] - (total[0, k] / total[0, 0]) ** 2
        folds, n, sse = 0, 0.0, 0.0
        origin = end - horizon_days
        while origin >= first + initial_days:
            test = (day >= origin) & (day < origin + horizon_days)
            if test.any():
                beta, _, _ = p.solve(upto[np.searchsorted(day, origin) - 1])
                part = m[test].sum(axis=0)
                folds, n, sse = folds + 1, n + part[0, 0], sse + error(part, beta)
            origin -= step_days
        if not folds:
            n, sse = total[0, 0], error(total, p.solve(total)[0])
        mse = max(sse, 0.0) / n
        return pdf.iloc[:1][list(by)].assign(n_folds=folds, n=int(round(n)), mse=mse, r2=1 - mse / variance if variance > 1e-12 else None)

    return days.groupBy(*by).applyInPandas(work, f"{kinds}n_folds int, n long, mse double, r2 double")
