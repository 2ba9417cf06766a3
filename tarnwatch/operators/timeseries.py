"""Time-series operators: window sums over a spine, filling, runs, rolling filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation
from ..functions.times import micros
from .segments import SEGMENT, exceeds, framed, known, meet, numbered, summed


def _over(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def floor_time(ts: Column, width: str) -> Column:
    """Start of the tumbling window, counted from the epoch."""
    return F.window(ts, width)["start"]


def window_spine(df: DataFrame, keys: Sequence[str], start: str, width: int) -> DataFrame:
    """Every (key, window) from the first to the last window of the data."""
    span = df.agg(F.min(start).alias("_a"), F.max(start).alias("_b")).filter("_a IS NOT NULL")  # one row
    steps = F.explode(F.sequence("_a", "_b", F.expr(f"interval {width} seconds"))).alias(start)
    return df.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, steps) if keys else span.select(steps)


def fill_windows(df: DataFrame, keys: Sequence[str], start: str, width: int, zeros: Sequence[str]) -> DataFrame:
    """df (one row for each key and window) with the missing windows of the whole span, their sums
    zero and other columns null. Each row also makes the windows between it and the next one of its
    key, the first those before it too."""
    span = df.agg(F.min(start).alias("_a"), F.max(start).alias("_b"))  # one row
    w, step = _over(keys, start), F.expr(f"interval {width} seconds")
    ends = df.join(F.broadcast(span), F.lit(True)).withColumn("_first", F.lag(start).over(w).isNull()).withColumn("_next", F.lead(start).over(w))
    times = F.sequence(F.when(F.col("_first"), F.col("_a")).otherwise(F.col(start)), F.coalesce(F.col("_next") - step, "_b"), step)
    rows = ends.select("*", F.explode(times).alias("_t"))
    own = F.col("_t") == F.col(start)
    value = lambda c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) if c in zeros else F.when(own, F.col(c))
    return rows.select(*[F.col("_t").alias(c) if c == start else F.col(c) if c in keys else value(c).alias(c) for c in df.columns])


def row_windows(df: DataFrame, by: Sequence[str], order: str, size: int, rows: int = SEGMENT) -> DataFrame:
    """df with win_no: windows of so many rows; the last may be short."""
    return numbered(df, by, order, "win_no", rows=rows).withColumn("win_no", F.floor(F.col("win_no") / size).cast("long"))


def forward_fill(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], limit: int, rows: int = SEGMENT) -> DataFrame:
    """Carries the last value on for at most limit rows."""
    if limit <= 0:
        return df
    return framed(df, by, order, limit, 0, lambda w: {c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in columns}, rows=rows)


def interpolate(df: DataFrame, by: Sequence[str], order: str, column: str, rows: int = SEGMENT) -> DataFrame:
    """Linear by position between known values; the first and last known values at the ends."""
    df = numbered(df, by, order, "_n", rows=rows)
    at = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("_n").alias("n")))
    df = known(df, by, "_n", {"_p0": at}, rows=rows)
    df = known(df, by, "_n", {"_p1": at}, ahead=True, rows=rows)
    between = F.col("_p0.v") + (F.col("_p1.v") - F.col("_p0.v")) * F.try_divide(F.col("_n") - F.col("_p0.n"), F.col("_p1.n") - F.col("_p0.n"))
    return df.withColumn(column, F.coalesce(column, between, "_p0.v", "_p1.v")).drop("_n", "_p0", "_p1")


def hampel(df: DataFrame, by: Sequence[str], order: str, column: str, window: int = 7, sigmas: float = 3.0, rows: int = SEGMENT) -> DataFrame:
    """df with vote: 1 where the value is further from the centred median than sigmas times
    MAD / 0.6745; 0 where the window is not complete."""
    half = window // 2
    df = framed(df, by, order, half, half, lambda w: {"_near": F.collect_list(column).over(w.rowsBetween(-half, half))}, rows=rows)

    def median(xs: Column) -> Column:
        return F.get(F.sort_array(xs), F.lit(half))

    df = df.withColumn("_median", median(F.col("_near"))).withColumn("_mad", median(F.transform("_near", lambda x: F.abs(x - F.col("_median")))))
    far = F.abs(F.col(column) - F.col("_median")) > sigmas * F.col("_mad") / 0.6745
    return df.withColumn("vote", F.when((F.size("_near") == window) & far, 1).otherwise(0)).drop("_near", "_median", "_mad")


def cusum(df: DataFrame, by: Sequence[str], order: str, column: str, drift: float = 0.5, limit: float = 5.0, rows: int = SEGMENT) -> DataFrame:
    """df with vote from a two-sided CUSUM of the standardised column without resets. The
    recursion max(0, s + x - drift) is its running sum less the running minimum of that."""
    df = meet(df, df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_d")), by)
    df = df.withColumn("_z", F.coalesce(F.try_divide(F.col(column) - F.col("_m"), F.col("_d")), F.lit(0.0)))
    df = summed(df, by, order, {"_up": F.col("_z") - drift, "_down": -F.col("_z") - drift}, lows=True, rows=rows)
    high = lambda c: F.col(c) - F.least(F.col(f"{c}_low"), F.lit(0.0))
    return df.withColumn("vote", ((high("_up") > limit) | (high("_down") > limit)).cast("int")).drop("_z", "_m", "_d", "_up", "_down", "_up_low", "_down_low")


def residual_vote(df: DataFrame, by: Sequence[str], order: str, column: str, period: int, sigmas: float = 3.0) -> DataFrame:
    """df with vote: residual of a classical decomposition (centred moving average, then the
    mean of each position in the period) beyond sigmas times its deviation."""
    half = period // 2
    w = _over(by, order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_trend", F.avg(column).over(w.rowsBetween(-half, half)))
    df = df.withColumn("_season", F.avg(F.col(column) - F.col("_trend")).over(Window.partitionBy(*by, F.col("_n") % period)))
    df = df.withColumn("_resid", F.col(column) - F.col("_trend") - F.col("_season"))
    deviation = F.stddev_pop("_resid").over(Window.partitionBy(*by))
    return df.withColumn("vote", F.when(F.abs("_resid") > sigmas * deviation, 1).otherwise(0)).drop("_n", "_trend", "_season", "_resid")


def consensus(votes: Sequence[str], least: int = 2) -> Column:
    return (sum((F.coalesce(F.col(v), F.lit(0)) for v in votes), F.lit(0)) >= least).cast("int")


def episodes(df: DataFrame, by: Sequence[str], ts: str, gap_seconds: float, rows: int = SEGMENT) -> DataFrame:
    """df with episode: a gap of more than gap_seconds begins a new one; an equal gap doesn't."""
    if not exceeds(df, by, rows):
        w = _over(by, ts)
        df = df.withColumn("_new", (micros(ts) - micros(F.lag(ts).over(w)) > gap_seconds * 1e6).cast("long"))
        return df.withColumn("episode", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    df = framed(df, by, ts, 1, 0, lambda w: {"_new": (micros(ts) - micros(F.lag(ts).over(w)) > gap_seconds * 1e6).cast("long")}, rows=rows)
    return summed(df, by, ts, {"episode": F.coalesce("_new", F.lit(0))}, rows=rows).drop("_new")


def runs(df: DataFrame, by: Sequence[str], order: str, flag: str, gap: int = 0, rows: int = SEGMENT) -> DataFrame:
    """by, run_start, run_end (values of order) and n of the runs of flag = 1, tolerating so
    many zeros in between."""
    marked = numbered(df, by, order, "_n", rows=rows).filter(F.col(flag) == 1)
    marked = framed(marked, by, "_n", 1, 0, lambda w: {"_new": F.coalesce(F.col("_n") - F.lag("_n").over(w) > gap + 1, F.lit(True)).cast("long")}, rows=rows)
    marked = summed(marked, by, "_n", {"_run": F.col("_new")}, rows=rows)
    return marked.groupBy(*by, "_run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_run")


def dilate(df: DataFrame, by: Sequence[str], order: str, flag: str, reach: int, rows: int = SEGMENT) -> DataFrame:
    """df with dilated: the largest flag within reach rows on either side."""
    return framed(df, by, order, reach, reach, lambda w: {"dilated": F.max(flag).over(w.rowsBetween(-reach, reach))}, rows=rows)


def flip_rate(df: DataFrame, by: Sequence[str], order: str, label: str, rows: int = SEGMENT) -> DataFrame:
    """Share of changes between consecutive non-null labels."""
    known_ = framed(df.filter(F.col(label).isNotNull()), by, order, 1, 0, lambda w: {"_before": F.lag(label).over(w)}, rows=rows)
    return known_.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("_before").isNotNull(), (F.col(label) != F.col("_before")).cast("double"))), F.lit(0.0)).alias("flip_rate"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def effective_n(df: DataFrame, by: Sequence[str], order: str, column: str, lags: int = 10, rows: int = SEGMENT) -> DataFrame:
    """by, n and n_eff: n over one plus twice the Bartlett-weighted autocorrelations, in [1, n]."""
    df = meet(df, df.groupBy(*by).agg(F.avg(column).alias("_m")), by).withColumn("_c", F.col(column) - F.col("_m"))
    df = framed(df, by, order, lags, 0, lambda w: {f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)}, rows=rows)
    n, var = F.count(column), F.var_samp(column)
    weighted = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = F.try_divide(F.try_divide(F.sum(F.col("_c") * F.col(f"_l{k}")), n - k), var)
        weighted = weighted + (1 - k / (lags + 1)) * F.coalesce(rho, F.lit(0.0))
    return df.groupBy(*by).agg(n.alias("n"), F.least(F.greatest(F.try_divide(n, F.greatest(1 + 2 * weighted, F.lit(1e-9))), F.lit(1.0)), n.cast("double")).alias("n_eff"))


def unit_root(df: DataFrame, by: Sequence[str], order: str, column: str, rows: int = SEGMENT) -> DataFrame:
    """by, n, rho1 and df_stat: the lag-1 autocorrelation and the Dickey-Fuller statistic with a
    constant and no further lags (the t value of the last value's slope on the change). Null
    with fewer than three changes or a constant series."""
    pairs = framed(df.filter(F.col(column).isNotNull()), by, order, 1, 0, lambda w: {"_x": F.lag(column).over(w)}, rows=rows)
    pairs = pairs.filter("_x IS NOT NULL").withColumn("_d", F.col(column) - F.col("_x"))
    n, sxx = F.count(F.lit(1)), F.regr_sxx("_d", "_x")
    sums = pairs.groupBy(*by).agg(n.alias("n"), correlation(column, "_x").alias("rho1"), F.regr_slope("_d", "_x").alias("_b"), sxx.alias("_sxx"), F.regr_syy("_d", "_x").alias("_syy"), F.regr_sxy("_d", "_x").alias("_sxy"))
    rest = F.try_divide(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.when(F.col("n") > 2, F.col("n") - 2))
    error = F.sqrt(F.try_divide(rest, F.col("_sxx")))
    return sums.select(*by, "n", "rho1", F.try_divide(F.col("_b"), error).alias("df_stat"))


def mase(df: DataFrame, by: Sequence[str], order: str, y: str, yhat: str, rows: int = SEGMENT) -> DataFrame:
    """by and mase: mean absolute error over that of the last value carried on."""
    df = framed(df, by, order, 1, 0, lambda w: {"_d": F.abs(F.col(y) - F.lag(y).over(w))}, rows=rows)
    d = F.avg("_d")
    return df.groupBy(*by).agg(F.when((F.count("_d") >= 1) & (d >= 1e-12), F.try_divide(F.avg(F.abs(F.col(y) - F.col(yhat))), d)).alias("mase"))


def mase_trust(mase: Column, alpha: float = 1.0, floor: float = 0.05) -> Column:
    return F.coalesce(F.greatest(F.lit(floor), F.least(F.lit(1.0), 1 - alpha * mase)), F.lit(floor))
