"""From telemetry to decisions: windows, residuals, thresholds, evidence, opinions, gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import opinions as O
from ..functions.times import seconds
from ..operators import ageing, forecast, fusion, tails, timeseries
from ..operators.segments import meet


@dataclass(frozen=True)
class Detection:
    cell_seconds: int = 6 * 3600
    day_seconds: int = 24 * 3600
    calibration: float = 0.75
    q_susp: float = 0.90
    q_atk: float = 0.97
    q_gate: float = 0.95
    mode: str = "wbf"
    memory: ageing.Ageing | None = None  # none: each day on its own
    forecaster: forecast.Forecaster | None = None  # none: means by weekend and hour
    tails: bool = False  # thresholds from fitted tails, not from quantiles


def cells(events: DataFrame, width: int = 6 * 3600) -> DataFrame:
    """(event_type, win_start, n_obs, mean) for every type and window of the span."""
    start = F.window("ts", f"{width} seconds")["start"].alias("win_start")
    sums = events.groupBy("event_type", start).agg(F.count(F.lit(1)).alias("n_obs"), F.avg("value").alias("mean"))
    return timeseries.fill_windows(sums, ["event_type"], "win_start", width, ["n_obs"])


def leaves(cells: DataFrame) -> DataFrame:
    """Long form (leaf, grp, win_start, y); a mean without rows is null."""
    value = F.explode(F.array(F.struct(F.lit("count").alias("grp"), F.col("n_obs").cast("double").alias("y")), F.struct(F.lit("mean").alias("grp"), F.col("mean").alias("y"))))
    return cells.select("event_type", "win_start", value.alias("v")).select(F.concat_ws(":", "v.grp", "event_type").alias("leaf"), "v.grp", "win_start", "v.y")


def _split(df: DataFrame, share: float, width: int) -> DataFrame:
    """df with calib: the first share of the windows of the span."""
    w = Window.partitionBy("leaf")  # every leaf has all windows of the span
    first, last = seconds(F.min("win_start").over(w)), seconds(F.max("win_start").over(w))
    return df.withColumn("calib", (seconds("win_start") - first) / width < F.floor(((last - first) / width + 1) * share))


def residuals(leaves: DataFrame, p: Detection = Detection()) -> DataFrame:
    """leaves with calib, yhat and resid: the mean by weekend and hour over calibration windows."""
    df = _split(leaves, p.calibration, p.cell_seconds)
    if p.forecaster:
        fitted = forecast.fit(df.filter("calib"), ["leaf"], "win_start", "y", p.forecaster)
        df = forecast.predict(df, fitted, ["leaf"], "win_start", p.forecaster)
        return df.select("leaf", "grp", "win_start", "calib", "y", "yhat", (F.col("y") - F.col("yhat")).alias("resid"))
    df = df.withColumns({"weekend": F.weekday("win_start") >= 5, "hour": F.hour("win_start")})
    mean = lambda *by: F.avg(F.when(F.col("calib"), F.col("y"))).over(Window.partitionBy(*by))
    df = df.withColumn("yhat", F.coalesce(mean("leaf", "weekend", "hour"), mean("leaf")))
    return df.select("leaf", "grp", "win_start", "calib", "y", "yhat", (F.col("y") - F.col("yhat")).alias("resid"))


def evidence(resid: DataFrame, p: Detection = Detection()) -> DataFrame:
    """(leaf, grp, day, calib, n_obs, ev_p, ev_s, ev_n): trapezoid masses, summed over days."""
    seen = resid.filter("resid IS NOT NULL")
    if p.tails:
        fitted = tails.evt_thresholds(seen.filter("calib").withColumn("e", F.abs("resid")), ["leaf"], "e", 1 - p.q_susp, 1 - p.q_atk)
        df = meet(seen, fitted.select("leaf", "t_susp", "t_atk", "t_base"), ["leaf"]).filter("t_susp IS NOT NULL")
    else:
        df = tails.with_thresholds(seen, ["leaf"], "resid", F.col("calib"), p.q_susp, p.q_atk).filter("t_susp IS NOT NULL")
    return summed_evidence(df, p)


def summed_evidence(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """evidence() of residuals that have their thresholds."""
    mass = O.trapezoid(F.col("resid"), F.col("t_susp"), F.col("t_atk"), F.col("t_base"))
    df = df.select("leaf", "grp", "calib", F.window("win_start", f"{p.day_seconds} seconds")["start"].alias("day"), *[m.alias(n) for m, n in zip(mass, ("p", "s", "n"), strict=True)])
    return df.groupBy("leaf", "grp", "day").agg(F.min("calib").alias("calib"), F.count(F.lit(1)).alias("n_obs"), F.sum("p").alias("ev_p"), F.sum("s").alias("ev_s"), F.sum("n").alias("ev_n"))


def leaf_opinions(ev: DataFrame, p: Detection = Detection()) -> DataFrame:
    r = tuple(F.col(c) for c in ("ev_p", "ev_s", "ev_n"))
    if p.memory:
        ev = ageing.age(ev, "leaf", "day", params=p.memory, carry=["grp", "calib"])
        r = tuple(F.col(c) for c in ("acc_safe", "acc_susp", "acc_atk"))
    return ev.select("leaf", "grp", "day", "calib", *O.from_evidence(r).columns())


def group_opinions(leaf: DataFrame, p: Detection = Detection()) -> DataFrame:
    return fusion.fuse(leaf, ["day", "calib", "grp"], p.mode)


def system_opinions(groups: DataFrame, p: Detection = Detection()) -> DataFrame:
    """The fused opinion of each day, with proj_atk."""
    system = fusion.fuse_methods(groups, ["day", "calib"], p.mode)
    return system.withColumn("proj_atk", O.Opinion.of().projected()[2])


def decisions(groups: DataFrame, p: Detection = Detection()) -> DataFrame:
    """One row for each day: the system's opinion, proj_atk, delta and gate_open."""
    system = system_opinions(groups, p)
    every = Window.partitionBy(F.lit(1))  # a row for each day: as few as there are days
    delta = F.percentile(F.when(F.col("calib"), F.col("proj_atk")), F.lit(p.q_gate)).over(every)
    return system.withColumn("delta", delta).withColumn("gate_open", F.col("proj_atk") >= F.col("delta"))


def detect(spark: SparkSession, sf_dir: str, p: Detection = Detection()) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    ev = evidence(residuals(leaves(cells(events, p.cell_seconds)), p), p)
    return decisions(group_opinions(leaf_opinions(ev, p), p), p)


def train(events: DataFrame, p: Detection = Detection()) -> DataFrame:
    """What a run needs of each leaf: n and mean of its calibration windows, r2 of its seasonal
    means there, thresholds, and the prior of its daily evidence (store.save_models keeps them)."""
    resid = residuals(leaves(cells(events, p.cell_seconds)), p)
    seen = resid.filter("calib AND resid IS NOT NULL")
    error, spread = F.sum(F.col("resid") * F.col("resid")), F.var_pop("y") * F.count("y")
    fit = seen.groupBy("leaf", "grp").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), (1 - F.try_divide(error, F.when(spread > 1e-12, spread))).alias("r2"))
    t = tails.thresholds(seen, ["leaf"], "resid", p.q_susp, p.q_atk)
    prior = tails.empirical_prior(evidence(resid, p).filter("calib"), ["leaf"], size=p.day_seconds // p.cell_seconds)
    return fit.join(t, "leaf").join(prior, "leaf")
