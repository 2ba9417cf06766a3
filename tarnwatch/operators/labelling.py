"""Labels without truth: the consensus of three detectors, and what it says of a training span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decompose import stl_vote
from .joins import interval_label
from .timeseries import consensus, cusum, hampel, interpolate


def consensus_labels(df: DataFrame, by: Sequence[str], order: str, column: str, period: int, least: int = 2, **options) -> DataFrame:
    """df with stl, hampel, cusum (votes) and label: 1 where least of them vote. Nulls of the column are
    filled by position first; a series too short for a decomposition has no stl vote."""
    df = interpolate(df, by, order, column)
    df = stl_vote(df, by, order, column, period, **options).drop("season", "trend", "rest").withColumnRenamed("vote", "stl")
    df = hampel(df, by, order, column).withColumnRenamed("vote", "hampel")
    df = cusum(df, by, order, column).withColumnRenamed("vote", "cusum")
    return df.withColumn("label", consensus(["stl", "hampel", "cusum"], least))


def train_span_audit(df: DataFrame, ts: str, metric: str, value: str, train: Column, excluded: DataFrame, period: int, top: int = 50, **options) -> DataFrame:
    """(ts, n_flags, severity): the times of the training span at which most metrics carry a consensus
    label (high from three on, medium, low), outside the ranges that are excluded already (start, end;
    closed). At most top of them, by flags and then time."""
    rows = consensus_labels(df.filter(train).select(ts, metric, value), [metric], ts, value, period, **options)
    flags = rows.groupBy(ts).agg(F.sum("label").alias("n_flags")).filter("n_flags > 0")
    new = interval_label(flags, ts, excluded, "_known", closed=True).filter("_known = 0").drop("_known")
    out = new.orderBy(F.desc("n_flags"), ts).limit(top)
    return out.withColumn("severity", F.when(F.col("n_flags") >= 3, "high").when(F.col("n_flags") == 2, "medium").otherwise("low"))
