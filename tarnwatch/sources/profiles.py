"""Dataset profiles: raw files to a standard telemetry table (timestamp, metrics, label).

Every profile is a function of DataFrames; missing metrics stay null and are never zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import correlation
from ..functions.times import micros
from ..operators.metrics import running

NOT_METRICS = ("timestamp", "ts", "ds", "label", "on_weekend")
NOT_METRIC_PREFIXES = ("flag_", "mask_", "gt_")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, skip_bad_files: bool = False) -> DataFrame:
    """Header CSV files, searched for in folders below path; all columns text without a schema."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("ignoreCorruptFiles", skip_bad_files)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def read_many(spark: SparkSession, paths: Sequence[str], single: bool = False) -> DataFrame:
    """CSV files by name, one after the other; single: exactly one is allowed."""
    if single and len(paths) != 1:
        raise ValueError(f"one file is expected, {len(paths)} given")
    out = None
    for p in sorted(paths):
        df = spark.read.option("header", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def number(c: str) -> Column:
    """Text or number as double; what isn't one is null."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def flag(c: str) -> Column:
    x = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(x.isin("true", "1", "1.0"), 1).otherwise(0)


def metric_columns(df: DataFrame, only: Sequence[str] | None = None, strict: bool = False) -> list[str]:
    """Numeric columns that aren't keys, labels or flags."""
    numeric = [c for c, t in df.dtypes if t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    found = [c for c in numeric if c not in NOT_METRICS and not c.startswith(NOT_METRIC_PREFIXES)]
    if only is not None:
        if strict and (missing := [c for c in only if c not in found]):
            raise ValueError(f"no such metrics: {missing}")
        found = [c for c in only if c in found]
    return found


def network(df: DataFrame) -> DataFrame:
    """timestamp, all other columns as doubles, label 0 where it lacks."""
    metrics = [c for c in df.columns if c not in ("timestamp", "label")]
    label = F.coalesce(number("label").cast("int"), F.lit(0)) if "label" in df.columns else F.lit(0)
    return df.select(F.col("timestamp").try_cast("timestamp").alias("timestamp"), *[number(c).alias(c) for c in metrics], label.alias("label"))


def water(df: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Time and EVENT become timestamp and label."""
    keep = list(metrics) if metrics is not None else [c for c in df.columns if c not in ("Time", "EVENT")]
    return df.select(F.col("Time").try_cast("timestamp").alias("timestamp"), *[number(c).alias(c) for c in keep if c in df.columns], flag("EVENT").alias("label"))


def flows(df: DataFrame, slot: str, anchor: str, sums: Sequence[str], averages: dict[str, str], ratios: dict[str, tuple[str, str]], minutes: int = 10) -> DataFrame:
    """Sites added up for each slot: sums, weighted averages (column -> weight) and ratios of
    sums; the time is the anchor plus slot * minutes."""
    ts = F.timestamp_add("MINUTE", F.col(slot).cast("int") * minutes, F.lit(anchor).cast("timestamp"))
    weight = lambda w: F.abs(number(w)) + 1e-9
    # A row counts in an average only where it has a value.
    mean = lambda c, w: F.try_divide(F.sum(number(c) * weight(w)), F.sum(F.when(number(c).isNotNull(), weight(w))))
    label = [F.max(F.coalesce(number("label").cast("int"), F.lit(0))).alias("label")] if "label" in df.columns else [F.lit(0).alias("label")]
    out = df.groupBy(ts.alias("timestamp")).agg(*[F.sum(number(c)).alias(c) for c in sums], *[mean(c, w).alias(c) for c, w in averages.items()], *label)
    return out.withColumns({n: F.col(a) / (F.col(b) + 1e-9) for n, (a, b) in ratios.items()})


def traffic(df: DataFrame, slow: float = 35.0) -> DataFrame:
    """Long sensor readings (timestamp, sensor_id, speed[, label]) to one row for each time."""
    from ..operators.calibration import quantiles
    from ..operators.segments import meet

    label = F.max(F.coalesce(F.col("label").cast("int"), F.lit(0))) if "label" in df.columns else F.lit(0)
    out = df.groupBy("timestamp").agg(
        F.avg("speed").alias("speed_mean"), F.coalesce(F.stddev_samp("speed"), F.lit(0.0)).alias("speed_std"),
        F.avg((F.col("speed") < slow).cast("double")).alias("slow_share"), label.alias("label"),
    )
    tenth = quantiles(df, ["timestamp"], "speed", [0.1]).select("timestamp", F.col("q0").alias("speed_p10"))
    return meet(out, tenth, ["timestamp"]).select("timestamp", "speed_mean", "speed_std", "slow_share", "speed_p10", "label")


def volatile_sensors(df: DataFrame, split: str, top: int = 5) -> DataFrame:
    """(sensor_id, variance) of the most variable sensors before the split."""
    train = df.filter(F.col("timestamp") < F.lit(split).cast("timestamp"))
    return train.groupBy("sensor_id").agg(F.var_samp("speed").alias("variance")).orderBy(F.col("variance").desc_nulls_last(), "sensor_id").limit(top)


def with_sensors(df: DataFrame, split: str, top: int = 5) -> DataFrame:
    """traffic() and one column of speeds for each of the most variable sensors."""
    names = [r[0] for r in volatile_sensors(df, split, top).collect()]  # top names
    wide = df.filter(F.col("sensor_id").isin(names)).groupBy("timestamp").pivot("sensor_id", names).agg(F.avg("speed"))
    return traffic(df).join(wide.withColumnsRenamed({n: f"speed_{n}" for n in names}), "timestamp", "left")


def to_long(df: DataFrame, metrics: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.unpivot([ts], list(metrics), "metric", "value")


def to_wide(df: DataFrame, key: str, name: str, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row for each key, columns <name>_<value>; the names are stated, so one pass does it."""
    return df.groupBy(key).pivot(name, list(names)).agg(*[F.first(v, True).alias(v) for v in values])


def mask(df: DataFrame, metrics: Sequence[str], closed: Sequence[tuple[str, str]], ts: str = "timestamp") -> DataFrame:
    """Metrics null inside stated maintenance times, both ends included."""
    inside = F.lit(False)
    for a, b in closed:
        inside = inside | F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))
    return df.withColumns({m: F.when(~inside, F.col(m)) for m in metrics})


def split_train(df: DataFrame, split: str, ts: str = "timestamp", calibration: float = 0.25, least: int = 10) -> DataFrame:
    """df with part: model, calibration (the last share of the rows up to the split) or test.
    Rows of one time stay together: all of the time that the cut falls on are model. The cut comes
    from counts by time, so no task orders the training span."""
    train = F.col(ts) <= F.lit(split).cast("timestamp")
    counts = df.filter(train).groupBy(micros(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    m = counts.agg(F.sum("_n").alias("_m"))  # one row
    model = F.greatest(F.lit(least), F.floor(F.col("_m") * (1 - calibration)))
    cut = running(counts, "_t", ["_n"]).join(F.broadcast(m), F.lit(True)).filter(F.col("run__n") - F.col("_n") < model).agg(F.max("_t").alias("_cut"))
    out = df.join(F.broadcast(cut), F.lit(True))
    return out.withColumn("part", F.when(~train, "test").when(micros(ts) <= F.col("_cut"), "model").otherwise("calibration")).drop("_cut")


def select_metrics(df: DataFrame, metrics: Sequence[str], most: int = 10, limit: float = 0.85) -> list[str]:
    """Not constant, not correlated beyond the limit with an earlier one, largest variances.
    Two passes: variances, then the correlations of what varies."""
    spread = df.agg(*[F.var_pop(m).alias(m) for m in metrics]).first()
    live = [m for m in metrics if (spread[m] or 0.0) > 0]
    pairs = [(a, b) for i, a in enumerate(live) for b in live[i + 1 :]]
    rho = df.agg(F.count(F.lit(1)), *[correlation(a, b) for a, b in pairs]).first()
    close = {b for i, (_, b) in enumerate(pairs, 1) if abs(rho[i] or 0.0) > limit}
    return sorted((m for m in live if m not in close), key=lambda m: (-spread[m], m))[:most]


PROFILES: dict[str, Callable[..., DataFrame]] = {"network": network, "water": water, "flows": flows, "traffic": traffic}


def profile(name: str) -> Callable[..., DataFrame]:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}; known: {sorted(PROFILES)}")
    return PROFILES[name]
