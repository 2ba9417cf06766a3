"""What a run keeps: parameter tables, decision thresholds with the settings they hold for, wide
opinions, run identities and a log of runs. All of it are tables below one folder.

A table is written under a new name; then the one in its place steps aside and the new one takes its
name, by two renames. So no reader finds half a table. A write that ends before the renames
changes nothing; one that ends between them leaves the old table aside, and the next read or
write puts it back."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import opinions as O

#: Settings that a decision threshold depends on: fixed values.
THRESHOLD_SETTINGS = ("mode", "weights", "rate", "balance", "discount", "calendar")


def seconds_of(frequency: str, default: int = 300) -> int:
    """30s, 10min, 1h or 2d in seconds; the default for anything else."""
    units = {"s": 1, "sec": 1, "t": 60, "min": 60, "h": 3600, "d": 86400}
    text = frequency.strip().lower()
    number = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit = text[len(number) :]
    return int(number or 1) * units[unit] if unit in units and (number == "" or number.isdigit()) else default


def _place(spark: SparkSession, path: str):
    """The file system of a path, and how it names one."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a table? One that stepped aside for a write that never ended is put back."""
    files, make = _place(spark, path)
    if not files.exists(make(path)) and files.exists(make(f"{path}.aside")):
        files.rename(make(f"{path}.aside"), make(path))
    return files.exists(make(path))


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write makes a table at a new path, which then takes the place of the one at path."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    files, make = _place(spark, path)
    try:
        write(new)
        if exists(spark, path):
            files.delete(make(f"{path}.aside"), True)
            files.rename(make(path), make(f"{path}.aside"))
        if not files.rename(make(new), make(path)):
            raise OSError(f"{new} could not be renamed")
    except BaseException:
        exists(spark, path)
        files.delete(make(new), True)
        raise
    files.delete(make(f"{path}.aside"), True)


def save_models(models: DataFrame, folder: str, split: str) -> None:
    """Parameter tables carry the end of their training span in every row."""
    replace(models.sparkSession, f"{folder}/models", models.withColumn("split", F.lit(split)).write.parquet)


def load_models(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The parameters; with split, an error if they were trained to another date."""
    exists(spark, f"{folder}/models")
    df = spark.read.parquet(f"{folder}/models")
    if split is not None:
        found = [r["split"] for r in df.select("split").distinct().limit(2).collect()]
        if found != [split]:
            raise ValueError(f"models end at {found}, not at {split}")
    return df.drop("split")


def patch_models(models: DataFrame, values: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """models with columns of values (one row a key) put in, the old ones where a key lacks."""
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    old = lambda c: F.col(c) if c in models.columns else F.lit(None)
    joined = models.join(new, key, "left")
    return joined.select(*[c for c in models.columns if c not in columns], *[F.coalesce(F.col(f"_new_{c}"), old(c)).alias(c) for c in columns])


def save_threshold(spark: SparkSession, folder: str, delta: float, settings: Mapping[str, object]) -> None:
    """One row for each fusion mode, with its settings; another mode's row stays."""
    row = spark.createDataFrame([(str(settings["mode"]), float(delta), json.dumps(dict(settings), sort_keys=True))], "mode string, delta double, settings string")
    files, make = _place(spark, folder)
    files.mkdirs(make(f"{folder}/thresholds"))
    replace(spark, f"{folder}/thresholds/mode={settings['mode']}", row.write.parquet)


def read_threshold(spark: SparkSession, folder: str, settings: Mapping[str, object], fallback: float | None = None, strict: bool = True) -> float:
    """The decision threshold of the mode, else the fallback. Settings that differ from those it
    was calibrated with are an error, or, not strict, a reason for the fallback."""
    path = f"{folder}/thresholds/mode={settings['mode']}"
    rows = spark.read.schema("delta double, settings string").parquet(path).limit(2).collect() if exists(spark, path) else []
    drift = differing(json.loads(rows[0]["settings"]), settings) if rows else []
    if drift and strict:
        raise ValueError(f"the threshold was calibrated with other settings: {drift}")
    if rows and not drift:
        return rows[0]["delta"]
    if fallback is None:
        raise ValueError(f"no threshold for {settings['mode']}")
    return fallback


def differing(a: Mapping[str, object], b: Mapping[str, object], names: Sequence[str] = THRESHOLD_SETTINGS, tolerance: float = 1e-9) -> list[str]:
    """The names under which two settings differ; numbers may by the tolerance."""

    def same(x: object, y: object) -> bool:
        if isinstance(x, Mapping) and isinstance(y, Mapping):
            return x.keys() == y.keys() and all(same(x[k], y[k]) for k in x)
        if isinstance(x, (list, tuple)) and isinstance(y, (list, tuple)):
            return len(x) == len(y) and all(map(same, x, y))
        if isinstance(x, (int, float)) and isinstance(y, (int, float)):
            return math.isclose(x, y, rel_tol=0, abs_tol=tolerance)
        return x == y

    return [n for n in names if not same(a.get(n), b.get(n))]


def wide_opinions(opinions: DataFrame, win: str, leaf: str, leaves: Sequence[str]) -> DataFrame:
    """One row for each window: fields and attack probability of each stated leaf as columns."""
    op = O.Opinion.of()
    fields = [*O.FIELDS[:4], "proj_atk"]
    rows = opinions.select(win, leaf, *O.FIELDS[:4], op.projected()[2].alias("proj_atk"))
    return rows.groupBy(win).pivot(leaf, list(leaves)).agg(*[F.first(f, True).alias(f) for f in fields])


def save_opinions(wide: DataFrame, folder: str, kind: str = "parquet") -> None:
    """As Parquet, or as CSV files with a header."""
    replace(wide.sparkSession, f"{folder}/opinions", wide.write.option("header", True).csv if kind == "csv" else wide.write.parquet)


def run_id(settings: Mapping[str, object], version: str, inputs: Mapping[str, str] | None = None) -> str:
    """16 hexadecimal digits of SHA-256 over settings, code version and the digests of inputs."""
    text = json.dumps({"settings": dict(settings), "version": version, "inputs": dict(inputs or {})}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_digest(df: DataFrame) -> str:
    """The same for the same rows in any order; one aggregate."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()


def log_run(spark: SparkSession, folder: str, run: str, metrics: Mapping[str, float]) -> None:
    """Appends a run's metrics (run, metric, value)."""
    spark.createDataFrame([(run, k, float(v)) for k, v in sorted(metrics.items())], "run string, metric string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def read_runs(spark: SparkSession, folder: str, runs: Sequence[str] | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(run, metric, value), aliases resolved; of a metric logged again the largest value counts.
    Runs that were never logged give no rows."""
    kind = "run string, metric string, value double"
    df = spark.read.schema(kind).parquet(f"{folder}/runs") if exists(spark, f"{folder}/runs") else spark.createDataFrame([], kind)
    if runs is not None:
        df = df.filter(F.col("run").isin(list(runs)))
    name: Column = F.col("metric")
    if aliases:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[name], name)
    return df.groupBy("run", name.alias("metric")).agg(F.max("value").alias("value"))


def add_events(catalog: DataFrame, more: DataFrame) -> DataFrame:
    """catalog and the rows of more whose names it lacks."""
    return catalog.unionByName(more.join(catalog.select("name"), "name", "left_anti").select(*catalog.columns))


def faulty_events(events: DataFrame, split: str) -> DataFrame:
    """(name, fault): events without a name or span, of a name that repeats, not after the split,
    ending before they begin, or with negative or no signature (sig_p, sig_s, sig_n). A valid
    catalog gives no row."""
    repeated = events.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    df = events.join(repeated, "name", "left")
    sig = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("sig_p", "sig_s", "sig_n")]
    negative = (sig[0] < 0) | (sig[1] < 0) | (sig[2] < 0)
    fault = (
        F.when(F.col("name").isNull() | F.col("start").isNull() | F.col("end").isNull(), "missing").when(F.col("_n") > 1, "name repeats")
        .when(F.col("start") <= F.lit(split).cast("timestamp"), "not after the split").when(F.col("end") <= F.col("start"), "ends before it begins")
        .when(negative, "negative signature").when(sig[0] + sig[1] + sig[2] <= 0, "no signature")
    )
    return df.select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def schedule(events: DataFrame) -> DataFrame:
    """(line): one line of text for each event, by start and name. Hours are rounded by the exact value
    of the double, as C's printf does (format_string rounds its shortest decimal, half up); an event
    without a name or span has no line's text."""
    span = F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    text = F.concat(time("start"), F.lit("  "), time("end"), F.lit("  "), F.call_function("format_number", span / 3600, F.lit("0.00")), F.lit(" h  "), F.col("name"))
    return events.orderBy("start", "name").select(text.alias("line"))
