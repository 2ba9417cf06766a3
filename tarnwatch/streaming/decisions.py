"""The detection path on a stream: whole days close by watermark, then take the batch operators.

Learning is a batch job (`learn`); what it found is kept as tables in a folder. The stream sums
events by type and cell of a day in watermarked state (`closed_cells`); all cells of a day close
at once. Each micro-batch of closed days (a row for each type and cell) goes through the same
residuals, evidence, ageing, fusion and gate as `plans.detection` (`decide`), so a replay of
the events gives what `detect` gives.

What a batch leaves behind, its decisions and the memory of each leaf, is a folder named by the batch.
A batch that is repeated after a failure starts from the folders of those before it and replaces
its own, so each day is decided once.

Defined cases: types that learning didn't know are left out; a cell without events counts zero and
has no mean, also on days without any event, once a later day closes; cells before the first
event are not filled; rows later than the watermark are dropped; an empty batch leaves nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace as changed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import seconds
from ..operators import ageing, forecast, tails
from ..operators.segments import meet
from ..plans import detection as D
from ..sources.store import exists, replace

MEMORY = ("acc_safe", "acc_susp", "acc_atk")


def learn(events: DataFrame, folder: str, p: D.Detection = D.Detection()) -> None:
    """Keeps in the folder what decisions need, all of it found on the calibration windows: means by
    leaf (`leaves`) and by leaf, weekend and hour (`seasons`) or the fitted forecaster, thresholds
    by leaf, and the threshold of the gate."""
    spark = events.sparkSession
    split = D._split(D.leaves(D.cells(events, p.cell_seconds)), p.calibration, p.cell_seconds)
    known = split.filter("calib")
    season = known.groupBy("leaf", (F.weekday("win_start") >= 5).alias("weekend"), F.hour("win_start").alias("hour")).agg(F.avg("y").alias("yhat"))
    kept = {"leaves": known.groupBy("leaf", "grp").agg(F.avg("y").alias("mean"))}
    kept["seasons"] = forecast.fit(known, ["leaf"], "win_start", "y", p.forecaster) if p.forecaster else season
    resid = D.residuals(D.leaves(D.cells(events, p.cell_seconds)), p)
    seen = resid.filter("calib AND resid IS NOT NULL")
    if p.tails:
        fitted = tails.evt_thresholds(seen.withColumn("e", F.abs("resid")), ["leaf"], "e", 1 - p.q_susp, 1 - p.q_atk)
        kept["thresholds"] = fitted.select("leaf", "t_susp", "t_atk", "t_base")
    else:
        kept["thresholds"] = tails.thresholds(seen, ["leaf"], "resid", p.q_susp, p.q_atk)
    kept["types"] = events.select("event_type").distinct()
    kept["gate"] = D.decisions(D.group_opinions(D.leaf_opinions(D.evidence(resid, p), p), p), p).select("delta").limit(1)
    for name, df in kept.items():
        replace(spark, f"{folder}/{name}", df.write.parquet)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream of its files, be it a folder of its own or one file."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def closed_cells(events: DataFrame, p: D.Detection = D.Detection(), late: str = "1 day") -> DataFrame:
    """(event_type, day, win_start, n_obs, mean) of a stream of events (ts, event_type, value), as
    days close."""
    width = p.cell_seconds
    start = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (width * 1_000_000)) * width).alias("win_start")
    sums = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", f"{p.day_seconds} seconds"), start).agg(F.count(F.lit(1)).alias("n_obs"), F.avg("value").alias("mean"))
    return sums.select("event_type", F.col("window.start").alias("day"), "win_start", "n_obs", "mean")


def _filled(cells: DataFrame, types: DataFrame, last: object, p: D.Detection) -> DataFrame:
    """cells of known types, with every cell from the day after last, or from the first cell seen, on:
    a row for each type and cell of the days that close."""
    day, width = p.day_seconds, p.cell_seconds
    first = F.min(seconds("win_start")) if last is None else F.lit(None).cast("double")
    span = cells.agg(first.alias("first"), F.max(seconds("day")).alias("end"))  # one row
    begin = F.col("first") if last is None else F.lit(float(last) + day)
    spine = span.select(F.explode(F.sequence(begin.cast("long"), F.col("end").cast("long") + day - width, F.lit(width))).alias("_s"))
    spine = types.join(F.broadcast(spine), F.lit(True)).select("event_type", F.timestamp_seconds("_s").alias("win_start"))
    return spine.join(cells.drop("day"), ["event_type", "win_start"], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))


def decide(cells: DataFrame, learned: str, memory: DataFrame | None, last: object, p: D.Detection = D.Detection()) -> tuple[DataFrame, DataFrame]:
    """(decisions, memory) of closed cells: day, opinion, proj_atk, delta, gate_open; and what each
    leaf remembers after them (leaf, acc_*). memory is that of the days before, last the day (in
    seconds) up to which they went."""
    spark = cells.sparkSession
    table = lambda name: spark.read.parquet(f"{learned}/{name}")
    rows = D.leaves(_filled(cells, table("types"), last, p))
    if p.forecaster:
        rows = forecast.predict(rows, table("seasons"), ["leaf"], "win_start", p.forecaster)
    else:
        rows = rows.withColumns({"weekend": F.weekday("win_start") >= 5, "hour": F.hour("win_start")}).join(table("seasons"), ["leaf", "weekend", "hour"], "left")
        rows = rows.join(table("leaves").select("leaf", "mean"), "leaf").withColumn("yhat", F.coalesce("yhat", "mean"))
    rows = rows.withColumns({"resid": F.col("y") - F.col("yhat"), "calib": F.lit(False)}).filter("resid IS NOT NULL")
    rows = meet(rows, table("thresholds"), ["leaf"]).filter("t_susp IS NOT NULL")
    evidence = D.summed_evidence(rows, p)
    if p.memory:
        evidence, memory = _aged(evidence, table("leaves").select("leaf", "grp"), memory, p)
        opinions = D.leaf_opinions(evidence, changed(p, memory=None))
    else:
        memory = table("leaves").select("leaf", *[F.lit(0.0).alias(m) for m in MEMORY])
        opinions = D.leaf_opinions(evidence, p)
    gate = F.broadcast(table("gate"))  # one row
    system = D.system_opinions(D.group_opinions(opinions, p), p).join(gate, F.lit(True))
    return system.withColumn("gate_open", F.col("proj_atk") >= F.col("delta")).drop("calib"), memory


def _aged(evidence: DataFrame, leaves: DataFrame, memory: DataFrame | None, p: D.Detection) -> tuple[DataFrame, DataFrame]:
    """evidence with what is remembered added in, and the memory after it. A leaf's memory goes before
    its rows as one more: from nothing, a step to it gives just it."""
    start = [a * p.memory.w if p.memory.start_at_prior else 0.0 for a in p.memory.prior]
    before = leaves.select("leaf", "grp", *[F.lit(s).alias(m) for s, m in zip(start, MEMORY, strict=True)])
    if memory is not None:
        before = leaves.join(memory.select("leaf", *MEMORY), "leaf", "left").select("leaf", "grp", *[F.coalesce(m, F.lit(s)).alias(m) for s, m in zip(start, MEMORY, strict=True)])
    days = evidence.agg(F.min("day").alias("_d"))  # one row
    names = ("ev_p", "ev_s", "ev_n")
    first = before.join(F.broadcast(days), F.lit(True)).filter("_d IS NOT NULL")
    first = first.select("leaf", "grp", (F.col("_d") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {p.day_seconds})")).alias("day"), F.lit(True).alias("_old"), *[F.col(m).alias(e) for m, e in zip(MEMORY, names, strict=True)])
    both = first.unionByName(evidence.select("leaf", "grp", "day", F.lit(False).alias("_old"), *names))
    out = ageing.age(both, "leaf", "day", params=changed(p.memory, start_at_prior=False), carry=["grp", "_old"])
    after = out.groupBy("leaf").agg(*[F.max_by(m, "day").alias(m) for m in MEMORY])
    now = out.filter(~F.col("_old")).select("leaf", "grp", "day", F.lit(False).alias("calib"), *[F.col(m).alias(e) for m, e in zip(MEMORY, names, strict=True)])
    return now, after


def batch_writer(learned: str, out: str, p: D.Detection = D.Detection()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decides the closed cells of a batch into out/decisions/batch=<n> and keeps
    memory and last day in out/memory/batch=<n>."""

    def write(cells: DataFrame, batch: int) -> None:
        spark = cells.sparkSession
        cells = cells.persist()
        try:
            end = cells.agg(F.max(seconds("day")).alias("d")).first().d
            if end is None:
                return
            memory, last = None, None
            if exists(spark, f"{out}/memory"):
                kept = spark.read.parquet(f"{out}/memory").filter(F.col("batch") < batch)
                newest = kept.agg(F.max("batch").alias("b")).first().b
                if newest is not None:
                    memory = kept.filter(F.col("batch") == newest)
                    last = memory.agg(F.max("last").alias("d")).first().d
            decided, after = decide(cells, learned, memory, last, p)
            after.withColumn("last", F.lit(float(end))).write.mode("overwrite").parquet(f"{out}/memory/batch={batch}")
            decided.write.mode("overwrite").parquet(f"{out}/decisions/batch={batch}")
        finally:
            cells.unpersist()

    return write


def start(events: DataFrame, learned: str, out: str, checkpoint: str, p: D.Detection = D.Detection(), late: str = "1 day", **trigger) -> StreamingQuery:
    """Decides a stream of events; trigger as in DataStreamWriter.trigger."""
    query = closed_cells(events, p, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return query.foreachBatch(batch_writer(learned, out, p)).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_decisions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/decisions").drop("batch")
