"""The streamed detection path against the batch one, on the same events."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators.ageing import Ageing
from tarnwatch.plans import detection as D
from tarnwatch.streaming import decisions as S

SF = "/root/testdata/sf0.001"
SCHEMA = "ts timestamp, event_type string, value double"


def events_of(spark, days=40):
    """Two types at uneven times, none of one type on some days, and none at all on day 20."""
    rows, begin = [], dt.datetime(2024, 1, 3, 7)
    for d in range(days):
        for k in range(9):
            at = begin + dt.timedelta(days=d, minutes=137 * k + 11 * (d % 5))
            if d == 20 or (begin + dt.timedelta(days=20)).date() == at.date():
                continue
            rows.append((at, "a", float((d * 7 + k * 3) % 11) + (40.0 if d in (33, 34) else 0.0)))
            if d % 6 and k % 2:
                rows.append((at, "b", float((d * 5 + k) % 4)))
    return spark.createDataFrame(rows, SCHEMA)


def in_files(spark, events, folder, parts):
    """The events in order of time, a file for each part of the span, read one at a time."""
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (ends.b - ends.a) / parts
    for i in range(parts):
        low, high = ends.a + step * i, ends.a + step * (i + 1)
        part = events.filter((F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(i == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def close(got, want, days):
    mine = {r.day: r for r in got.collect()}
    assert len(mine) == got.count() >= days
    theirs = {r.day: r for r in want.collect()}
    for day, r in mine.items():
        w = theirs[day]
        for c in ("b_safe", "b_susp", "b_atk", "u", "proj_atk", "delta"):
            assert r[c] == pytest.approx(w[c], abs=1e-9), (day, c)
        assert r.gate_open == w.gate_open or abs(w.proj_atk - w.delta) < 1e-9
    assert set(theirs) - set(mine) <= set(sorted(theirs)[-3:])  # the last days are still open


def batch(events, p):
    ev = D.evidence(D.residuals(D.leaves(D.cells(events, p.cell_seconds)), p), p)
    return D.decisions(D.group_opinions(D.leaf_opinions(ev, p), p), p)


@pytest.mark.parametrize("memory", [None, Ageing(window=4), Ageing(conflict="none", start_at_prior=True)])
def test_a_replay_gives_what_the_batch_gives(spark, tmp_path, memory):
    p = D.Detection(memory=memory)
    events = events_of(spark)
    S.learn(events, str(tmp_path / "learned"), p)
    stream = in_files(spark, events, str(tmp_path / "in"), 4)
    S.start(stream, str(tmp_path / "learned"), str(tmp_path / "out"), str(tmp_path / "cp"), p, late="2 hours", availableNow=True).awaitTermination()
    close(S.read_decisions(spark, str(tmp_path / "out")), batch(events, p), 35)


def test_a_repeated_batch_replaces_its_own(spark, tmp_path):
    p = D.Detection(memory=Ageing(window=4))
    events = events_of(spark)
    S.learn(events, str(tmp_path / "learned"), p)
    cells = D.cells(events, p.cell_seconds).filter("n_obs > 0").withColumn("day", F.window("win_start", "1 day")["start"]).select("event_type", "day", "win_start", "n_obs", "mean").cache()
    write = S.batch_writer(str(tmp_path / "learned"), str(tmp_path / "out"), p)
    cells = cells.filter(F.col("day") < F.lit(dt.datetime(2024, 2, 12)))  # the last day isn't over
    early = F.col("day") < F.lit(dt.datetime(2024, 1, 20))
    write(cells.filter(early), 0)
    write(cells.filter("false"), 1)
    for _ in range(2):
        write(cells.filter(~early), 2)
    close(S.read_decisions(spark, str(tmp_path / "out")), batch(events, p), 39)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_replay_of_the_events_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    S.learn(events, str(tmp_path / "learned"))
    in_files(spark, events, str(tmp_path / "in" / "events.parquet"), 2)
    stream = S.table_stream(spark, str(tmp_path / "in"), "events.parquet")
    S.start(stream, str(tmp_path / "learned"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    close(S.read_decisions(spark, str(tmp_path / "out")), D.detect(spark, SF), 1)
