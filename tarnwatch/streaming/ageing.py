"""Evidence ageing on a stream: watermarked windows, then a state for each leaf."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ageing import Ageing


def windowed_evidence(points: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """points (leaf, ts, p, s, n) summed over tumbling windows; rows later than late are dropped."""
    sums = points.withWatermark("ts", late).groupBy("leaf", F.window("ts", window)).agg(F.sum("p").alias("ev_p"), F.sum("s").alias("ev_s"), F.sum("n").alias("ev_n"))
    return sums.select("leaf", F.col("window.start").alias("win_start"), "ev_p", "ev_s", "ev_n")


def aged(evidence: DataFrame, params: Ageing = Ageing()) -> DataFrame:
    """(leaf, win_start, k_eff, lambda_dyn, acc_*) with the accumulated evidence kept as state.

    Windows of a leaf that come in one batch are put in order; append mode closes windows in
    order across batches, so that a replay gives what the batch operator gives."""
    out = "leaf string, win_start timestamp, k_eff double, lambda_dyn double, acc_safe double, acc_susp double, acc_atk double"

    def step(key: tuple[Any, ...], frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        acc = list(state.get) if state.exists else ([a * params.w for a in params.prior] if params.start_at_prior else [0.0] * 3)
        rows = []
        for r in pd.concat(list(frames)).sort_values("win_start").itertuples():
            now = [r.ev_p or 0.0, r.ev_s or 0.0, r.ev_n or 0.0]
            k, rate = params.factor(acc, now)
            acc = [rate * a + x for a, x in zip(acc, now, strict=True)]
            rows.append((key[0], r.win_start, k, rate, *acc))
        state.update(tuple(acc))
        yield pd.DataFrame(rows, columns=["leaf", "win_start", "k_eff", "lambda_dyn", "acc_safe", "acc_susp", "acc_atk"])

    keyed = evidence.select("leaf", F.col("win_start").cast("timestamp").alias("win_start"), "ev_p", "ev_s", "ev_n").groupBy("leaf")
    return keyed.applyInPandasWithState(step, out, "a double, b double, c double", "append", GroupStateTimeout.NoTimeout)
