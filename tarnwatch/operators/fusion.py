"""Fusing the opinions of many rows into one for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import opinions as O

MODES = ("wbf", "hierarchical", "abf", "cbf", "bcf", "ccf", "minbf", "maxbf")


def _mean(values: O.Three, weight: Column) -> list[Column]:
    return [F.try_divide(F.sum(weight * v), F.sum(weight)) for v in values]


def fuse(df: DataFrame, keys: Sequence[str], mode: str = "wbf", order: str = "leaf", weight: Column | None = None, w: float = O.W) -> DataFrame:
    """keys and the fused opinion of the rows of each group; a group of one keeps its own.

    wbf, hierarchical, abf, minbf and maxbf are plain partial aggregates. cbf, bcf and ccf
    are folds in the order of a column: a group's opinions are gathered first, so groups are
    meant to be small (the leaves of one window).
    """
    if mode not in MODES:
        raise ValueError(f"unknown fusion mode {mode}")
    op = O.Opinion.of()
    if mode in ("cbf", "bcf", "ccf"):
        return _folded(df, keys, mode, order)
    ext = F.greatest(weight, F.lit(0.0)) if weight is not None else F.lit(1.0)
    one = F.count(F.lit(1)) == 1
    lone = [F.min_by(c, order) for c in (*op.b, op.u, *op.a)]
    rates = [F.avg(a) for a in op.a]
    if mode in ("wbf", "hierarchical"):
        by = ext * op.confidence() if mode == "wbf" else ext
        empty = F.sum(by) < O.TINY
        fused = O.from_evidence(tuple(_mean(O.to_evidence(op, w), by)), w, tuple(_mean(op.a, by)))
        blank = O.Opinion.vacuous(tuple(F.min_by(a, order) for a in op.a) if mode == "wbf" else tuple(rates))
        fused = O.either(empty, blank, fused)
    elif mode == "abf":
        sure = F.max((op.u < O.DOGMATIC).cast("int")) == 1
        own = (op.u < O.DOGMATIC).cast("double")
        inverse = F.try_divide(F.lit(1.0), F.greatest(op.u, F.lit(O.TINY)))
        usual = O.Opinion(tuple(F.sum(b * inverse) / F.sum(inverse) for b in op.b), F.count(F.lit(1)) / F.sum(inverse), tuple(rates))
        fused = O.either(sure, O.Opinion(tuple(_mean(op.b, own)), F.lit(0.0), tuple(_mean(op.a, own))), usual)
    else:
        b = [F.min(x) if mode == "minbf" else F.max(x) for x in op.b]
        s = O.total(b)
        fused = O.Opinion(tuple(F.when(s > 1, F.try_divide(x, s)).otherwise(x) for x in b), F.greatest(1 - s, F.lit(0.0)), tuple(rates))
    columns = [F.when(one, own).otherwise(new).alias(n) for own, new, n in zip(lone, (*fused.b, fused.u, *fused.a), O.FIELDS, strict=True)]
    return df.groupBy(*keys).agg(*columns)


def _folded(df: DataFrame, keys: Sequence[str], mode: str, order: str) -> DataFrame:
    op = O.Opinion.of().struct()
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), op.alias("o")))).alias("l"))
    unpack = lambda s: O.Opinion(tuple(s[f] for f in O.FIELDS[:3]), s["u"], tuple(s[f] for f in O.FIELDS[4:]))
    step = lambda acc, x: O.PAIRWISE[mode](unpack(acc), unpack(x["o"])).struct()
    folded = F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", F.lit(0))["o"], step)
    return listed.select(*keys, folded.alias("f")).select(*keys, "f.*")


def fuse_methods(groups: DataFrame, keys: Sequence[str], mode: str = "wbf", balance: float = 1.0, order: str = "grp") -> DataFrame:
    """One opinion for each window from those of its method groups. With cbf, balance above
    one divides the evidence of the first group, below one that of the second is scaled."""
    if mode == "cbf" and balance != 1.0:
        op = O.Opinion.of()
        side = F.min(order)
        first = groups.groupBy(*keys).agg(side.alias("_first"))
        joined = groups.join(first, list(keys))
        lead = F.col(order) == F.col("_first")
        scaled = O.either(lead, O.boost(op, 1 / balance) if balance > 1 else op, op if balance > 1 else O.boost(op, balance))
        groups = joined.select(*keys, order, *scaled.columns())
    return fuse(groups, keys, mode, order)
