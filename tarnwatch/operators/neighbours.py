"""Exact nearest neighbours of rows among any number of reference rows, and local outlier factors.

A few reference rows are pivots; each reference row belongs to the cell of its nearest pivot. A cell
is known by its pivot, its radius and its number of rows, so the distances of a row to the pivots
bound its distances to the rows of every cell from below and above. A row first goes to the cells
that surely hold enough neighbours, which gives it a distance that its last neighbour can't pass,
and then to those other cells that come nearer than that. Cells meet their rows in blocks, so no
task holds a whole cell; equal reference rows are one row with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .segments import meet

#: Most pivots; reference rows to a pivot; rows of a block on either side.
PIVOTS, CELL_ROWS, BLOCK = 1024, 2000, 4096
_NEIGHBOURS = "array<struct<d:double,rid:long,n:long>>"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.empty((0, 0))


def _chunks(n: int, width: int) -> range:
    return range(0, n, max(1, 4_000_000 // max(1, width)))


def _probe(asked: DataFrame, refs: DataFrame, blocks: dict[int, int], k: int, same: bool) -> DataFrame:
    """(qid, near) partial lists: asked (qid, v, cell) meet the blocks of their cells in refs."""
    many = {r["cell"]: -(-r["count"] // BLOCK) for r in asked.groupBy("cell").count().collect()}  # a row for each cell
    if not many:
        return asked.sparkSession.createDataFrame([], f"qid long, near {_NEIGHBOURS}")
    number = lambda table: F.coalesce(F.element_at(F.create_map(*[x for c, m in table.items() for x in (F.lit(c), F.lit(m))]), F.col("cell")), F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), number(many)).cast("int")).withColumn("rb", every(number(blocks)))
    r = refs.filter(number(many) > 0).withColumn("qb", every(number(many)))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "near": []})
        right = right.sort_values("rid")
        x, y, rid, n = _matrix(left["v"]), _matrix(right["v"]), right["rid"].to_numpy(), right["n"].to_numpy()
        qid, lists = left["qid"].to_numpy(), []
        for at in _chunks(len(x), y.size):
            d = _apart(x[at : at + max(1, 4_000_000 // max(1, y.size))], y)
            for row, own in zip(d, qid[at:]):
                order = np.argsort(row, kind="stable")[: k + 1]
                near = [{"d": float(row[i]), "rid": int(rid[i]), "n": int(n[i]) - int(same and rid[i] == own)} for i in order]
                lists.append([e for e in near if e["n"] > 0][: k])
        return pd.DataFrame({"qid": qid, "near": lists})

    return q.groupBy("cell", "rb", "qb").cogroup(r.groupBy("cell", "rb", "qb")).applyInPandas(work, f"qid long, near {_NEIGHBOURS}")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """One list a row: the nearest by distance and then number, with counts that add up to k."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)

    def take(acc: Column, e: Column) -> Column:
        left = k - acc["m"]
        more = F.when(left > 0, F.array(F.struct(e["d"].alias("d"), e["rid"].alias("rid"), F.least(e["n"], left).alias("n")))).otherwise(F.array().cast(_NEIGHBOURS))
        return F.struct((acc["m"] + e["n"]).alias("m"), F.concat(acc["l"], more).alias("l"))

    zero = F.struct(F.lit(0).cast("long").alias("m"), F.array().cast(_NEIGHBOURS).alias("l"))
    return parts.groupBy("qid").agg(near.alias("near")).select("qid", F.aggregate("near", zero, take)["l"].alias("near"))


def nearest(rows: DataFrame, refs: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(qid, near): the k nearest of refs (rid, v, n: how many rows it stands for) to each of rows
    (qid, v), as (d, rid, n). With same, rows are refs, and a row isn't its own neighbour (its other
    copies are). Both are read several times and should be stored. k is at most the rows of refs."""
    total = refs.count()
    some = refs.orderBy(F.xxhash64("rid"), "rid").limit(min(PIVOTS, -(-total // CELL_ROWS))).select("v").collect()
    pivots = np.array([r["v"] for r in some], dtype=float)

    def place(frames):
        for pdf in frames:
            x = _matrix(pdf["v"])
            d = [(_apart(x[at : at + max(1, 4_000_000 // pivots.size)], pivots)) for at in _chunks(len(x), pivots.size)]
            d = np.concatenate(d) if d else np.empty((0, len(pivots)))
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), away=d.min(axis=1) if len(d) else np.empty(0))

    placed = cut(refs.select("rid", "v", "n").mapInPandas(place, "rid long, v array<double>, n long, cell int, away double"))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}  # a row for each pivot
    held = sorted(cells)
    radius, size = np.array([cells[c]["radius"] for c in held]), np.array([cells[c]["n"] for c in held])
    blocks = {c: -(-cells[c]["rows"] // BLOCK) for c in held}
    centres = pivots[held]
    parts = F.element_at(F.create_map(*[x for c, m in blocks.items() for x in (F.lit(c), F.lit(m))]), F.col("cell"))
    placed = placed.withColumn("rb", F.pmod(F.xxhash64("rid"), parts).cast("int")).select("rid", "v", "n", "cell", "rb")
    wanted = k + int(same)

    def first(frames):
        for pdf in frames:
            x, lists = _matrix(pdf["v"]), []
            for at in _chunks(len(x), centres.size):
                d = _apart(x[at : at + max(1, 4_000_000 // centres.size)], centres)
                order = np.argsort(d + radius, axis=1)
                enough = np.minimum((np.cumsum(size[order], axis=1) < wanted).sum(axis=1), len(held) - 1)
                lists += [[held[c] for c in o[: m + 1]] for o, m in zip(order, enough)]
            yield pdf[["qid", "v"]].assign(cells=lists)

    def second(frames):
        for pdf in frames:
            x, lists = _matrix(pdf["v"]), []
            limit, done = pdf["limit"].to_numpy(dtype=float), pdf["cells"].tolist()
            for at in _chunks(len(x), centres.size):
                low = _apart(x[at : at + max(1, 4_000_000 // centres.size)], centres) - radius
                for row, most, seen in zip(low, limit[at:], done[at:]):
                    lists.append([held[c] for c in np.flatnonzero(row <= most * (1 + 1e-9) + 1e-12) if held[c] not in set(seen)])
            yield pdf[["qid", "v"]].assign(cells=lists)

    kind = "qid long, v array<double>, cells array<int>"
    start = cut(rows.select("qid", "v").mapInPandas(first, kind))
    one = lambda df: df.select("qid", "v", F.explode("cells").alias("cell"))
    found = cut(_merged(_probe(one(start), placed, blocks, k, same), k))
    limit = found.select("qid", F.element_at("near", -1)["d"].alias("limit"))
    rest = cut(one(meet(start, limit, ["qid"]).select("qid", "v", "cells", "limit").mapInPandas(second, kind)))
    return _merged(found.unionByName(_probe(rest, placed, blocks, k, same)), k)


def local_outlier_factor(df: DataFrame, train: Column, metrics: Sequence[str], k: int = 35) -> DataFrame:
    """df with score: a row's local outlier factor against all training rows (novelty: a training
    row that is scored counts among its own neighbours). Nulls are 0, metrics are scaled by the
    training rows. With fewer than two training rows the score is 1; k is at most their number less one."""
    value = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics]
    value = [F.when(F.isnan(v), 0.0).otherwise(v) for v in value]
    stats = df.filter(train).agg(F.count(F.lit(1)), *[F.avg(v) for v in value], *[F.stddev_pop(v) for v in value]).first()
    total, mean, scale = stats[0], stats[1 : 1 + len(value)], stats[1 + len(value) :]
    if total < 2:
        return df.withColumn("score", F.lit(1.0))
    k = max(1, min(k, total - 1))
    v = F.array(*[(x - F.lit(m)) / F.lit(s if s and s > 0 else 1.0) for x, m, s in zip(value, mean, scale, strict=True)])
    rows = df.select("*", v.alias("_v"))
    refs = cut(rows.filter(train).groupBy(F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("rid", F.monotonically_increasing_id()))
    asked = cut(rows.select(F.col("_v").alias("v")).distinct().withColumn("qid", F.monotonically_increasing_id()))

    near = cut(nearest(refs.select(F.col("rid").alias("qid"), "v"), refs, k, same=True))
    reach = near.select(F.col("qid").alias("rid"), F.element_at("near", -1)["d"].alias("reach"))
    long = lambda df: df.select("qid", F.explode("near").alias("e")).select("qid", "e.*")

    def density(df: DataFrame) -> DataFrame:
        """(qid, density): one over the mean of the distances, at least those that neighbours reach."""
        far = F.sum(F.greatest("d", "reach") * F.col("n")) / F.sum("n")
        return long(df).join(reach, "rid").groupBy("qid").agg((1 / F.greatest(far, F.lit(1e-12))).alias("density"))

    known = cut(density(near).select(F.col("qid").alias("rid"), "density"))
    other = cut(nearest(asked, refs, k))
    around = long(other).join(known, "rid").groupBy("qid").agg((F.sum(F.col("density") * F.col("n")) / F.sum("n")).alias("around"))
    scores = asked.join(around.join(density(other), "qid"), "qid").select("v", (F.col("around") / F.col("density")).alias("score"))
    return meet(rows, scores.withColumnRenamed("v", "_v"), ["_v"]).drop("_v")
