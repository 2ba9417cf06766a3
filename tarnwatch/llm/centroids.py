"""Centroid clustering in whole numbers, with one upper and one lower bound a vector (Hamerly).

A vector's state is its integers, its cluster, an upper bound of the distance to its own centroid
and one lower bound of the distance to any other. When centroids move, the upper bound grows by
the drift of its own centroid and the lower one shrinks by the largest drift of the others. While
the upper bound stays below the lower one, or below half the way to the nearest other centroid,
the vector can't have changed: nothing is computed. Else its distance to its own centroid is
taken again, and if that doesn't settle it, its distances to all centroids, in exact integers,
ties to the smaller number. Bounds are rounded outwards by one part in 10^12, so that rounding of doubles
never hides a tie.

Every round is one pass: it reads the states of the round before and writes the new ones, with each
task's sums by cluster as further rows of the same table. Only those sums are then aggregated
(their columns hold nothing else), and at most k rows come to the driver. No vector is shuffled,
so equal vectors, however many, need nothing of their own. Finished rounds are deleted.

Defined cases: vectors of another length, or with a null or non-finite component, are left out; a
component of 2^27 or more after scaling raises, since squared distances would leave 64 bits; fewer
kept vectors than k give as many centroids; none give an empty table. Rows that repeat a vec_id count
each, and of those the smaller vector is the earlier start; a null vec_id comes last. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, stored

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components stay below this, so that 64 squared differences fit in 64 bits.
LARGEST = 1 << 27
_OUT = 1e-12

STATE = "vec_id long, q array<int>, cluster int, upper double, lower double, n long, sums array<long>"


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the floors of the scaled components, of the vectors that are kept."""

    def bad(x: Column) -> Column:
        d = x.cast("double")
        return x.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) < LARGEST, y).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")).cast("long")).cast("int")

    kept = vectors.filter((F.size("embedding") == dim) & ~F.exists("embedding", bad))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("q"))


def starts(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes of their vec_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of q to each centroid."""
    out = np.empty((len(q), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = q - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def scanned(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and both bounds, by a full scan."""
    d = distances(q, centroids)
    nearest = d.argmin(axis=1)
    least = np.take_along_axis(d, nearest[:, None], axis=1)[:, 0]
    if len(centroids) == 1:
        second = np.full(len(q), np.inf)
    else:
        second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - _OUT)
    return nearest.astype(np.int32), np.sqrt(least.astype(np.float64)) * (1 + _OUT), second


class Moves:
    """What a step of the centroids does to bounds."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.centroids = after
        k = len(after)
        d = (after - before).astype(np.float64)
        self.drift = np.sqrt((d * d).sum(axis=1)) * (1 + _OUT)
        others = np.where(np.eye(k, dtype=bool), 0.0, self.drift)
        self.other_drift = others.max(axis=1)
        apart = np.sqrt(distances(after, after).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - _OUT)

    def assign(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and how many vectors were scanned in full."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + _OUT)
        shrunk = self.other_drift[cluster]
        lower = lower - shrunk - _OUT * (np.where(np.isinf(lower), 0, lower) + shrunk)
        safe = np.maximum(lower, self.half[cluster])
        doubt = np.flatnonzero(upper >= safe)
        d = q[doubt] - self.centroids[cluster[doubt]]
        upper[doubt] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + _OUT)
        doubt = doubt[upper[doubt] >= safe[doubt]]
        cluster[doubt], upper[doubt], lower[doubt] = scanned(q[doubt], self.centroids)
        return cluster, upper, lower, len(doubt)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _pass(states: DataFrame, moves: Moves, first: bool) -> DataFrame:
    """New states, and each task's sums by cluster as rows with n."""
    k = len(moves.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(moves.centroids.shape, np.int64), np.zeros(k, np.int64)
        schema = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("q"))
            if first:
                cluster, upper, lower = scanned(q, moves.centroids)
            else:
                cluster, upper, lower, _ = moves.assign(q, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")))
            for j in range(k):
                own = cluster == j
                counts[j] += own.sum()
                sums[j] += q[own].sum(axis=0)
            n = len(batch)
            ints = batch.column("q").cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), ints, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        own = np.flatnonzero(counts)
        if len(own):
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(own, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(counts[own], pa.int64()), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], schema=schema)

    return states.mapInArrow(run, STATE)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the clusters of a written round; empty ones stay."""
    dim = centroids.shape[1]
    parts = table.filter("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)))
    out = centroids.copy()
    for r in parts.collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of the kept vectors, as a stored table, and the centroids."""
    kept = whole_vectors(vectors, dim, scale)
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dim)
    moves, states, table = Moves(centroids, centroids), kept, None
    for step in range(rounds):
        before, table = table, stored(_pass(states, moves, step == 0), "centroids")
        if before is not None:
            discard(before)
        after = moved(table, moves.centroids)
        moves = Moves(moves.centroids, after)
        states = table.filter("n IS NULL").select("vec_id", "q", "cluster", "upper", "lower")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("q"))
            if rounds:
                own, _, _, _ = moves.assign(q, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")))
            else:
                own, _, _ = scanned(q, moves.centroids)
            d = q - moves.centroids[own]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], names=["vec_id", "cluster", "distance"])

    out = stored(states.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    if table is not None:
        discard(table)
    return out, moves.centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = cluster(read(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids.tolist())}

    def by_cluster(values: dict, kind: str) -> Column:
        pairs = [x for j, v in values.items() for x in (F.lit(j), F.lit(v).cast(kind))]
        return F.element_at(F.create_map(*pairs), F.col("cluster")) if pairs else F.lit(None).cast(kind)

    total = F.lit(sum(inertia.values())).cast("long")
    return out.select("vec_id", "cluster", "distance", by_cluster(inertia, "long").alias("cluster_inertia"), total.alias("inertia"), by_cluster(digest, "string").alias("centroid_sha256"))


def _op12_sql() -> str:
    """The rounds one after the other; n components are kept as a list."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
    SELECT id, vec_id, q, k, c, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}
),
a{r} AS MATERIALIZED (
    SELECT id, vec_id, q, k, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1
)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS MATERIALIZED (
    SELECT k, list(m ORDER BY i) AS c FROM (
        SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT k, unnest(q) AS x, unnest(range({DIM})) AS i FROM a{r}) GROUP BY k, i
    ) GROUP BY k
),
c{r + 1} AS MATERIALIZED (
    SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
    FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, q AS c FROM kept QUALIFY k < {K}
),{",".join(steps)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS}
"""


OP12_SQL = _op12_sql()
