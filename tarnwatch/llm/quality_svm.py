"""A quality classifier of Naive Bayes support vectors.

A document's features are the n-grams that it contains: words, pairs of neighbouring words, runs
of three characters, and 2 to REPEATS times the same word in a row (a feature for each length,
whatever the word), hashed into SPACE numbers. Each class's smoothed counts of documents give a feature its log-count ratio; a
document is the vector of the ratios of its features, scaled to length one. A linear model of hinge
loss is fitted to these by dual coordinate descent, and mixed with the Naive Bayes direction
(MIX). Scores are calibrated by Platt scaling on margins out of fold, weighted back to the
classes' shares among all labels.

Training sees at most SAMPLE labelled rows, half of each class where there are enough, by smallest
hash of doc_id. Their ids are broadcast, their texts become sets of features in tasks, and only
those sets come to the driver: a set is a list of numbers or, from DENSE on, a bitmap, so at most
SPACE / 8 bytes (128 MB for all). Scoring covers every whole text, in place.

Language, source, doc_id and labels are never inputs of a score.

Defined cases: a null text is empty; an empty text has no feature and is scored by the model's
constant; without labels of both classes every score is the share of label 1 among the labels (0
without any); rows that repeat a document are scored alike; of rows that repeat a labelled doc_id
the smallest label and text train; an empty table gives an empty table. A very long text is read
in pieces of CHUNK characters, its features are those of the whole. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SPACE = 1 << 18
DENSE = SPACE // 32
#: Most labelled rows that training sees.
SAMPLE = 4000
FOLDS, EPOCHS, COST, SMOOTH, MIX = 4, 30, 1.0, 1.0, 0.75
#: Characters whose runs are hashed at a time.
CHUNK = 1 << 20
#: Longest run of one word that has a feature of its own.
REPEATS = 8


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


class Features:
    """The sets of features of texts; keeps its tables from one text to the next."""

    def __init__(self):
        self.hashes = _Hashes()
        self.seen = np.zeros(SPACE, np.int64)

    def _fresh(self, ids: np.ndarray) -> np.ndarray:
        """ids without repeats: the last of equal ones stays."""
        at = np.arange(len(ids))
        self.seen[ids] = at
        return ids[self.seen[ids] == at]

    def of(self, text: str) -> np.ndarray:
        h = np.array(list(map(self.hashes.__getitem__, text.lower().split())), dtype=np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
        # The longest run of equal neighbours: the widest gap between places where the word changes.
        changes = np.flatnonzero(np.concatenate([[True], h[:-1] != h[1:], [True]])) if len(h) else np.zeros(1, int)
        longest = int(np.diff(changes).max(initial=0))
        found = [self._fresh(((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(41)) % np.uint64(SPACE)).astype(np.int64)), self._fresh((pairs % np.uint64(SPACE)).astype(np.int64)), np.arange(2, min(longest, REPEATS) + 1)]
        for at in range(0, len(text), CHUNK):
            c = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            runs = ((c[:-2] << np.uint64(42)) + (c[1:-1] << np.uint64(21)) + c[2:]) * np.uint64(0x165667B19E3779F9) >> np.uint64(43)
            found.append(self._fresh((runs % np.uint64(SPACE)).astype(np.int64)))
        return np.sort(self._fresh(np.concatenate(found)))


def packed(ids: np.ndarray) -> bytes:
    if len(ids) < DENSE:
        return ids.astype("<u4").tobytes()
    bits = np.zeros(SPACE, bool)
    bits[ids] = True
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < SPACE // 8:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def ratios(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the ratio of a feature's smoothed share in class 1 to that in class 0."""
    counts = [np.full(SPACE, SMOOTH), np.full(SPACE, SMOOTH)]
    for ids, y in zip(sets, labels, strict=True):
        counts[int(y)][ids] += 1
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    return np.log(counts[1] / (n[1] + 2 * SMOOTH)) - np.log(counts[0] / (n[0] + 2 * SMOOTH))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 11, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and constant of the least |w|^2 / 2 + sum of cost * hinge loss, by coordinates of the
    dual; rows are (positions, values), the constant is a further feature of value 1."""
    w, constant, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            gradient = sign[i] * (float(w[ids] @ v) + constant) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[ids] += step * v
                constant += step
        if worst < tolerance:
            break
    return w, constant


class Model:
    def __init__(self):
        self.ratio = np.zeros(SPACE, np.float32)
        self.weight = np.zeros(SPACE, np.float32)
        self.constant, self.scale, self.shift = 0.0, 1.0, 0.0
        self.fixed: float | None = None

    def margin(self, ids: np.ndarray) -> float:
        """The sum of ratio * weight over the features, by the length of the ratios."""
        r = self.ratio[ids].astype(np.float64)
        return float(r @ self.weight[ids]) / max(float(np.sqrt(r @ r)), 1e-12) + self.constant

    def score(self, ids: np.ndarray) -> float:
        if self.fixed is not None:
            return self.fixed
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(ids) + self.shift, -40, 40))))


def train(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    model = Model()
    model.ratio = ratios(sets, labels).astype(np.float32)
    rows = []
    for ids in sets:
        v = model.ratio[ids].astype(np.float64)
        rows.append((ids, v / max(float(np.sqrt(v @ v)), 1e-12)))
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    cost = COST * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w, model.constant = descend(rows, np.where(labels == 1, 1.0, -1.0), cost, SPACE)
    used = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.int64)
    mean = float(np.abs(w[used]).mean()) if len(used) else 0.0
    model.weight[used] = ((1 - MIX) * mean + MIX * w[used]).astype(np.float32)
    return model


def platt(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton's method, with Platt's smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - target)) + 1e-3 * beta
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3]), gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_sets(sets: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """The model of all sets, calibrated on margins out of fold; share: of label 1 among all labels."""
    fold = np.zeros(len(sets), int)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % FOLDS
    margins, known = np.zeros(len(sets)), np.zeros(len(sets), bool)
    for f in range(FOLDS):
        out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(out) and len(set(labels[rest])) == 2:
            part = train([sets[i] for i in rest], labels[rest])
            margins[out], known[out] = [part.margin(sets[i]) for i in out], True
    model = train(sets, labels)
    if known.any():
        y = labels[known]
        weights = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
        model.scale, model.shift = platt(margins[known], y, weights * len(y) / weights.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. At most sample sets come to the driver."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {int(r["quality"]): r["count"] for r in known.groupBy("quality").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        model = Model()
        model.fixed = n1 / max(1, n0 + n1)
        return model
    take1 = min(n1, max(sample // 2, sample - n0))
    take0 = min(n0, sample - take1)
    picked = [known.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, take0), (1, take1))]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "quality")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            sets = [packed(features.of(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("quality"), pa.array(sets, pa.binary())], names=["h", "quality", "f"])

    data = one.select(F.xxhash64("doc_id").alias("h"), "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "h long, quality int, f binary").collect()
    data.sort(key=lambda r: (r["h"], bytes(r["f"])))
    return fit_sets([unpacked(bytes(r["f"])) for r in data], np.array([r["quality"] for r in data], dtype=np.float64), n1 / (n0 + n1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) as doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            scores = [own.score(features.of(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = score(docs, fit(docs, labels.filter(~fifth)))
    return out.select("doc_id", fifth.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
