"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its first
four letters, so that words not met in training share what their relatives taught; some word
rows are left out at random in training. Filters of several widths slide over the embedded
words, and each filter's maximum over the whole text goes through a rectifier into one
linear unit. Training is by Adam on all labelled rows. It starts on the driver with at most SAMPLE of them
(half of each class where there are enough, by smallest hash of doc_id, with SAMPLE_CHARS code
points together at most). All other rows are dealt to ROUNDS rounds: in each, groups of rows go on
from the network of the round before in tasks of their own, and the mean of their changes, weighted
by rows, is the next network (a word's row changes by the groups that have it).

Every labelled row calibrates (Platt scaling) and counts for the thresholds by a score of a network
that it didn't train: the first rows in halves scored by each other, the others by the network of
the round before theirs; those logits are counted in steps of 1 / STEPS. A caller of fit who gives
sample or chars trains on that many rows or code points only (a text that would go beyond is left
out), weighted back to the classes' share among all labels. A language's threshold is its own best cut drawn towards that
of all languages: m rows of its rarer class weigh m against LANG_PRIOR. A language without rows of
both classes, or not met in training, has the common one. threshold_of says whose threshold it
is, own_weight how much of it is the language's own. Scoring covers every whole text.

Language, source, doc_id and labels are never inputs of a score; the language only picks the
threshold that flagged is decided by.

Defined cases: a null text is empty; an empty text is scored as one blank position; without
labels of both classes every score is the share of label 1 among the labels (0 without any);
rows that repeat a document are scored alike; of rows that repeat a labelled doc_id the smallest
label and text train; of equally good cuts the highest is the threshold; a null lang is a language
of its own; an empty table gives an empty table. A very long text is scored whole, alone in its
step. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
STEM, DROP = 4, 0.4
#: Most labelled rows that training starts with.
SAMPLE = 4000
#: Most code points that training starts with.
SAMPLE_CHARS = 64_000_000
#: The other labelled rows train in so many rounds, in groups of about so many rows and code points.
ROUNDS, GROUP_ROWS, GROUP_CHARS = 4, 2000, 8_000_000
#: Their learning rate, the steps of a logit, and what changes are multiplied by so that sums are exact.
LATER_RATE, STEPS, UNIT = 0.005, 32, 1 << 20
EPOCHS, BATCH, RATE = 12, 64, 0.02
#: Small samples are gone through more often, up to this many steps.
LEAST_STEPS = 400
#: The common threshold weighs as many rows of a language's rarer class.
LANG_PRIOR = 10
CHUNK_WORDS = 150_000
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-"


class _Rows(dict):
    """The embedding rows of a word and of its stem, as one number; rows 0 are blank."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(_EDGES)
        row = self[word] = (1 + zlib.crc32(bare.encode()) % (BUCKETS - 1)) << 16 | 1 + zlib.crc32(b"^" + bare[:STEM].encode()) % (BUCKETS - 1)
        return row


def hashed(texts: list[str], rows: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words of all texts and of their stems, each text followed by blanks, and
    where each text begins."""
    flat: list[int] = []
    starts = []
    blank = [0] * max(WIDTHS)
    for text in texts:
        starts.append(len(flat))
        flat.extend(map(rows.__getitem__, text.lower().split()))
        flat.extend(blank)
    both = np.array(flat, dtype=np.int64)
    return both >> 16, both & 0xFFFF, np.array(starts, dtype=np.int64)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {None: 0.5}
        self.own_weights: dict[str, float] = {}
        self.constant: float | None = None
        #: Labelled rows that it was trained and calibrated on.
        self.rows = 0

    def values(self) -> list[np.ndarray]:
        """All that training changes, as views of DIM columns."""
        return [x.reshape(-1, DIM) for x in (self.embedding, *self.filters, self.bias, self.out)]

    def prepare(self) -> None:
        """Each word's share of each filter, so that scoring only looks up and adds."""
        self.tables = [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, ids: np.ndarray, stems: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maxima of each filter over each text and its first blank, before bias and rectifier;
        from there on a window would see the next text."""
        parts = []
        bounds = np.stack([starts, np.append(starts[1:], len(ids)) - max(WIDTHS) + 1], axis=1).reshape(-1)
        for tables in self.tables:
            window = tables[0][ids] + tables[0][stems]
            for j in range(1, len(tables)):
                window[:-j] += tables[j][ids[j:]] + tables[j][stems[j:]]
            parts.append(np.maximum.reduceat(window, bounds, axis=0)[::2])
        return np.concatenate(parts, axis=1)

    def logits(self, texts: list[str], rows: _Rows) -> np.ndarray:
        out, at = [], 0
        sizes = np.cumsum([1 + len(t) // 4 for t in texts])
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_WORDS)))
            out.append(self.summed(self.pooled(*hashed(texts[at:end], rows))))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def summed(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a text's score doesn't depend on its neighbours.
        return (np.maximum(x + self.bias.reshape(-1), 0) * self.out).astype(np.float64).sum(axis=1) + self.out_bias

    def score(self, texts: list[str], rows: _Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts, rows).astype(np.float64) + self.shift, -40, 40)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float = RATE):
        self.value, self.m, self.v, self.rate = value, np.zeros_like(value), np.zeros_like(value), rate

    def step(self, grad: np.ndarray, t: int, at: np.ndarray | slice = slice(None)) -> None:
        """at: only these rows change (lazily, for the embedding)."""
        m = self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        v = self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        self.value[at] -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    net = Network(seed)
    descend(net, hashed(texts, _Rows()), labels, float(labels.mean()), max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts))), RATE, seed)
    return net


def descend(net: Network, words: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, share: float, epochs: int, rate: float, seed: int) -> None:
    """Trains net on hashed texts; share: of label 1 among all rows."""
    rng = np.random.default_rng(seed)
    ids, stems, starts = words
    ends = np.append(starts[1:], len(ids))
    opt = [_Adam(x, rate) for x in (net.embedding, *net.filters, net.bias, net.out, net.out_bias)]
    # Both classes weigh the same.
    share = float(np.clip(share, 0.02, 0.98))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(starts))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            t += 1
            own, stem = (np.concatenate([x[starts[i] : ends[i]] for i in batch]) for x in (ids, stems))
            own = np.where(rng.random(len(own)) < DROP, 0, own)
            begin = np.concatenate([[0], np.cumsum(ends[batch] - starts[batch])[:-1]])
            embedded = net.embedding[own] + net.embedding[stem]
            places, tops = [], []
            for f in net.filters:
                window = embedded @ f[0]
                for j in range(1, len(f)):
                    window[:-j] += embedded[j:] @ f[j]
                spans = np.append(begin[1:], len(own)) - max(WIDTHS) + 1
                at = np.stack([a + window[a:b].argmax(axis=0) for a, b in zip(begin, spans, strict=True)])
                places.append(at)
                tops.append(np.take_along_axis(window, at, axis=0))
            pre = np.concatenate(tops, axis=1) + net.bias.reshape(-1)
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            error = (weight[batch] * (p - labels[batch]) / len(batch)).astype(np.float32)
            back = (error[:, None] * net.out) * (pre > 0)
            word_rows, word_grads, filter_grads = [], [], []
            for w, (f, at) in enumerate(zip(net.filters, places, strict=True)):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    where = np.minimum(at + j, len(own) - 1)
                    grad[j] = np.einsum("nkd,nk->dk", embedded[where], g)
                    word_rows += [own[where].reshape(-1), stem[where].reshape(-1)]
                    word_grads += [(g[:, :, None] * f[j].T[None]).reshape(-1, DIM)] * 2
                filter_grads.append(grad)
            touched, inverse = np.unique(np.concatenate(word_rows), return_inverse=True)
            grads = np.zeros((len(touched), DIM), np.float32)
            np.add.at(grads, inverse, np.concatenate(word_grads))
            grads[touched == 0] = 0
            opt[0].step(grads, t, touched)
            for o, grad in zip(opt[1 : 1 + len(WIDTHS)], filter_grads, strict=True):
                o.step(grad + 1e-4 * o.value, t)
            opt[-3].step(back.sum(axis=0).reshape(net.bias.shape), t)
            opt[-2].step(hidden.T @ error + 1e-4 * net.out, t)
            opt[-1].step(error.sum(keepdims=True), t)


def _trained(texts: list[str], labels: np.ndarray) -> Network:
    net = train(texts, labels)
    net.prepare()
    return net


def _platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton's method, with Platt's smoothed targets."""
    n1, n0 = (weights * labels).sum(), (weights * (1 - labels)).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weights * (p - target)) + 1e-3 * beta
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def _threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the best cut by weighted F1."""
    order = np.argsort(-scores, kind="stable")
    s, hit, w = scores[order], labels[order], weights[order]
    tp = np.cumsum(hit * w)
    f1 = 2 * tp / np.maximum(np.cumsum(w) + (hit * w).sum(), 1e-12)
    best = int(f1.argmax())
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0.0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None, chars: int | None = None) -> Network:
    """docs: doc_id, text, lang; labels: doc_id, toxic. At most SAMPLE rows and SAMPLE_CHARS code points
    (or sample and chars) come to the driver; the other labelled rows train in their tasks, unless
    sample or chars is given.

    The sample is drawn from ids alone; its ids (at most sample rows) are broadcast, so that
    texts are read in place and only the sampled ones move. Of rows that repeat a doc_id, the
    smallest label and text count.
    """
    bounded = sample is not None or chars is not None
    sample, chars = SAMPLE if sample is None else sample, SAMPLE_CHARS if chars is None else chars
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        net = Network()
        net.constant = n1 / max(1, n0 + n1)
        return net
    take1 = min(n1, max(sample // 2, sample - n0))
    take0 = min(n0, sample - take1)
    hash_ = F.xxhash64("doc_id")
    picked = [known.filter(F.col("toxic") == y).orderBy(hash_, "doc_id").limit(n) for y, n in ((0, take0), (1, take1))]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(F.broadcast(ids), "doc_id")
    data = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.min("toxic").alias("toxic"))
    w = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # sample rows at most, without their texts
    sizes = data.select("doc_id", hash_.alias("h"), F.char_length("t.text").cast("long").alias("n")).filter(F.col("n") <= chars)
    fits = sizes.withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") <= chars).select("doc_id")
    data = data.join(F.broadcast(fits), "doc_id").select(hash_.alias("h"), "t.text", "toxic", "t.lang", "doc_id").collect()
    data.sort(key=lambda r: (r["h"], r["text"] or ""))
    started = [(r["doc_id"],) for r in data]
    texts, labels = [r["text"] or "" for r in data], np.array([r["toxic"] for r in data], dtype=np.float32)
    some = lambda keep: [t for t, k in zip(texts, keep, strict=True) if k]
    half = np.zeros(len(data), bool)
    for y in (0, 1):
        half[np.flatnonzero(labels == y)[::2]] = True
    logits = np.zeros(len(data))
    for part in (half, ~half):
        if len(set(labels[~part])) == 2 and part.any():
            logits[part] = _trained(some(~part), labels[~part]).logits(some(part), _Rows())
    net = _trained(texts, labels) if texts else Network()
    y, langs = labels.astype(np.float64), np.array([r["lang"] or "" for r in data], dtype=object)
    weights = np.where(y == 1, n1 / take1, n0 / take0) if bounded else np.ones(len(y))
    if not bounded and n0 + n1 > len(data):
        rest = known.join(F.broadcast(docs.sparkSession.createDataFrame(started, known.select("doc_id").schema)), "doc_id", "left_anti")
        more = _rounds(net, docs, rest, n0 + n1 - len(data), n1 / (n0 + n1))
        logits, y, weights, langs = (np.concatenate([a, b]) for a, b in zip((logits, y, weights, langs), more, strict=True))
    net.rows = int(round(weights.sum()))
    weights = weights * (len(y) / weights.sum()) if bounded else weights
    net.scale, net.shift = _platt(logits, y, weights)
    scores = 1 / (1 + np.exp(-np.clip(net.scale * logits + net.shift, -40, 40)))
    net.thresholds = {None: _threshold(scores, y, weights)}
    for lang in sorted(set(langs)):
        own = langs == lang
        count = np.ones(own.sum()) if bounded else weights[own]
        rarer = min((count * y[own]).sum(), (count * (1 - y[own])).sum())
        if rarer:
            share = net.own_weights[lang] = float(rarer / (rarer + LANG_PRIOR))
            net.thresholds[lang] = share * _threshold(scores[own], y[own], weights[own]) + (1 - share) * net.thresholds[None]
    return net


def _rounds(net: Network, docs: DataFrame, rest: DataFrame, n: int, share: float) -> tuple[np.ndarray, ...]:
    """Trains net on the n labelled rows of rest (doc_id, toxic). Returns logits of networks that the
    rows didn't train, in steps of 1 / STEPS, labels, numbers of rows and languages."""
    size = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, -(-n // (ROUNDS * GROUP_ROWS)), -(-size // (ROUNDS * GROUP_CHARS)))
    part = lambda k, m: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(m))
    dealt = lambda df, k: df.filter(part(1, ROUNDS) == k).withColumn("_group", part(2, groups))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = [f"v{i}" for i in range(DIM)]
    names = ["lang", "key", "n", *sums]
    context, found = docs.sparkSession.sparkContext, []
    for k in range(ROUNDS):
        net.tables = []
        shared = context.broadcast(net)  # of a fixed size, about 1 MB

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """Changes of the network's rows by one group (lang null, key the row), and its counts by
            language, label and step of the logit."""
            import copy

            kinds = [pa.string()] + [pa.int64()] * (2 + DIM)
            toxic = dict(zip(right["_doc"].to_pylist(), right["toxic"].to_pylist(), strict=True))
            own: dict = {}
            for doc, *row in zip(*(left[c].to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if doc in toxic:
                    own[doc] = min(own.get(doc, row), row, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
            if not own:
                return pa.table([pa.array([], t) for t in kinds], names=names)
            order = sorted(own)
            y = np.array([toxic[d] for d in order], dtype=np.float32)
            start = shared.value  # noqa: B023
            now = copy.deepcopy(start)
            words = hashed([own[d][0] for d in order], _Rows())
            now.prepare()
            steps = np.floor(np.clip(now.summed(now.pooled(*words)), -40, 40) * STEPS).astype(np.int64) * 2 + y.astype(np.int64)
            counts: dict[tuple[str, int], int] = {}
            for d, step in zip(order, steps.tolist(), strict=True):
                at = (own[d][1] or "", step)
                counts[at] = counts.get(at, 0) + 1
            descend(now, words, y, share, 1, LATER_RATE, 7)
            last = np.zeros((1, DIM), np.float32)
            last[0, 0] = now.out_bias[0] - start.out_bias[0]
            change = np.concatenate([*(a - b for a, b in zip(now.values(), start.values(), strict=True)), last])
            rows = np.flatnonzero(change.any(axis=1))
            exact = np.rint(change[rows].astype(np.float64) * (len(y) * UNIT)).astype(np.int64)
            pad = np.zeros(len(counts), np.int64)
            columns = [
                pa.array([None] * len(rows) + [c[0] for c in counts], pa.string()), pa.array(np.concatenate([rows, [c[1] for c in counts]]).astype(np.int64)),
                pa.array(np.concatenate([np.full(len(rows), len(y)), list(counts.values())]).astype(np.int64)), *(pa.array(np.concatenate([exact[:, i], pad])) for i in range(DIM)),
            ]
            return pa.table(columns, names=names)

        marked = dealt(rest, k).select(F.col("doc_id").alias("_doc"), "toxic", F.col("_group").alias("_group_of"))
        met = dealt(texts, k).groupBy("_group").cogroup(marked.groupBy("_group_of"))
        out = met.applyInArrow(run, "lang string, key long, n long, " + ", ".join(f"{v} long" for v in sums))
        out = out.groupBy("lang", "key").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in sums]).toArrow()  # the network's rows, and steps by language
        lang, key, rows = out["lang"].to_pylist(), out["key"].to_numpy(), out["n"].to_numpy()
        moves = np.array([x is None for x in lang], dtype=bool)
        change = np.zeros((sum(len(x) for x in net.values()) + 1, DIM))
        change[key[moves]] = np.stack([out[v].to_numpy() for v in sums], axis=1)[moves] / (rows[moves, None] * float(UNIT))
        at = 0
        for x in net.values():
            x += change[at : at + len(x)].astype(np.float32)
            at += len(x)
        net.out_bias += np.float32(change[-1, 0])
        found += [(x, c, m) for x, c, m in zip(lang, key.tolist(), rows.tolist(), strict=True) if x is not None]
        shared.unpersist()
    found.sort()
    steps = np.array([c for _, c, _ in found], dtype=np.int64)
    return (steps // 2 + 0.5) / STEPS, (steps % 2).astype(np.float64), np.array([m for _, _, m in found], dtype=np.float64), np.array([x for x, _, _ in found], dtype=object)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs (doc_id, text, lang) with score, threshold, threshold_of (the language, or all),
    own_weight (the part of the threshold that is the language's own cut) and flagged."""
    net.tables = []
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value, _Rows()
        own.prepare()
        for batch in batches:
            scores = own.score([t or "" for t in batch.column(1).to_pylist()], rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")
    known = [x for k, v in net.thresholds.items() if k is not None for x in (F.lit(k), F.lit(v))]
    default = F.lit(net.thresholds[None])
    cut = F.coalesce(F.create_map(*known)[F.coalesce("lang", F.lit(""))], default) if known else default
    whose = F.when(F.coalesce("lang", F.lit("")).isin([k for k in net.thresholds if k is not None]), F.coalesce("lang", F.lit(""))).otherwise("all")
    parts = [x for k, v in net.own_weights.items() for x in (F.lit(k), F.lit(v))]
    part = F.coalesce(F.create_map(*parts)[F.coalesce("lang", F.lit(""))], F.lit(0.0)) if parts else F.lit(0.0)
    return out.withColumns({"threshold": cut, "threshold_of": whose, "own_weight": part}).withColumn("flagged", F.col("score") >= F.col("threshold"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    net = fit(docs.filter(~third), labels.filter(~third))
    out = score(docs, net)
    return out.select("doc_id", third.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "threshold_of", "own_weight", "flagged")

