"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each is the longest known phrase and one more code
point), the distinct phrases are hashed, and a one-permutation signature of BINS minimum
hashes is the fingerprint: BINS groups of four hexadecimal digits. Two texts are as alike as
the share of equal minima, an estimate of the overlap of their phrase sets, which is high
where one text compresses well with the other's dictionary.

compare_with_next() fingerprints each document and a version of it whose second half comes
from the next document by doc_id. Documents are dealt out by ranges of doc_id; the first
document of each range also goes to the range before, so each text moves once and nothing
is ordered globally.

Defined cases: a null text is empty; an empty text has an empty fingerprint, likeness 1 with
another empty one and 0 with others; null doc_ids come first; rows that repeat a doc_id
follow each other by a hash of their text, equal rows in any order; a lone document is its own
next; an empty table gives an empty table. A very long text is parsed and hashed whole, in one
task: its trie needs memory for its phrases, the hashing for STEP code points at a time. Other
columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .sketch import U64, OnePermutation, mix, short

BINS = 128
#: Ranges for each shuffle partition: evens out how many a task gets.
RANGES = 3
#: Code points that are hashed in one go.
STEP = 1 << 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BASE = 0x9E3779B97F4A7C15


def parse(text: str, at: int, known: dict, stop: int | None = None, log: list | None = None) -> tuple[list[int], int]:
    """Ends of the phrases from position at, and where it stopped; known gains the phrases.

    known is a trie: code points to tries, 0 at its leaves. With stop, a phrase that would end
    beyond it isn't begun. log gains what forget() needs to take the phrases out again.
    """
    ends: list[int] = []
    node, last = known, at
    steps = enumerate(text[at:stop], at + 1)
    for end, c in steps:
        child = node.get(c)
        if child:
            node = child
            continue
        if child is None:
            node[c] = 0
        else:
            end, d = next(steps, (0, ""))
            if not end:
                break
            node[c] = {d: 0}
        if log is not None:
            log.append((node, c, child))
        ends.append(end)
        last, node = end, known
    if stop is None and last < len(text):
        last = len(text)
        ends.append(last)
    return ends, last


def forget(log: list) -> None:
    for node, c, child in reversed(log):
        if child is None:
            del node[c]
        else:
            node[c] = child


class Fingerprinter:
    def __init__(self, bins: int = BINS):
        self.oph = OnePermutation(bins)
        self.powers = self.inverse = np.ones(1, dtype=U64)

    def hashes(self, text: str, at: int, ends: list[int]) -> np.ndarray:
        """Hashes of the phrases that follow each other from position at; the text is gone
        through in steps, so that tables are longer than STEP only for a longer phrase."""
        e = np.array(ends, dtype=np.int64)
        out, begin = [], 0
        while begin < len(e):
            stop = max(begin + 1, int(np.searchsorted(e, at + STEP, "right")))
            out.append(self._step(text[at : ends[stop - 1]], e[begin:stop] - at))
            begin, at = stop, ends[stop - 1]
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, U64)

    def _step(self, text: str, e: np.ndarray) -> np.ndarray:
        n = len(text)
        if len(self.powers) <= n:
            size = max(STEP, n + 1)
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U64)
        codes += U64(1)
        codes *= self.powers[:n]
        until = np.cumsum(codes)[e - 1]
        sums, size, at = until.copy(), e.copy(), np.zeros_like(e)
        sums[1:] -= until[:-1]
        size[1:] -= e[:-1]
        at[1:] = e[:-1]
        return mix(sums * self.inverse[at] + size.astype(U64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        return short(self.oph(np.sort(hashes))) if len(hashes) else np.empty(0, "<u2")

    def __call__(self, text: str) -> np.ndarray:
        return self.signature(self.hashes(text, 0, parse(text, 0, {})[0]))


def as_text(minima: np.ndarray) -> str:
    return minima.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


class _Current:
    """A document that waits for the next one: its first half is parsed and hashed once."""

    __slots__ = ("at", "doc", "half", "head", "known", "minima", "text")

    def __init__(self, doc: int | None, text: str, prints: Fingerprinter):
        self.doc, self.text = doc, text
        self.half = len(text) - len(text) // 2
        self.known: dict = {}
        ends, self.at = parse(text, 0, self.known, self.half)
        self.head = prints.hashes(text, 0, ends)
        log: list = []
        self.minima = self._with_rest(text, prints, log)
        forget(log)

    def _with_rest(self, text: str, prints: Fingerprinter, log: list | None = None) -> np.ndarray:
        rest = prints.hashes(text, self.at, parse(text, self.at, self.known, None, log)[0])
        return prints.signature(np.concatenate([self.head, rest]))

    def row(self, following: _Current, prints: Fingerprinter) -> tuple:
        edited = self.text[: self.half] + following.text[: len(self.text) - self.half]
        changed = self._with_rest(edited, prints)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return self.doc, len(self.text), digest, as_text(self.minima), as_text(changed), likeness(self.minima, changed), likeness(self.minima, following.minima)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = Fingerprinter()
    held: _Current | None = None
    range_ = None
    guest = False
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
    for batch in batches:
        rows = []
        for r, role, doc, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if r != range_:
                range_, held, guest = r, None, False
            if guest:
                continue  # rows that repeat the guest's doc_id
            current = _Current(doc, text, prints)
            if held:
                rows.append(held.row(current, prints))
            held, guest = current, role == 1
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, as SCHEMA says."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    wanted = parts * RANGES
    bounds = ids.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))

    def range_of(c: Column) -> Column:
        return F.coalesce(F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda b: b <= c)), F.lit(0)) if bounds else F.lit(0)

    numbered = ids.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.col("doc_id"))))
    # As many rows as there are ranges.
    firsts = sorted((r["range"], None if r["nulls"] else r["low"]) for r in numbered.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    if not firsts:
        return docs.limit(0).selectExpr("cast(doc_id as long) doc_id").selectExpr(*[f"cast({'doc_id' if c == 'doc_id' else 'null'} as {t}) {c}" for c, t in (x.split() for x in SCHEMA.split(", "))])
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}
    known = [x for low, r in before.items() if low is not None for x in (F.lit(low), F.lit(r))]
    guest_of = F.create_map(*known)[F.col("doc_id")] if known else F.lit(None).cast("int")
    if None in before:
        guest_of = F.when(F.col("doc_id").isNull(), before[None]).otherwise(guest_of)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.col("doc_id")))).withColumn("guest", guest_of)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("role"))
    also = F.struct(F.col("guest").alias("range"), F.lit(1).alias("role"))
    places = F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, also))
    dealt = rows.select("doc_id", "text", F.inline(places)).withColumn("tie", F.xxhash64("text"))
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "role", F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("range", "role", "doc_id", "text").mapInArrow(_compared, SCHEMA)


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
