"""Line deduplication across documents.

Lines are exploded with their position, hashed to 128 bits, counted per distinct document,
and those over the threshold are dropped everywhere but in the first document that holds
them; what stays is put together again by position.

Defined cases: a null text is one empty line; a row with a null doc_id passes unchanged and
counts for nothing; rows that repeat a doc_id are one document, so a line they share is not
repeated by that; equal rows get equal results; an empty table gives an empty table. The work
on a text is in proportion to its length, however many lines it has; one text is one row. Of
docs, columns named as a result column give way to it; any others pass through, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, columns_but, free_names, read, skew_join, stored, without

MIN_CHARS = 10
_SPACE = SPACE_CHARS.encode()


def _exploded(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    for batch in batches:
        ids, rows, positions, digests = [], [], [], []
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            for at, line in enumerate(text.lower().split(b"\n")):  # bytes.lower() changes A-Z only
                key = line.strip(_SPACE)
                if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                    ids.append(doc)
                    rows.append(row)
                    positions.append(at)
                    digests.append(xxhash.xxh3_128_digest(key))
        halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(positions, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
            names=["doc_id", "row_key", "pos", "h1", "h2"],
        )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
    min_chars code points or more in min_docs documents or more stay in the smallest doc_id
    alone. Counting is a partial aggregate, so a line that a third of all documents share
    arrives as one row from each task; the join that follows only carries hashes, and the rows
    of a common line are dealt out over many tasks.
    """
    own = F.coalesce(F.col("text"), F.lit(""))
    key, doc, row, gone = free_names(docs, "_key", "_doc", "_row", "_gone")
    base = docs.withColumn(key, F.xxhash64(own))
    lines = stored(
        docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(own).alias("row_key"), own.alias("text"))
        .mapInArrow(lambda it: _exploded(it, min_chars), "doc_id long, row_key long, pos int, h1 long, h2 long"),
        "lines",
    )
    if min_docs == 2:  # two different documents: the smallest and the largest differ
        counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    else:
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
        counted = once.groupBy("h1", "h2").agg(F.sum("rows").alias("n"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    counted = stored(counted.select("h1", "h2", "first", "n"), "repeated-lines")
    dropped = (
        skew_join(lines, counted, ["h1", "h2"], "n", ["doc_id", "row_key", "pos"]).filter("doc_id > first")
        .groupBy(F.col("doc_id").alias(doc), F.col("row_key").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    )
    joined = base.join(dropped, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(row)), "left")
    split = F.split(own, "\n", -1)
    return joined.select(
        *columns_but(docs, ("n_lines", "n_dropped", "kept_text")),
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.when(F.col(gone).isNull(), own).otherwise(without(split, F.col(gone))).alias("kept_text"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (f.k IS NOT NULL AND l.doc_id <> f.first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL OR l.doc_id = f.first), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY l.doc_id
"""
