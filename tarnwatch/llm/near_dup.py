"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

1. Each text becomes a set of hashed word shingles; equal sets are one class from here on.
2. A class's signature is cut into bands; classes that agree on a band share a bucket.
3. Within a bucket every class is paired with the smallest only (a star), so a bucket of n
   classes gives n - 1 candidate pairs. Links are confirmed on the full sets.
4. A star can miss a link between two classes of which neither is the centre. Buckets whose
   classes are still in different components are gone through in blocks: pairs across
   components are compared by signature, then by 32-bit sets, and what links two components
   is confirmed on the full sets too. A member of such a bucket goes once to each block of
   others that it must meet (the largest component never meets itself), so rows grow
   with the members times the blocks on the other side, and only there; no pairs are emitted
   but links. A block has about BLOCK members and BLOCK_SHINGLES shingles at most, so that two
   of them fit in a task however long their texts are (a longer text is a block of its own size). The result is that of all pairs which share a bucket, less those of a block whose
   signatures rule them out: 160 bins that estimate SLACK below the limit, five standard
   errors, which a pair at the limit does with a chance of about 2e-7.

32 bands of 5 rows: two sets of similarity 0.8 share no bucket with a chance of 3e-6.

Defined cases: a null, empty or blank text has an empty set and no links; a text with fewer
words than a shingle is one shingle; rows that repeat a doc_id are one node with the links
of all its texts; a null doc_id has no links and no component; equal similarity counts as a
link; an empty table gives none. A very long text is hashed whole in one task. Other columns of
docs, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, skew_join, stored
from .components import components
from .sketch import OnePermutation, Words, band_hashes, shingles, short

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 5
#: Classes of one bucket that are compared by signature in one go.
BLOCK = 1000
#: Shingles (4 bytes each) of the members of a block.
BLOCK_SHINGLES = 4_000_000
#: The estimate from 160 bins has a standard error of at most 0.032 near 0.8: five of them.
SLACK = 0.16
#: Up to so many ids (8 bytes each) are broadcast to pick their texts; more meet them in a shuffle.
BROADCAST_IDS = 2_000_000
#: Members that meet one copy of their centre's text.
MEMBERS = 100


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    oph, words = OnePermutation(BANDS * ROWS), Words()
    for batch in batches:
        counts, ids, bands, sigs = [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            s = shingles(text or b"", size, words)
            counts.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()))
            if len(s):
                values = oph(s)
                bands.append(band_hashes(values, ROWS).view(np.int64))
                sigs.append(short(values).tobytes())
            else:
                bands.append(None)
                sigs.append(None)
        halves = np.frombuffer(b"".join(ids), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (v, part, u, text) sorted by the first three; the centre's own have a null u and
    come first. Only the sets of one centre are held."""
    words = Words()
    group, centre = None, []
    for batch in batches:
        us, vs = [], []
        for v, part, u, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            if (v, part) != group:
                group, centre = (v, part), []
            s = shingles(text, size, words)
            if u is None:
                centre.append(s)
                continue
            for other in centre:
                both = len(np.intersect1d(s, other, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(other) - both):
                    us.append(u)
                    vs.append(v)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _outlined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, bands, sig, set): the set's hashes cut to 32 bits."""
    oph, words = OnePermutation(BANDS * ROWS), Words()
    for batch in batches:
        rows, ids = [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            s = shingles(text, size, words)
            if not len(s):
                continue  # a blank text that repeats the doc_id of another
            values = oph(s)
            ids.append(id_)
            rows.append((len(s), band_hashes(values, ROWS).tobytes(), short(values).tobytes(), np.unique((s >> np.uint64(32)).astype("<u4")).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], names=["id", "n", "bands", "sig", "set"])


class _Union(dict):
    """Components that links of one block have joined."""

    def root(self, x: int) -> int:
        while self.get(x, x) != x:
            x = self[x]
        return x


def _linked_in_block(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links across components between two parts of a bucket. Each pair is looked at in the
    first bucket that it shares, by signature and then by its 32-bit sets; once a link joins
    two components, their other pairs are left out, so there are fewer links than rows."""
    bucket, i, j = rows[0][:3]
    left = [r for r in rows if r[3] == i]
    right = left if i == j else [r for r in rows if r[3] == j]
    if not left or not right:
        return
    least = int((percent / 100 - SLACK) * BANDS * ROWS)
    sig = np.frombuffer(b"".join(r[8] for r in right), dtype="<u2").reshape(len(right), -1)
    bands = np.frombuffer(b"".join(r[7] for r in right), dtype="<i8").reshape(len(right), -1)
    ids, comp, n = (np.array([r[k] for r in right], dtype=np.int64) for k in (4, 5, 6))
    sets = [np.frombuffer(r[9], dtype="<u4") for r in right]
    joined = _Union()
    for r in left:
        near = np.flatnonzero((comp != r[5]) & (100 * np.minimum(n, r[6]) >= percent * np.maximum(n, r[6])) & ((ids > r[4]) | (i != j)))
        if not len(near):
            continue
        agree = (sig[near] == np.frombuffer(r[8], dtype="<u2")).sum(axis=1)
        near = near[agree >= least]
        own = np.frombuffer(r[7], dtype="<i8")
        near = near[own[(bands[near] == own).argmax(axis=1)] == bucket]
        mine = np.frombuffer(r[9], dtype="<u4")
        for k in near.tolist():
            a, b = joined.root(r[5]), joined.root(int(comp[k]))
            if a == b:
                continue
            both = len(np.intersect1d(mine, sets[k], assume_unique=True))
            likeness = 100 * both / (len(mine) + len(sets[k]) - both)
            if likeness >= percent - 1:  # 32 bits may err by a shingle; full sets decide
                if likeness >= percent + 1:
                    joined[max(a, b)] = min(a, b)
                yield r[4], int(ids[k])


def _missed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, block, id, comp, n, bands, sig, set) sorted by the first three."""
    held: list[tuple] = []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][:3] != row[:3]:
                found += _linked_in_block(held, percent)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
    if held:
        found = list(_linked_in_block(held, percent))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (doc_id, text) with the ids in doc_id; ids should be stored and distinct."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The stored pairs (u, v) that are links. The text of a centre v goes once to each part of
    MEMBERS of its members, theirs once for each centre."""
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "candidate-ids")
    wanted = stored(_texts_of(ids, texts), "candidates")
    sizes = stored(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")), "centres")
    dealt = skew_join(pairs, sizes, ["v"], "n", ["u"]).select("v", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), "u")
    members = dealt.join(wanted.withColumnRenamed("doc_id", "u"), "u").select("v", "part", "u", "text")
    centres = sizes.join(wanted.withColumnRenamed("doc_id", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("u"), "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = centres.unionByName(members).repartition(parts, "v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    links = stored(grouped.mapInArrow(lambda it: _confirmed(it, size, percent), "u long, v long").distinct(), "links")
    discard(ids, wanted, sizes)
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs: 100 * intersection
    >= percent * union links two documents, and a component keeps its smallest doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sigs = stored(texts.mapInArrow(lambda it: _signed(it, shingle), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary"), "signatures")
    members = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(members.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")), "classes")
    heads = members.join(classes.select("s1", "s2", F.col("id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    buckets = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("weight"), F.explode("bands").alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre < last").select("bucket", "centre")
    shared = stored(buckets.join(stars, "bucket"), "buckets")
    first = stored(shared.filter("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct(), "stars")
    links = _confirm(first, texts, shingle, percent)
    # A doc_id that repeats is one node: it ties the classes of all its texts together.
    several = members.groupBy("doc_id").agg(F.min("s1").alias("a1"), F.max("s1").alias("b1"), F.min("s2").alias("a2"), F.max("s2").alias("b2")).filter("a1 <> b1 OR a2 <> b2").select("doc_id")
    tied = members.join(several, "doc_id", "left_semi").select("s1", "s2", "doc_id").distinct().join(classes, ["s1", "s2"])
    links = stored(links.unionByName(tied.filter("id <> doc_id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))), "tied")
    found = stored(components(links), "components")

    # The links that stars missed, between classes of a bucket that are still apart. The
    # bucket's largest component need not be compared with itself: its blocks only meet the
    # blocks of the others.
    apart = stored(shared.join(found, "id", "left").select("bucket", "id", "weight", F.coalesce("component", "id").alias("comp")), "apart")
    held = apart.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
    mixed = held.groupBy("bucket").agg(F.sum("c").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("c", "comp", "w")).alias("main")).filter("size > 2 AND main.c < size")
    blocks = lambda c, w: F.least(F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)), c).cast("int")
    few = blocks(F.col("size") - F.col("main.c"), F.col("weight") - F.col("main.w"))
    mixed = mixed.select("bucket", F.col("main.comp").alias("main"), few.alias("few"), blocks(F.col("main.c"), F.col("main.w")).alias("many"))
    rows = stored(apart.drop("weight").join(mixed, "bucket"), "mixed")
    ids = stored(rows.select(F.col("id").alias("doc_id")).distinct(), "mixed-ids")
    outlines = _texts_of(ids, texts).select("doc_id", "text").mapInArrow(lambda it: _outlined(it, shingle), "id long, n long, bands binary, sig binary, set binary")
    main = F.col("comp") == F.col("main")
    block = F.when(main, F.col("few") + F.pmod(F.xxhash64("id"), F.col("many")).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.col("few")).cast("int"))
    others = F.sequence(F.lit(0), F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    placed = rows.join(outlines, "id").withColumn("block", block).withColumn("other", F.explode(others))
    placed = placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "bands", "sig", "set")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = placed.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lambda it: _missed(it, percent), "u long, v long")
    tried = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = stored(more.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "missed")
    discard(ids, rows, apart)
    if not more.isEmpty():
        late = _confirm(more, texts, shingle, percent)
        if not late.isEmpty():
            found = stored(components(links.unionByName(late)), "components")

    named = classes.join(found, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    whole = sigs.withColumn("_member", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    out = whole.select("doc_id", "n_shingles", "s1", "s2", "_member").join(named.withColumn("_member", F.lit(True)), ["s1", "s2", "_member"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), documents.doc_id) AS component_id,
       coalesce(min(r.c), documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.d = documents.doc_id GROUP BY documents.doc_id
"""
