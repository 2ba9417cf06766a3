"""Importance resampling towards a target distribution, scored without exploding texts.

A document's features are its words and pairs of neighbouring words, hashed into BUCKETS. Higher-order
functions make one array of bucket numbers from a text; only the totals of the buckets are
aggregated (at most BUCKETS rows a task are shuffled). The totals of the documents and of the
target give each bucket a gain, and a document's weight is the mean of the gains of its array,
looked up by element_at in one literal array. Gumbel noise from a hash of doc_id turns the
weights into a draw without replacement: the highest scores are drawn.

Texts are read twice, once for the totals and once for the weights; no text and no array of
buckets moves. Scores are whole numbers between about -47,000 and 67,000, however many documents there
are: a count for each score (under 120,000 rows) says where the draw ends and at which rank each
score begins, and only drawn rows are ordered, those of one score together.

Defined cases: a null or empty text has no words, no features and weight 0; a null doc_id hashes
as an empty one and comes after all others; rows that repeat a doc_id are documents of their own,
and of rows that are equal in all results each gets the next rank; texts are read whole; an empty
table gives an empty table, an empty target has total 0. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, read, stored

BUCKETS = 10_000
#: Words a drawn document has at least; per cent of such documents that are drawn.
LEAST_WORDS, DRAWN = 20, 25
SEED = 7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that repeat come out in steps of this many.
STEP = 1 << 16


def bucket_of(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("int")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def buckets_of(words: Column) -> Column:
    """The buckets of all words and pairs of neighbours, repeats included."""

    def build(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        two = F.zip_with(F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: bucket_of(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(w, bucket_of), two)

    return let(words, build)


def totals(texts: DataFrame, text: str = "text") -> list[int]:
    """How many features of all texts fall in each bucket."""
    buckets = texts.select(F.explode(buckets_of(words_of(F.col(text)))).alias("bucket"))
    out = [0] * BUCKETS
    for r in buckets.groupBy("bucket").count().collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["count"]
    return out


def gains(spark: SparkSession, source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the smoothed share in the target over that in the source), by bucket."""
    pairs = spark.createDataFrame(list(zip(range(BUCKETS), source, target, strict=True)), "bucket int, s long, t long")
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(sum(source) + BUCKETS)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(sum(target) + BUCKETS)))
    return [r["g"] for r in pairs.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("g")).orderBy("bucket").collect()]


def floored_mean(total: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(((total - F.pmod(total, n)) / F.greatest(n, F.lit(1))).cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel deviate, floored, from the hash of doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, by_bucket: list[int]) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features, weight, score."""
    # A literal array: split and cast are folded when the query is planned.
    table = F.split(F.lit(",".join(map(str, by_bucket))), ",").cast("array<int>")

    def weigh(w: Column) -> Column:
        def of(b: Column) -> Column:
            total = F.aggregate(b, F.lit(0).cast("long"), lambda a, i: a + F.element_at(table, i + 1))
            n = F.size(b).cast("long")
            return F.struct(F.size(w).alias("n_words"), n.alias("n_features"), floored_mean(total, n).alias("weight"))

        return let(buckets_of(w), of)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words_of(F.col("text")), weigh).alias("x"))
    return out.select("doc_id", "x.n_words", "x.n_features", "x.weight", (F.col("x.weight") + noise(F.col("doc_id"))).alias("score"))


def drawn(scored: DataFrame, per_cent: int = DRAWN, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (a stored table) with rank: 1, 2, ... for the drawn rows, by score and then doc_id."""
    able = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    by_score = scored.filter(able).groupBy("score").count().collect()  # whole numbers in a fixed range
    take = sum(r["count"] for r in by_score) * per_cent // 100
    starts, before = [], 0
    for r in sorted(by_score, key=lambda r: -r["score"]):
        if before >= take:
            break
        starts.append((r["score"], before))
        before += r["count"]
    if not starts:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    cut = starts[-1][0]
    near = able & (F.col("score") >= cut)
    equal = scored.filter(near).groupBy(*columns).count()
    spark = scored.sparkSession
    begins = F.broadcast(spark.createDataFrame(starts, "score long, before long"))
    w = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    placed = equal.withColumn("upto", F.sum("count").over(w)).join(begins, "score").withColumn("first", F.col("before") + F.col("upto") - F.col("count"))
    # Equal rows one by one, in steps, so that no array grows with them.
    steps = placed.withColumn("at", F.explode(F.expr(f"sequence(0L, (count - 1) div {STEP})")))
    each = steps.withColumn("at", F.explode(F.expr(f"sequence(at * {STEP}, least(count, (at + 1) * {STEP}) - 1)")))
    rank = F.col("first") + F.col("at") + 1
    ranked = each.select(*columns, F.when(rank <= take, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = DRAWN, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, text) drawn towards target (text): doc_id, n_features, weight, score, rank."""
    by_bucket = gains(docs.sparkSession, totals(docs), totals(target))
    return drawn(stored(weighed(docs, by_bucket), "resampling"), per_cent, least_words)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: crc32 by its rule: 256 table entries of eight steps each, then one step a byte.
OP13_SQL = """
WITH RECURSIVE crc_steps AS (
    SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
    UNION ALL
    SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM crc_steps WHERE k = 8),
worded AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
features AS (
    SELECT kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded
),
distinct_features AS (
    SELECT f, xor(list_reduce(
        [4294967295] || list_transform(range(1, len(hex(f)) // 2 + 1), lambda i: ('0x' || hex(f)[2 * i - 1 : 2 * i])::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM features), crc_table
),
counted AS (
    SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features JOIN distinct_features USING (f) GROUP BY bucket
),
sums AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counted),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM counted, sums
),
weights AS (
    SELECT id AS doc_id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
    FROM features JOIN distinct_features USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id
),
scored AS (
    SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM worded d LEFT JOIN weights ON weights.doc_id = d.id WHERE d.kind = 'd'
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""
