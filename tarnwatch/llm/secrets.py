"""Secret scan: patterns, and a randomness test battery over encoded-looking tokens.

Only DataFrame functions are used. Base spans come from three patterns. The method looks at
tokens of 20 characters or more whose alphabet can be inferred (hex, base32, base36, base64;
a letter and a digit at least, base64 also in both cases) and tests the hypothesis that their
characters are drawn uniformly: chi-squared over the alphabet, a runs test about the middle
of the alphabet, and lag-one serial correlation, combined by Fisher's rule. Within strata of
encoding and length, Benjamini-Hochberg at FDR_Q rejects the tokens that are not random, with
p-values rounded up to 1/10000, so that a stratum's ranks come from at most 10,001 counts.
A token that is not rejected and is long enough for its alphabet for the battery to have
power is reported, unless a base span overlaps it.

The control is on what the battery discards: in each stratum, of the tokens taken for not random
at most FDR_Q are random on average, so few secrets are lost. What is reported is the rest; how
much of it isn't random depends on the text and isn't bounded by the control. README has the
shares of planted tokens of both kinds.

Defined cases: a null text is empty and has no spans; rows that repeat a document count each
in the strata and get the same spans; spans of equal start come by kind; an empty table gives an
empty table. The work on a text is in proportion to its length and its number of matches. Of
docs, columns named as a result column give way to it; any others pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, free_names, let, read, scan, stored

#: (kind, pattern, group that is measured, its least length)
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches or a superset of the documents that have them, quicker to look for.
QUICK = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR_Q = 0.1
GRAIN = 10_000
#: encoding -> (condition on the token without padding, alphabet, least length reported)
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 24),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 24),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 24),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 24),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
)
LENGTHS = (32, 48, 80)
#: Code points of the chunks that redacted() takes pieces from.
CHUNK = 1024
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _located(text: Column, pattern: str, quick: str, kind: int, group: int = 0, least: int = 0, token: bool = False) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points. What lies between
    the matches and the matches themselves, in turn, add up to the offsets."""
    found = F.struct(
        F.split(text, pattern, -1).alias("a"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("b"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("c"),
    )

    def spans(f: Column) -> Column:
        gap = lambda i: F.char_length(F.get(f["a"], i))
        before = scan(F.transform(f["b"], lambda m, i: gap(i) + F.char_length(m)), F.lit(0), lambda x, y: x + y)

        def span(m: Column, i: Column, at: Column) -> Column:
            return F.struct((at + gap(i)).alias("start"), F.lit(kind).alias("kind"), (at + gap(i) + F.char_length(m)).alias("end"), *([m.alias("token")] if token else []))

        every = let(before, lambda at: F.transform(f["b"], lambda m, i: span(m, i, F.get(at, i))))
        return F.filter(every, lambda _, i: F.char_length(F.get(f["c"], i)) >= least)

    none = F.array().cast(f"array<struct<start:int,kind:int,end:int{',token:string' if token else ''}>>")
    return F.when(text.rlike(quick), let(found, spans)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational formula 26.2.17 of Abramowitz and Stegun (error below 8e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (with a column token) whose encoding can be inferred, with encoding, n, p_chi,
    p_runs, p_serial and their combination p."""
    body = F.regexp_replace("token", "=+$", "")
    df = tokens.withColumn("_body", body)
    pick = lambda values: F.coalesce(*[F.when(F.col("_body").rlike(rule), F.lit(v)) for (_, rule, _, _), v in zip(ENCODINGS, values, strict=True)])
    df = df.withColumn("encoding", pick([e[0] for e in ENCODINGS])).filter("encoding IS NOT NULL")
    df = df.withColumn("_alphabet", pick([e[2] for e in ENCODINGS])).withColumn("least", pick([e[3] for e in ENCODINGS]))
    df = df.withColumn("n", F.char_length("_body")).withColumn("_k", F.char_length("_alphabet").cast("double"))
    df = df.withColumn("_x", F.transform(F.split("_body", ""), lambda c: F.call_function("locate", c, F.col("_alphabet")).cast("double")))
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    counts = F.transform(F.array_distinct("_x"), lambda v: F.size(F.filter("_x", lambda x: x == v)).cast("double"))
    df = df.withColumn("_chi", F.col("_k") / F.col("n") * square(counts) - F.col("n"))
    df = df.withColumn("_high", F.transform("_x", lambda x: (x > F.col("_k") / 2).cast("int")))
    df = df.withColumn("_c", let(total(F.col("_x")) / F.col("n"), lambda mean: F.transform("_x", lambda x: x - mean)))
    pairs = F.sequence(F.lit(0), F.col("n") - 2)
    df = df.withColumn("_runs", 1 + total(F.transform(pairs, lambda i: (F.get("_high", i) != F.get("_high", i + 1)).cast("double"))))
    df = df.withColumn("_r", total(F.transform(pairs, lambda i: F.get("_c", i) * F.get("_c", i + 1)))).withColumn("_s", square(F.col("_c")))
    n, k = F.col("n").cast("double"), F.col("_k")
    n1 = F.aggregate("_high", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_n1", n1).withColumn("_mu", 2 * F.col("_n1") * (n - F.col("_n1")) / n + 1)
    wilson = (F.pow(F.col("_chi") / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    spread = (F.col("_mu") - 1) * (F.col("_mu") - 2) / (n - 1)
    runs = F.when(spread > 0, F.abs(F.col("_runs") - F.col("_mu")) / F.sqrt(spread)).otherwise(F.lit(9.0))
    serial = F.when(F.col("_s") > 0, F.abs(F.try_divide(F.col("_r"), F.col("_s")) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    floor = lambda p: F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))
    df = df.withColumn("p_chi", floor(_upper_tail(wilson))).withColumn("p_runs", floor(2 * _upper_tail(runs))).withColumn("p_serial", floor(2 * _upper_tail(serial)))
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))
    df = df.withColumn("_half", half).withColumn("p", F.exp(-F.col("_half")) * (1 + F.col("_half") + F.col("_half") * F.col("_half") / 2))
    return df.select(*tokens.columns, "encoding", "least", "n", "p_chi", "p_runs", "p_serial", "p")


def looks_random(tested: DataFrame, q: float = FDR_Q) -> DataFrame:
    """The rows of battery() that Benjamini-Hochberg does not reject in their stratum."""
    from pyspark.sql import Window

    stratum = sum(((F.col("n") >= x).cast("int") for x in LENGTHS), F.lit(0))
    df = tested.withColumn("_stratum", stratum).withColumn("_bin", F.ceil(F.col("p") * GRAIN).cast("int"))
    # At most 7 encodings x 4 lengths x 10,001 bins, whatever the input.
    bins = df.groupBy("encoding", "_stratum", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy("encoding", "_stratum")
    ranked = bins.withColumn("_rank", F.sum("_c").over(by.orderBy("_bin"))).withColumn("_m", F.sum("_c").over(by))
    cut = ranked.groupBy("encoding", "_stratum").agg(F.max(F.when(F.col("_bin") * F.col("_m") <= q * GRAIN * F.col("_rank"), F.col("_bin")).otherwise(-1)).alias("_cut"))
    return df.join(F.broadcast(cut), ["encoding", "_stratum"]).filter("_bin > _cut AND n >= least").select(*tested.columns)  # 28 rows at most


def find_secrets(docs: DataFrame, q: float = FDR_Q) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, kind, end) by start, then kind; kinds
    are numbers in KINDS, offsets are code points and ends are exclusive."""
    own = F.coalesce(F.col("text"), F.lit(""))
    base_arrays = [_located(own, pattern, QUICK[kind], i, group, least) for i, (kind, pattern, group, least) in enumerate(BASE)]
    doc, key, held, doc_r, key_r, more = free_names(docs, "_id", "_key", "_base", "_id_r", "_key_r", "_more")
    base = docs.withColumns({doc: F.col("doc_id"), key: F.xxhash64(own), held: F.array_sort(F.concat(*base_arrays))})
    # Each token starts a row of its own; a document gets its tokens back in one aggregate.
    tokens = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(own).alias("_key"), F.inline(_located(own, TOKEN, TOKEN, KINDS.index("random"), token=True)))
    random = looks_random(stored(battery(tokens), "tokens"), q)
    found = random.groupBy(F.col("_id").alias(doc_r), F.col("_key").alias(key_r)).agg(F.collect_set(F.struct("start", "kind", "end")).alias(more))
    out = base.join(found, F.col(doc).eqNullSafe(F.col(doc_r)) & (F.col(key) == F.col(key_r)), "left")
    spans = F.when(F.col(more).isNull(), F.col(held)).otherwise(_free(F.array_sort(F.concat(held, more))))
    return out.select(*columns_but(docs, ("base_spans", "spans")), F.col(held).cast(SPANS).alias("base_spans"), spans.cast(SPANS).alias("spans"))


def _free(spans: Column) -> Column:
    """Sorted spans without the random ones that overlap a base span."""
    far = F.lit((1 << 31) - 1)

    def build(s: Column) -> Column:
        base = lambda x: x["kind"] < KINDS.index("random")
        reach = scan(F.transform(s, lambda x: F.when(base(x), x["end"]).otherwise(0)), F.lit(0), F.greatest)
        after = F.reverse(scan(F.transform(F.reverse(s), lambda x: F.when(base(x), x["start"]).otherwise(far)), far, F.least))
        return let(F.struct(reach.alias("reach"), after.alias("next")), lambda m: F.filter(s, lambda x, i: base(x) | (F.get(m["reach"], i) <= x["start"]) & (F.get(m["next"], i) >= x["end"])))

    return let(spans, build)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with its spans (sorted) replaced by a mark; spans that overlap share one. The text is
    cut into chunks once, so that a piece is found without a walk from the start."""

    def build(chunks: Column, ends: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            part = lambda j: F.substring(F.get(chunks, j), F.greatest(a - j * CHUNK, F.lit(0)) + 1, F.least(b - j * CHUNK, F.lit(CHUNK)) - F.greatest(a - j * CHUNK, F.lit(0)))
            return F.when(a >= b, F.lit("")).otherwise(F.array_join(F.transform(F.sequence((a / CHUNK).cast("int"), ((b - 1) / CHUNK).cast("int")), part), ""))

        cut = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(piece(F.get(ends, i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(cut, ""), piece(F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text)))

    reach = scan(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"), reach.alias("e"))
    return F.when(F.size(spans) < 1, text).otherwise(let(both, lambda x: build(x["c"], x["e"])))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The query in DuckDB SQL, from the same constants."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def located(name: str, pattern: str, group: int) -> str:
        return f"""{name}_m AS (SELECT doc_id, string_split_regex(t, {q(pattern)}) AS a, regexp_extract_all(t, {q(pattern)}) AS b, regexp_extract_all(t, {q(pattern)}, {group}) AS c FROM d WHERE regexp_matches(t, {q(pattern)})),
{name}_x AS (SELECT doc_id, b[i] AS tok, length(c[i]) AS gl, coalesce(list_sum(list_transform(a[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(b[1:i - 1], lambda z: length(z))), 0) AS st
  FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM {name}_m)),
"""

    def rule_sql(rule: str) -> str:
        looks = [r for r in rule.split("(?=.*")[1:]]
        body = looks[-1].partition(")")[2]
        return " AND ".join([f"regexp_matches(y, {q(x.partition(')')[0])})" for x in looks] + [f"regexp_matches(y, {q('^' + body)})"])

    pick = lambda f: "CASE " + " ".join(f"WHEN {rule_sql(e[1])} THEN {f(e)}" for e in ENCODINGS) + " END"
    parts = "".join(located(k, p, g) for k, p, g, _ in BASE) + located("tok", TOKEN, 0)
    base = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, st::BIGINT AS st, (st + length(tok))::BIGINT AS en FROM {k}_x WHERE gl >= {least}" for i, (k, _, _, least) in enumerate(BASE))
    tail = lambda z: f"CASE WHEN {z} >= 0 THEN exp(-{z} * {z} / 2) * 0.3989422804014327e0 * (1 / (1 + 0.2316419e0 * abs({z}))) * (0.319381530e0 + (1 / (1 + 0.2316419e0 * abs({z}))) * (-0.356563782e0 + (1 / (1 + 0.2316419e0 * abs({z}))) * (1.781477937e0 + (1 / (1 + 0.2316419e0 * abs({z}))) * (-1.821255978e0 + (1 / (1 + 0.2316419e0 * abs({z}))) * 1.330274429e0)))) ELSE NULL END"
    upper = lambda z: f"CASE WHEN {z} >= 0 THEN {tail(z)} ELSE 1 - {tail('(-' + z + ')')} END"
    kinds = "['" + "', '".join(KINDS) + "']"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{parts}base AS ({base}),
y AS (SELECT *, regexp_replace(tok, '=+$', '') AS y FROM tok_x),
e AS (SELECT *, {pick(lambda e: q(e[0]))} AS enc, {pick(lambda e: q(e[2]))} AS al, {pick(lambda e: str(e[3]))} AS least FROM y),
f AS (SELECT doc_id, st, tok, enc, least, length(y)::DOUBLE AS n, length(al)::DOUBLE AS k, list_transform(string_split(y, ''), lambda c: strpos(al, c)::DOUBLE) AS x FROM e WHERE enc IS NOT NULL),
g AS (SELECT *, k / n * list_sum(list_transform(list_distinct(x), lambda v: pow(len(list_filter(x, lambda z: z = v)), 2)::DOUBLE)) - n AS chi,
  list_sum(list_transform(x, lambda v: (v > k / 2)::INT))::DOUBLE AS n1, list_sum(x) / n AS mean FROM f),
h AS (SELECT *, list_transform(x, lambda v: v - mean) AS c, 2 * n1 * (n - n1) / n + 1 AS mu, 1 + list_sum(list_transform(range(1, n::BIGINT), lambda i: ((x[i] > k / 2) <> (x[i + 1] > k / 2))::INT))::DOUBLE AS runs FROM g),
s AS (SELECT *, (mu - 1) * (mu - 2) / (n - 1) AS spread, list_sum(list_transform(range(1, n::BIGINT), lambda i: c[i] * c[i + 1])) AS r, list_sum(list_transform(c, lambda v: v * v)) AS s FROM h),
z AS (SELECT *, (pow(chi / (k - 1), 1e0 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1, CASE WHEN spread > 0 THEN abs(runs - mu) / sqrt(spread) ELSE 9e0 END AS z2,
  CASE WHEN s > 0 THEN abs(r / s + 1 / n) * sqrt(n) ELSE 9e0 END AS z3 FROM s),
p AS (SELECT *, -(ln(least(greatest({upper('z1')}, 1e-15), 1)) + ln(least(greatest(2 * {upper('z2')}, 1e-15), 1)) + ln(least(greatest(2 * {upper('z3')}, 1e-15), 1))) AS half FROM z),
b AS (SELECT doc_id, st, tok, enc, least, n, {" + ".join(f"(n >= {x})::INT" for x in LENGTHS)} AS str, ceil(exp(-half) * (1 + half + half * half / 2) * {GRAIN})::INT AS bin FROM p),
w AS (SELECT enc, str, bin, sum(count(*)) OVER (PARTITION BY enc, str ORDER BY bin) AS rk, sum(count(*)) OVER (PARTITION BY enc, str) AS m FROM b GROUP BY enc, str, bin),
cut AS (SELECT enc, str, max(CASE WHEN bin * m <= {FDR_Q * GRAIN} * rk THEN bin ELSE -1 END) AS cut FROM w GROUP BY enc, str),
more AS (SELECT DISTINCT doc_id, 3 AS k, st::BIGINT AS st, (st + length(tok))::BIGINT AS en FROM b JOIN cut USING (enc, str) WHERE bin > cut AND n >= least),
al AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = m.doc_id AND x.st < m.en AND m.st < x.en)),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(({kinds})[k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (k < 3) AS bs, string_agg(({kinds})[k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k) AS sp FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


OP8_SQL = _sql()
