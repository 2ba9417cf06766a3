"""Quality rules: per-document base rules and cross-document line frequency.

Only DataFrame functions are used. Lines are normalised (ASCII white space stripped at both
ends and A-Z lower-cased), hashed, and counted as distinct documents per host. A line above
the limits is boilerplate of its host: it is removed from every document but the first
(smallest doc_id) that holds it. A document of which too little stays is rejected.

Defined cases: a null text is empty and a null host is a host of its own; rows that repeat a
doc_id are one document, for lines and for hosts; a row with a null doc_id counts as no document
and never holds a line first, but loses lines like any other; equal rows get equal results; a
document without removed lines is never rejected by the line rule; an empty table gives an empty
table. The work on a text is in proportion to its length (its windows are sorted), however many
lines it has. Of docs, columns named as a result column give way to it; any others pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, columns_but, free_names, let, read, skew_join, stored, without, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: A line is over the limits from this many documents of its host and this share of them; a line
#: in MAX_LINE_DOCS documents is, however large the host.
MIN_LINE_DOCS = 20
MIN_LINE_SHARE = 0.05
MAX_LINE_DOCS = 1000
#: A document is depleted if less than this share of its code points stays.
MIN_KEPT_SHARE = 0.3


def repeated_window_words(words: Column, bits: Column, window: int = 3, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Words that lie in a window of so many words which the text holds twice or more.

    Each window becomes one long: its hash above, its position in the low bits, as many as
    the text needs. After one sort of longs, equal windows are neighbours. Neighbours of equal
    hash are compared word by word; if any two differ, the windows are sorted by their words.
    """

    def covered(places: Column) -> Column:
        far, none = F.lit(window).cast("long"), F.lit(0).cast("long")
        return F.aggregate(
            places,
            F.struct(none.alias("n"), F.lit(-window).cast("long").alias("at")),
            lambda acc, p: F.struct((acc["n"] + F.least(far, p - acc["at"])).alias("n"), p.alias("at")),
        )["n"]

    def twice(s: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
        equal = lambda x, j: F.coalesce(same(x, F.get(s, j)), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: equal(x, i + 1) | equal(x, i - 1)), place))

    key = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    word = lambda x, k: F.get(words, place(x).cast("int") + k)

    def differ(x: Column, y: Column) -> Column:
        out = word(x, 0) != word(y, 0)
        for k in range(1, window):
            out = out | (word(x, k) != word(y, k))
        return out

    def by_hash(s: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: (key(F.get(s, i)) == key(F.get(s, i - 1))) & differ(F.get(s, i), F.get(s, i - 1)))
        return F.when(clash, let(by_words, lambda w: covered(twice(w, lambda x, y: x["w"] == y["w"], lambda x: x["i"])))).otherwise(covered(twice(s, lambda x, y: key(x) == key(y), place)))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    at = lambda i: [F.get(words, i + k) for k in range(window)]
    by_words = F.array_sort(F.transform(starts, lambda i: F.struct(F.array(*at(i)).alias("w"), i.cast("long").alias("i"))))
    coded = F.transform(starts, lambda i: F.call_function("shiftleft", hashed(*at(i)), bits).bitwiseOR(i.cast("long")))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(F.sort_array(coded), by_hash))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    own = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: ascii_strip(x) != "")

    def counted(words: Column) -> Column:
        n = F.size(words).cast("long")
        repeated = let(F.length(F.bin(n)), lambda bits: repeated_window_words(words, bits))
        return let(repeated, lambda r: F.struct(
            n.alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), r.alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        ))

    (m,) = free_names(docs, "_m")
    measured = docs.withColumn(m, let(words_of(F.col("text")), counted))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return measured.select(
        *columns_but(docs, names),
        f"{m}.n_words",
        f"{m}.word_chars",
        F.when(own.rlike(SYMBOLS), F.regexp_count(own, F.lit(SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        f"{m}.n_repeat_words",
        f"{m}.base_failed",
    )


def line_frequency(docs: DataFrame, host: str = "source", min_docs: int = MIN_LINE_DOCS, min_share: float = MIN_LINE_SHARE, max_docs: int = MAX_LINE_DOCS, min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """docs with removed_lines, removed_chars, depleted and clean_text.

    Occurrences are counted first, a partial aggregate by host and 128-bit hash: a line of a third
    of all documents costs one row from each task. Only lines that this leaves over the limits have
    their distinct documents counted, and only those meet their documents again, in a join on
    hashes that deals out common lines. Texts move only if clean_text is asked for.
    """
    own = F.coalesce(F.col("text"), F.lit(""))
    doc, key = F.col("doc_id").alias("_id"), F.xxhash64(own).alias("_key")
    host_ = F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host")
    line = ["_host", "_h1", "_h2"]
    split = docs.select(doc, host_, key, F.posexplode(F.split(own, "\n", -1)).alias("_pos", "_line"))
    normal = split.select("_id", "_host", "_key", "_pos", F.char_length("_line").alias("_chars"), ascii_strip("_line").alias("_line")).filter("_line <> ''").withColumn("_line", ascii_lower(F.col("_line")))
    lines = normal.select("_id", "_host", "_key", "_pos", "_chars", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))
    hosts = docs.select(doc, host_).groupBy("_host").agg(F.count_distinct("_id").alias("_docs"))
    limit = F.greatest(F.lit(min_docs), F.least(min_share * F.col("_docs"), F.lit(max_docs)))
    counted = lines.groupBy(*line).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).filter(F.col("_n") >= min_docs)
    maybe = stored(counted.join(hosts, "_host").filter(F.col("_n") >= limit).select(*line, "_n", "_first", limit.alias("_limit")), "common-lines")
    hits = stored(skew_join(lines, maybe, line, "_n", ["_id", "_key", "_pos"]), "common-line-rows")
    held = hits.filter("_id IS NOT NULL").select(*line, "_id", "_limit").distinct()
    over = held.groupBy(*line).agg(F.count(F.lit(1)).alias("_docs"), F.min("_limit").alias("_limit")).filter("_docs >= _limit").select(*line)
    over = stored(maybe.select(*line, "_n").join(over, line), "boilerplate")
    gone = (
        skew_join(hits.drop("_n", "_limit"), over, line, "_n", ["_id", "_key", "_pos"]).filter(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_host", "_key").agg(F.sort_array(F.collect_set(F.struct("_pos", "_chars"))).alias("_gone"))
    )
    names = ("removed_lines", "removed_chars", "depleted", "clean_text")
    mine = dict(zip(("id", "host", "key", "chars", "gone"), free_names(docs, "_my_id", "_my_host", "_my_key", "_my_chars", "_my_gone"), strict=True))
    base = docs.withColumns({mine["id"]: doc, mine["host"]: host_, mine["key"]: key, mine["chars"]: F.char_length(own).cast("long")})
    found = gone.select("_id", "_host", "_key", F.col("_gone").alias(mine["gone"]))
    found = found.toDF(*free_names(base, "_id", "_host", "_key"), mine["gone"])
    same = F.col(mine["id"]).eqNullSafe(found[found.columns[0]])
    for a, b in (("host", 1), ("key", 2)):
        same = same & (F.col(mine[a]) == found[found.columns[b]])
    joined = base.join(found, same, "left")
    lost, chars = F.col(mine["gone"]), F.col(mine["chars"])
    removed = F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x["_chars"]), F.lit(0).cast("long"))
    stays = without(F.split(own, "\n", -1), F.col(f"{mine['gone']}._pos"))
    return joined.select(
        *columns_but(docs, names),
        F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long").alias("removed_lines"),
        removed.alias("removed_chars"),
        ((removed > 0) & (chars - removed < min_kept * chars)).alias("depleted"),
        F.when(lost.isNull(), own).otherwise(stays).alias("clean_text"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_frequency(base_rules(docs))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "removed_lines", "removed_chars",
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g2) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (SELECT doc_id, host, line,
              translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line)) AS n FROM l2 WHERE k <> '' GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
f AS (SELECT host, k, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM l2 WHERE k <> '' GROUP BY host, k),
o AS (SELECT f.host, f.k, f.first FROM f JOIN h USING (host) WHERE f.n >= 20 AND f.n >= least(0.05 * h.n, 1000)),
r AS (SELECT l2.doc_id, count(*) AS n, sum(length(l2.line)) AS chars
      FROM l2 JOIN o ON l2.host = o.host AND l2.k = o.k WHERE l2.doc_id <> o.first GROUP BY l2.doc_id),
a AS (SELECT d.doc_id, m.n_words, m.word_chars,
             length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             coalesce(r.n, 0) AS removed_lines, coalesce(r.chars, 0) AS removed_chars, length(d.text) AS chars
      FROM d JOIN m USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (removed_chars > 0 AND chars - removed_chars < 0.3 * chars) AS kept,
       removed_lines, removed_chars
FROM a
"""
