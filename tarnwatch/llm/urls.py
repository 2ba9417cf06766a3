"""URL rules, and trust that spreads over the link graph of hosts.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest
fitting one decides. Where none fits, the host's place in the link graph does: trust is a
personalised PageRank from hosts of mostly allowed pages along links, distrust one from hosts
of mostly blocked pages against them (who links to a blocked host is suspect). A host is blocked
if distrust has at least SHARE of the two.

Both walks are joins and sums over host edges, one table in the shared folder for each step.
They go on until every host is reached and no rank moves, however far the hosts lie from the
seeds. A host with very many links gives one row from each task to each sum.

Defined cases: a null url or one without :// has an empty host and path, fits no rule and is
allowed; a null html has no links; links of a host to itself don't count; equal rows get
equal verdicts; hosts that neither walk reaches are allowed; of two fitting rules of equal length
the later one in the list decides; a very long html is searched whole for links; an empty table
gives an empty table. Of pages, columns named as a result column give way to it; any others pass
through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, columns_but, discard, free_names, read, stored

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
#: A walk ends where a step adds less than this share to the rank of every host it comes to.
TOLERANCE = 1e-6
#: After so many steps what is left of a walk is below TOLERANCE of the smallest double.
STEPS = math.ceil((math.log(TOLERANCE) + math.log(5e-324)) / math.log(DAMPING))
SHARE = 0.5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): weight is the number of links between two different hosts."""
    found = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("link")).withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select("src", host_of(F.col("link")).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) from seeds (host, mass). What ends in a host without links starts anew at
    the seeds. Hosts that the walk doesn't reach have no row.

    The rank is the sum over all walks from the seeds, each step damped, divided by its total.
    A step to a host not met before adds the whole of its rank, so the walk can't end before
    all are reached; once every addition is below the tolerance, all later ones are."""
    total = seeds.agg(F.sum("mass")).first()[0]
    start = stored(seeds.filter("mass > 0").select("host", (F.col("mass") / (total or 1.0)).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")), "flow")
    rank = start.select("host", F.col("seed").alias("rank"))
    if flow.isEmpty() or not total:
        return rank
    walk, done = rank.withColumn("come", F.col("rank")), None
    for _ in range(steps):
        moved = flow.join(walk.filter("come > 0"), flow.src == walk.host).groupBy("dst").agg((damping * F.sum(F.col("part") * F.col("come"))).alias("come"))
        moved = moved.withColumnRenamed("dst", "host").join(walk.select("host", "rank"), "host", "full")
        come = F.coalesce("come", F.lit(0.0))
        walk = stored(moved.select("host", (F.coalesce("rank", F.lit(0.0)) + come).alias("rank"), come.alias("come")), "walk")
        if done is not None:
            discard(done)
        done = walk
        most, whole = walk.agg(F.max(F.try_divide("come", "rank")), F.sum("rank")).first()
        if (most or 0.0) < tolerance:
            return walk.select("host", (F.col("rank") / whole).alias("rank"))
    raise RuntimeError("ranks did not settle")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """pages with host, path, rule and verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    h, p, rule, bad_host = free_names(pages, "_h", "_p", "_rule", "_bad")
    ruled = pages.withColumns({h: host, p: path, rule: matched_rule(host, path, rules)})
    # One row for each host from each task. A host is a seed if rules of one kind decide at
    # least half of its pages; its mass is their number.
    count = lambda c: F.sum(F.coalesce(c.cast("double"), F.lit(0.0)))
    good, bad = count(F.col(f"{rule}.verdict") == "allow"), count(F.col(f"{rule}.verdict") == "block")
    hosts = ruled.filter(F.col(h) != "").groupBy(F.col(h).alias("host")).agg(good.alias("good"), bad.alias("bad"), F.count(F.lit(1)).alias("n"))
    seed = lambda c: F.when(2 * F.col(c) >= F.col("n"), F.col(c)).otherwise(0.0).alias(c)
    seeds = stored(hosts.filter("good + bad > 0").select("host", seed("good"), seed("bad")), "seeds")
    edges = stored(host_edges(pages), "edges")
    trust = personalised_rank(edges, seeds.select("host", F.col("good").alias("mass"))).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(back, seeds.select("host", F.col("bad").alias("mass"))).withColumnRenamed("rank", "distrust")
    ranks = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    bad = ranks.filter((F.col("distrust") > 0) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust")))).select(F.col("host").alias(bad_host))
    # Hosts alone can be joined to pages in full; a host of many pages is split by adaptive execution.
    out = ruled.join(bad, F.col(h) == F.col(bad_host), "left")
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(bad_host).isNotNull(), "block").otherwise("allow"))
    return out.select(*columns_but(pages, ("host", "path", "rule", "verdict")), F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The query in DuckDB SQL. A walk is a recursion over steps, each an aggregate of the one
    before; after 250 steps the rest of it is below 1e-17."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: lower(f"regexp_extract(coalesce({x}, ''), '^(?s:.*?)://([^/?#]*)', 1)")
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits.append((f"(host = {q(name)} OR ends_with(host, {q('.' + name)})) AND starts_with(path, {q('/' + rest)})", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN {q(f[k])}" for f in fits) + " END"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {host("url")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, {case(1)} AS rule, {case(2)} AS vd FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (vd = 'allow') AS g, count(*) FILTER (vd = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
seed AS (SELECT 't' AS k, host, g::DOUBLE AS m FROM h WHERE g > 0 AND 2 * g >= n UNION ALL SELECT 'd', host, b::DOUBLE FROM h WHERE b > 0 AND 2 * b >= n),
ln AS (SELECT host AS src, unnest(regexp_extract_all(html, {q(LINK)}, 1)) AS link FROM p WHERE host <> ''),
e0 AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM ln) WHERE dst <> '' AND src <> dst GROUP BY ALL),
e AS (SELECT 't' AS k, src AS a, dst AS b, w FROM e0 UNION ALL SELECT 'd', dst, src, w FROM e0),
f AS (SELECT k, a, b, w / sum(w) OVER (PARTITION BY k, a) AS part FROM e),
z AS (SELECT k, host, m / sum(m) OVER (PARTITION BY k) AS come, 0 AS step FROM seed UNION ALL
  SELECT z.k, f.b, {DAMPING} * sum(z.come * f.part), max(z.step) + 1 FROM z JOIN f ON f.k = z.k AND f.a = z.host WHERE z.step < 250 GROUP BY z.k, f.b),
rk AS (SELECT k, host, sum(come) AS c FROM z GROUP BY ALL), rn AS (SELECT k, host, c / sum(c) OVER (PARTITION BY k) AS r FROM rk),
td AS (SELECT host, coalesce(max(r) FILTER (k = 't'), 0) AS t, coalesce(max(r) FILTER (k = 'd'), 0) AS d FROM rn GROUP BY host),
bad AS (SELECT host FROM td WHERE d > 0 AND d >= {SHARE} * (t + d))
SELECT page_id, host, path, rule, coalesce(vd, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


OP7_SQL = _sql()
