import random
import re
from collections import defaultdict

import pytest

from tarnwatch.llm.urls import DAMPING, OP7_SQL, RULES, STEPS, judge_urls, personalised_rank


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    best = None
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def rank(edges, mass):
    total = sum(mass.values())
    if not total:
        return {}
    seed = {h: m / total for h, m in mass.items() if m}
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    r = dict(seed)
    for _ in range(STEPS if edges else 0):
        come = defaultdict(float)
        for (a, b), w in edges.items():
            if a in r:
                come[b] += DAMPING * r[a] * w / out[a]
        left = 1 - sum(come.values())
        r = {h: come.get(h, 0) + seed.get(h, 0) * left for h in {*come, *seed}}
    return r


def brute(rows):
    edges, good, bad, n = (defaultdict(float) for _ in range(4))
    for _, url, html in rows:
        host, path = split(url)
        n[host] += 1
        if got := rule_of(host, path):
            (good if got[0] == "allow" else bad)[host] += 1
        for link in re.findall(r'href="((?:https?:)?//[^"]+)"', html or ""):
            to = split(link if "://" in link else "http:" + link)[0]
            if host and to and host != to:
                edges[host, to] += 1
    good, bad = ({h: m for h, m in x.items() if 2 * m >= n[h]} for x in (good, bad))
    trust, distrust = rank(edges, good), rank({(b, a): w for (a, b), w in edges.items()}, bad)
    out = []
    for page, url, _ in rows:
        host, path = split(url)
        got = rule_of(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        out.append((page, host, path, got and got[1], got[0] if got else "block" if d > 0 and d >= 0.5 * (t + d) else "allow"))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    link = lambda *urls: "".join(f'<a class="x" href="{u}">t</a>' for u in urls)
    rows = [
        (1, "http://WWW.Example.com/en/1?q#f", link("https://good.org/", "/rel", "//cdn.org/x")), (2, "https://example.com/en/x", None), (3, "https://a.net/es/1", link("http://spam.org/a")),
        (4, "http://spam.org/", link("https://a.net/es/2", "https://a.net/es/3")), (5, "http://linker.org/p", link("http://spam.org/")), (6, "http://good.org/p", link("http://other.org/")), (7, None, None),
        (8, "no scheme", ""), (9, "http://x.com", ""), (10, "http://x.com/", ""), (11, "http://com/", ""), (12, "http://other.org?x=://y/", ""), (13, "http://notexample.com/en/", ""),
        (14, "http://ÄB.org/É#", ""), (14, "http://ÄB.org/É#", ""), (15, "http://a.net/fr/" + "z" * 50000, link("http://good.org/")), (16, "http://cdn.org/", ""), (17, "http://long.org/", link("http://cdn.org/") * 3000), (18, "http://b.net/es/1", ""), (19, "http://b.net/1", ""), (20, "http://b.net/2", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS src", "1 AS rank")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()), key=str)
    assert got == brute(rows)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_ranks_sum_to_one_and_empty_table(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "d", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 3.0), ("z", 1.0), ("y", 0.0)], "host string, mass double")
    got = {r.host: r["rank"] for r in personalised_rank(edges, seeds).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and set(got) == {"a", "b", "c", "d", "z"}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_chain_beyond_any_fixed_number_of_steps(spark):
    n = 30
    name = lambda i: f"h{i}.org" if i else "a.net"
    rows = [(i, f"http://{name(i)}/es/1", f'<a href="http://{name(i - 1)}/x">t</a>' if i else None) for i in range(n)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(n), "block")


def test_ranks_are_those_of_the_settled_walk(spark):
    edges = {(f"h{i}", f"h{i + 1}"): 1.0 for i in range(25)} | {("h3", "h0"): 2.0, ("h25", "h9"): 1.0, ("h25", "end"): 3.0}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {r.host: r["rank"] for r in personalised_rank(df, spark.createDataFrame([("h0", 2.0), ("h5", 1.0)], "host string, mass double")).collect()}
    want = rank(edges, {"h0": 2.0, "h5": 1.0})
    assert set(got) == set(want) and all(abs(got[h] - want[h]) <= 1e-4 * want[h] for h in want)


def test_ranks_that_do_not_settle_are_refused(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        personalised_rank(edges, spark.createDataFrame([("a", 1.0)], "host string, mass double"), steps=3)


def graph():
    """A blocked and an allowed host, a chain of 45 behind each, a hub that 200 hosts link to and
    that links to both, hosts without links, and hosts on islands."""
    rng = random.Random(8)
    link = lambda *hosts: "".join(f'<p><a href="http://{h}/">t</a>' for h in hosts)
    rows = [("a.net/es/1", ""), ("www.example.com/en/1", link("good0.org", "hub.org")), ("hub.org/", link("a.net", "good0.org", "end.org") + link("leaf1.org") * 5)]
    rows += [(f"bad{i}.org/x", link(f"bad{i - 1}.org" if i else "a.net")) for i in range(45)]
    rows += [(f"good{i}.org/x", link(f"good{i + 1}.org")) for i in range(45)]
    rows += [(f"leaf{i}.org/", link("hub.org", *(f"leaf{rng.randrange(200)}.org" for _ in range(rng.randrange(3))))) for i in range(200)]
    rows += [(f"island{i}.org/", link(f"island{(i + 1) % 5}.org")) for i in range(5)] + [("a.net/other", ""), ("end.org/", None)]
    return [(i, f"http://{url}", html) for i, (url, html) in enumerate(rows)]


def test_a_graph_of_chains_a_hub_and_ends(spark):
    import duckdb
    import pandas as pd

    rows = graph()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == sorted(c.sql(OP7_SQL).fetchall(), key=str) == brute(rows)
    by = {h: v for _, h, _, r, v in got if r is None}
    assert all(by[f"bad{i}.org"] == "block" and by[f"good{i}.org"] == "allow" for i in range(45)) and by["island3.org"] == "allow"


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/", None)], "page_id long, url string, html string").selectExpr("*", "'a' AS host", "'b' AS _h", "'c' AS _BAD", "'d' AS verdict")
    out = judge_urls(df)
    assert out.columns == ["page_id", "url", "html", "_h", "_BAD", "host", "path", "rule", "verdict"] and tuple(out.first())[3:] == ("b", "c", "a.net", "/es/", "net/es/", "block")
