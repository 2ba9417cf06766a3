import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tarnwatch.llm.quality import base_rules, line_frequency, repeated_window_words

SPACE = " \t\n\x0b\x0c\r"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a b c d a b c", "a a a a", "é# ü|\r\nx\nx\n\nx", "same line\nsame line \nsame line", "\x1cword \x85 x y", "rep eat ed " * 40000]
    texts += [" ".join(rng.choices("abcde", k=rng.randrange(120))) for _ in range(60)] + ["\n".join(rng.choices(["l one", "l two", " "], k=9)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS line")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in base_rules(df).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_line_frequency(spark):
    rng = random.Random(2)
    rows = [(None, "Shared  Footer\nown", "h"), (None, "menu\nMenu\nx", "h"), (600, "menu\nlong boiler plate " * 2, "h"), (600, "menu\nlong boiler plate " * 2, "h"), (500, None, "h"), (501, "", None), (502, "only one", None), (503, "x", "h"), (503, "x", "h")]
    for i in range(120):
        lines = [f"own line {i} {rng.random()}"] * rng.randrange(3) + [rng.choice([" Menu ", "menu", "MENU"])] * rng.randrange(3) + (["long boiler plate " * 5] if i % 3 == 0 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h", "g", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'y' AS _n", "3 AS line")
    got = sorted(((r.doc_id, r.source, r.removed_lines, r.removed_chars, r.depleted, r.clean_text) for r in line_frequency(df, min_docs=10, min_share=0.1).collect()), key=str)
    key = lambda x: x.strip(SPACE).lower()
    held, first, hosts = defaultdict(set), {}, defaultdict(set)
    for doc, text, host in rows:
        if doc is None:
            continue
        hosts[host].add(doc)
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            held[host, k].add(doc)
            first[host, k] = min(doc, first.get((host, k), doc))
    want = []
    for doc, text, host in rows:
        lines = (text or "").split("\n")
        gone = [x for x in lines if key(x) and len(held[host, key(x)]) >= 10 and len(held[host, key(x)]) >= 0.1 * len(hosts[host]) and first.get((host, key(x))) != doc]
        chars, n = sum(map(len, gone)), len(text or "")
        want.append((doc, host, len(gone), chars, chars > 0 and n - chars < 0.3 * n, "\n".join(x for x in lines if x not in gone)))
    assert got == sorted(want, key=str)
    assert any(r[4] for r in got)


def test_repeated_rows_are_one_document(spark):
    rows = [(1 + i % 2, f"a common line\nrow {i}", "h") for i in range(25)] + [(10 + i, "another common line", "h") for i in range(20)]
    got = {(r.doc_id, r.removed_lines) for r in line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=20).collect()}
    assert {x for x in got if x[0] < 3} == {(1, 0), (2, 0)} and {x for x in got if x[0] > 2} == {(10, 0)} | {(10 + i, 1) for i in range(1, 20)}


def test_a_share_of_a_large_host_has_an_upper_bound(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id < 60, 'in sixty\\n', '') || 'own ' || id AS text", "'h' AS source")
    removed = lambda **k: line_frequency(df, min_docs=20, min_share=0.05, **k).agg(F.sum("removed_lines")).first()[0]
    assert removed() == 0 and removed(max_docs=60) == 59


def test_windows_of_equal_hash_are_compared(spark):
    words = "a b c d e a b c x y z a b q q q q".split()
    df = spark.createDataFrame([(words,)], "w array<string>")
    for hashed in (F.xxhash64, lambda *w: F.lit(5).cast("long"), lambda a, b, c: F.ascii(a).cast("long") % 2):
        assert df.select(repeated_window_words(F.col("w"), F.lit(5), 3, hashed)).first()[0] == brute_base(" ".join(words))[4]


def test_clashing_columns(spark):
    rows = [(i, f"the same long line\nown {i}", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'a' AS _id", "'b' AS _KEY", "'c' AS n_words", "'d' AS removed_lines", "'e' AS _m", "'f' AS _my_gone")
    out = line_frequency(base_rules(df))
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "_id", "_KEY", "_m", "_my_gone", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_chars", "depleted", "clean_text"])
    got = out.collect()
    assert {r.n_words for r in got} == {6} and sum(r.removed_lines for r in got) == 29 and {(r._id, r._KEY, r._m, r._my_gone) for r in got} == {("a", "b", "e", "f")}


def test_a_text_of_very_many_lines(spark):
    rows = [(i, "\n".join(f"line {k}" for k in range(100_000)), "h") for i in range(3)]
    out = line_frequency(base_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")), min_docs=2)
    start = time.time()
    assert {(r.removed_lines, r.clean_text) for r in out.select("removed_lines", "clean_text").collect()} == {(0, rows[0][1]), (100_000, "")}
    assert time.time() - start < 60


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    out = line_frequency(base_rules(df)).select("doc_id", F.col("clean_text"))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
