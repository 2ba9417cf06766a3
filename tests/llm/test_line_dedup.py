import hashlib
import re
import time

from tarnwatch.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"
LONG = "é" * 9 + "Zz long line"


def brute(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    seen = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    seen.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = lines if doc is None else [x for x in lines if not (len(seen.get(key(x), ())) >= 2 and min(seen[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [
        (1, f"{LONG}\nown line of one\n\nshort"), (2, f"  {LONG.upper().replace('É', 'é')}\t\nshort\nother line here"), (3, None), (4, ""), (5, f"{LONG}\n{LONG}"),
        (None, f"{LONG}\nx"), (6, "a" * 9 + "\n" + "b" * 10), (7, "a" * 9 + "\n" + "b" * 10), (8, "word " * 30000 + "\n" + LONG), (2, f"  {LONG}\nsecond row of two"),
        (9, "same text of a copy"), (9, "same text of a copy"), (10, LONG),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pos", "1 AS h1", "2 AS first")
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_lines(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_higher_threshold(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG), (3, LONG), (4, "another long line"), (5, "another long line")], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in dedup_lines(df, min_docs=3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string").selectExpr("*", "'a' AS _key", "'b' AS N_LINES", "'c' AS _gone", "'d' AS kept_text")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_key", "_gone", "n_lines", "n_dropped", "kept_text"]
    assert {tuple(r) for r in out.collect()} == {(1, LONG, "a", "c", 1, 0, LONG), (2, LONG, "a", "c", 1, 1, "")}


def test_a_text_of_very_many_lines(spark):
    many = "\n".join(f"a longer line {k % 50_000}" for k in range(100_000))
    rows = [(1, many), (2, many + "\nlast own line"), (3, "first own line\n" + many)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(df).collect()}
    assert got == {(1, 100_000, 0, many), (2, 100_001, 100_000, "last own line"), (3, 100_001, 100_000, "first own line")}
    assert time.time() - start < 60


def test_a_line_of_most_rows(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'a very common line\\n', '') || 'own line ' || id AS text")
    assert dedup_lines(df).selectExpr("sum(n_dropped)").first()[0] == 13_332
