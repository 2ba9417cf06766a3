import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarnwatch.llm import resampling
from tarnwatch.llm.common import stored
from tarnwatch.llm.resampling import drawn, gains, resampled, totals, weighed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, per_cent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * per_cent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(n):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % (11 + i % 60)}" for j in range(i % 90))) for i in range(n)]
    docs += [(900, None), (901, ""), (902, "Äpfel ÉTÉ x_y-z 中文 \U0001f600 A1b2 \x00 ~"), (903, "w1 " * 30_000), (None, "a b " * 20), (904, "..."), (905, "one")]
    return docs + [(906, "same text again " * 10)] * 40  # rows that repeat


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "STEP", 8)
    docs, target = corpus(300), ["w1 w4 w9 w16 w25", "w3 w10", None, "ÉTÉ"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampled(d, b).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=str) == brute(docs, target)
    every = resampled(d, b, per_cent=100, least_words=0).collect()
    assert sorted(r.rank for r in every) == list(range(1, len(docs) + 1))


def test_equal_scores_go_by_doc_id(spark):
    scored = stored(spark.createDataFrame([(i, 30, 5, 1, 7 if i > 2 else 9) for i in range(9)], "doc_id long, n_words int, n_features long, weight long, score long"), "t")
    got = {r.doc_id: r.rank for r in drawn(scored, 60).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: None, 6: None, 7: None, 8: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], none.schema)
    assert [(r.n_features, r.rank) for r in resampled(one, none).collect()] == [(5, None)]


def test_texts_are_not_exploded_to_score_them_and_do_not_move(spark):
    d = spark.createDataFrame(corpus(50), "doc_id long, text string")
    by_bucket = gains(spark, totals(d), totals(d))
    plan = weighed(d, by_bucket)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan
    path = stored(d, "texts")
    plan = path.select(F.explode(resampling.buckets_of(resampling.words_of(F.col("text")))).alias("bucket")).groupBy("bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(bucket") < plan.index("partial_count")  # the plan is printed from its end
