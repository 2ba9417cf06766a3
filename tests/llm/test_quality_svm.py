import random
import zlib

import numpy as np

from tarnwatch.llm import quality_svm as svm
from tarnwatch.llm.quality_svm import SPACE, Features, descend, fit, packed, platt, ratios, score, unpacked


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([6, 40, 300]))
        good = int(rng.random() < 0.8)
        if not good:
            kind = rng.randrange(3)
            words = [w + rng.choice(["&&&", "###"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:9] for _ in range(5)]
        rows.append((i, " ".join(words), good))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(800, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").selectExpr("*", "1 AS score", "'x' AS lang")
    learn = df.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    model = fit(df.drop("quality"), learn.select("doc_id", "quality"))
    more = [(2000, None, 0), (2001, "", 0), (2002, "word " * 300_000, 0), (2003, "dup text", 0), (2003, "dup text", 0), (None, "a b", 0)]
    got = score(spark.createDataFrame(rows + more, "doc_id long, text string, quality int"), model).collect()
    by = {r.doc_id: r.score for r in got}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(by[i] >= 0.3) == bool(y) for i, _, y in test]) > 0.97
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 for r in got)
    assert by[2000] == by[2001] and len({r.score for r in got if r.doc_id == 2003}) == 1
    assert score(df.limit(0), model).count() == 0


def slow_features(text):
    """n-grams one by one, hashed with exact integers."""
    full = (1 << 64) - 1
    h = [zlib.crc32(w.encode()) for w in text.lower().split()]
    out = {((x * 0x9E3779B97F4A7C15 & full) >> 41) % SPACE for x in h}
    out |= {((((a * 0x9E3779B97F4A7C15 + b) & full) * 0xC2B2AE3D27D4EB4F & full) >> 40) % SPACE for a, b in zip(h, h[1:])}
    c = [ord(x) for x in text]
    out |= {(((((a << 42) + (b << 21) + d) & full) * 0x165667B19E3779F9 & full) >> 43) % SPACE for a, b, d in zip(c, c[1:], c[2:])}
    run = longest = 0
    for a, b in zip([None, *h], h):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return out | set(range(2, min(longest, svm.REPEATS) + 1))


def test_features_against_n_grams_one_by_one(monkeypatch):
    monkeypatch.setattr(svm, "CHUNK", 50)
    f = Features()
    for text in ["", "a", "ab", "so so so it is it", "Äö \U0001f600 ü!!", "  ", corpus(5, 3)[2][1], "x " * 40]:
        got = f.of(text)
        assert list(got) == sorted(set(got.tolist())) and set(got.tolist()) == slow_features(text)
        assert np.array_equal(unpacked(packed(got)), got)


def test_dense_sets_are_bitmaps():
    ids = np.arange(0, SPACE, 3)
    assert len(packed(ids)) == SPACE // 8 and np.array_equal(unpacked(packed(ids)), ids)


def test_ratios_by_hand():
    sets, y = [np.array([1, 2]), np.array([2]), np.array([3])], np.array([1.0, 1.0, 0.0])
    r = ratios(sets, y)
    assert np.allclose(r[[1, 2, 3, 4]], [np.log((2 / 4) / (1 / 3)), np.log((3 / 4) / (1 / 3)), np.log((1 / 4) / (2 / 3)), np.log((1 / 4) / (1 / 3))])


def test_descent_reaches_the_least_objective():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    sign = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 0.7, 1.3)

    def objective(w, b):
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * (x @ w + b))).sum()

    w, b = descend([(np.arange(4), row) for row in x], sign, cost, 4, epochs=2000, tolerance=1e-9)
    best = objective(w, b)
    # Subgradient descent from there, and random steps, find nothing lower.
    assert all(objective(w + d[:4], b + d[4]) >= best - 1e-6 for s in (1e-1, 1e-2, 1e-3, 1e-4) for d in rng.normal(size=(300, 5)) * s)


def test_one_class_only_and_repeated_labels(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, quality int")
    assert [r.score for r in score(df, fit(df, df)).collect()] == [1.0, 1.0]
    assert [r.score for r in score(df, fit(df, df.limit(0))).collect()] == [0.0, 0.0]
    rows = corpus(60, 5)
    one = spark.createDataFrame(rows, df.schema)
    twice = spark.createDataFrame(rows + rows, df.schema)
    assert np.array_equal(fit(one, one).weight, fit(twice, twice).weight)


def test_language_and_source_are_not_read(spark):
    rows = corpus(100, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = fit(df.drop("quality"), df.select("doc_id", "quality"))
    a = score(df.selectExpr("doc_id", "text", "'en' AS lang", "1 AS label"), model).collect()
    b = score(df.selectExpr("doc_id + 5000 AS doc_id", "text"), model).collect()
    assert sorted(r.score for r in a) == sorted(r.score for r in b)


def test_platt_lowers_the_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = platt(x, y, np.ones(400))
    loss = lambda a, b: -np.mean(y * np.log(1 / (1 + np.exp(-(a * x + b)))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-(a * x + b)))))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da in (-0.2, 0, 0.2) for db in (-0.3, 0, 0.3))
