import random

import numpy as np

from tarnwatch.llm.toxicity import LANG_PRIOR, Network, _platt, _Rows, _threshold, fit, hashed, score, train


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([5, 40, 200]))
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten,", "zuck" + rng.choice(vocab)]))
        rows.append((i, " ".join(words), toxic, rng.choice(["en", "fr", None])))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string").selectExpr("*", "1 AS score")
    net = fit(df.drop("toxic"), df.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    more = [(2000, None, 0, None), (2001, "", 0, "en"), (2002, "word " * 40000, 0, "en"), (2003, "dup text", 0, "en"), (2003, "dup text", 0, "en")]
    got = score(spark.createDataFrame(rows + more, df.drop("score").schema), net).collect()
    by = {r.doc_id: r for r in got}
    test = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([(by[i].score >= 0.7) == bool(y) for i, _, y, _ in test]) > 0.95
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 2003]
    assert len(same) == 2 and abs(same[0] - same[1]) < 1e-6 and by[2000].score == by[2001].score
    assert score(df.limit(0), net).count() == 0


def test_language_is_no_input_of_the_score(spark):
    rows = corpus(200, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    net = fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    a = spark.createDataFrame([(1, rows[0][1], "en"), (2, rows[0][1], "xx"), (3, rows[0][1], None)], "doc_id long, text string, lang string")
    assert np.ptp([r.score for r in score(a, net).collect()]) < 1e-6


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, "a", 1, "en"), (2, "b", 1, "en")], "doc_id long, text string, toxic int, lang string")
    assert [r.score for r in score(df, fit(df, df)).collect()] == [1.0, 1.0]
    assert [r.score for r in score(df, fit(df, df.limit(0))).collect()] == [0.0, 0.0]


def test_lookup_tables_give_the_convolution():
    net, texts = Network(), ["one two three", "", "a b c d e f g"]
    net.prepare()
    ids, stems, starts = hashed(texts, _Rows())
    got = net.pooled(ids, stems, starts)
    ends = [*starts[1:], len(ids)]
    for i, (a, b) in enumerate(zip(starts, ends)):
        x = net.embedding[ids[a:b]] + net.embedding[stems[a:b]]
        want = [max(sum(x[p + j] @ f[j] for j in range(len(f)) if p + j < len(x))[k] for p in range(len(x) - 2)) for f in net.filters for k in range(f.shape[2])]
        assert np.allclose(got[i], want, atol=1e-5)


def test_training_is_repeatable():
    texts, y = ["bad thing", "good thing"] * 20, np.array([1, 0] * 20, np.float32)
    assert np.array_equal(train(texts, y).out, train(texts, y).out)


def slow_score(net, text):
    """The score position by position, without tables or batches."""
    rows = [_Rows()[w] for w in text.lower().split()] + [0] * 3
    x = [net.embedding[r >> 16] + net.embedding[r & 0xFFFF] for r in rows]
    tops = [max(float(sum(x[p + j] @ f[j][:, k] for j in range(len(f)))) for p in range(len(x) - 2)) for f in net.filters for k in range(f.shape[2])]
    z = float(net.scale * (np.maximum(np.array(tops) + net.bias.reshape(-1), 0) @ net.out + net.out_bias[0]) + net.shift)
    return 1 / (1 + np.exp(-z))


def test_scores_and_thresholds_against_brute_force(spark):
    rows = corpus(700, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    net = fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in score(df, net).collect()}
    assert max(abs(got[i].score - slow_score(net, t)) for i, t, _, _ in rows) < 1e-4
    for i, _, _, lang in rows:
        own = (lang or "") in net.thresholds
        assert got[i].threshold == net.thresholds[(lang or "") if own else None] and got[i].threshold_of == ((lang or "") if own else "all")
        assert got[i].flagged == (got[i].score >= got[i].threshold)


def test_the_best_cut_by_trying_all():
    rng = np.random.default_rng(3)
    s, w = np.round(rng.random(60), 2), rng.random(60)
    y = (rng.random(60) < s).astype(float)

    def f1(t):
        p = s >= t
        return 2 * (w * p * y).sum() / ((w * p).sum() + (w * y).sum())

    assert f1(_threshold(s, y, w)) >= max(f1(t) for t in s) - 0.05
    assert _threshold(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 0.0]), np.ones(3)) == (0.8 + 0.1) / 2


def test_the_calibration_lowers_the_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = _platt(x, y, np.ones(400))
    loss = lambda a, b: -np.mean(y * np.log(1 / (1 + np.exp(-(a * x + b)))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-(a * x + b)))))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da in (-0.2, 0, 0.2) for db in (-0.3, 0, 0.3))


def test_a_language_of_few_rows_is_drawn_to_the_common_threshold_and_texts_are_bounded(spark):
    rows = [(i, t, y, "rare" if i < 12 else "one" if i < 20 and not y else "en") for i, t, y, _ in corpus(400, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    net = fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    count = {lang: [sum(r[2] == y for r in rows if r[3] == lang) for y in (0, 1)] for lang in ("rare", "en", "one")}
    assert count["one"][1] == 0 and "one" not in net.thresholds
    for lang in ("rare", "en"):
        m = min(count[lang])
        assert abs(net.own_weights[lang] - m / (m + LANG_PRIOR)) < 1e-12
        own = (net.thresholds[lang] - (1 - net.own_weights[lang]) * net.thresholds[None]) / net.own_weights[lang]
        assert -1e-9 <= own <= 1 + 1e-9
    assert net.own_weights["rare"] < 0.5 < net.own_weights["en"]
    whose = {r.lang: (r.threshold_of, r.own_weight, r.threshold) for r in score(df, net).collect()}
    assert whose["rare"] == ("rare", net.own_weights["rare"], net.thresholds["rare"]) and whose["one"] == ("all", 0.0, net.thresholds[None])
    huge = df.unionByName(spark.createDataFrame([(9999, "vile " * 200_000, 1, "en")], df.schema))
    again = fit(huge.drop("toxic"), huge.select("doc_id", "toxic"), chars=900_000)
    assert np.array_equal(again.out, net.out)  # the text beyond the bound is not trained on


def test_all_labelled_rows_train_and_calibrate(spark, monkeypatch):
    from tarnwatch.llm import toxicity

    rows = corpus(600, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    twice = df.unionByName(df.filter("doc_id < 20"))
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    monkeypatch.setattr(toxicity, "GROUP_ROWS", 60)
    net = fit(twice.drop("toxic"), twice.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    few = fit(df.drop("toxic"), df.filter("doc_id % 3 <> 1").select("doc_id", "toxic"), sample=100)
    assert net.rows == 400 and not np.array_equal(net.out, few.out)
    got = {r.doc_id: r.score for r in score(df, net).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y, _ in rows if i % 3 == 1]) > 0.9
    again = fit(twice.repartition(3).drop("toxic"), twice.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    assert np.array_equal(again.out, net.out) and again.thresholds == net.thresholds
