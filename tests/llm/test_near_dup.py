import random
import re

import numpy as np
import pytest

from tarnwatch.llm.near_dup import near_duplicates
from tarnwatch.llm.sketch import OnePermutation, Words, shingles


def brute(rows, size=2, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and (100 * len(a & b) >= percent * len(a | b) or rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted((doc, len(sets[i]), low[find(i)], low[find(i)] == doc) for i, (doc, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "word " * 20000), (7, "WORD " * 30000)]
    for _ in range(60):
        words = rng.choices(vocab, k=rng.choice([3, 12, 60, 300]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, len(words) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    base = rng.choices(vocab, k=100)  # a hub in the middle of the ids: the copies link to it, not to each other
    hub = len(rows) + 6
    for i in range(12):
        copy = list(base)
        if len(rows) != hub:
            for k in range(5):
                copy[(i * 8 + k * 2) % 100] = f"x{i}y{k}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(hub, ""), (hub + 1, None), (6, "another text of six")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS sig", "'x' AS bucket")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=2).collect())
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 2 + [("None", "None", True)] * 2


def test_densified_signature_estimates_similarity():
    rng = random.Random(5)
    oph, words, errors = OnePermutation(160), Words(), []
    for n in (5, 20, 100, 3000):
        for _ in range(30):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            b = a[: n * 4 // 5] + [f"v{rng.randrange(10**9)}" for _ in range(n - n * 4 // 5)]
            x, y = (shingles(" ".join(t).encode(), 1, words) for t in (a, b))
            true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
            errors.append(float(np.mean(oph(x) == oph(y))) - true)
    assert abs(np.mean(errors)) < 0.03


def test_an_id_that_repeats_ties_its_texts_together(spark):
    rng = random.Random(6)
    t1, t2, t3 = (" ".join(rng.choices([f"w{i}" for i in range(400)], k=80)) for _ in range(3))
    near = " ".join([*t2.split()[:-1], "changed"])
    rows = [(3, t1), (7, t1), (7, t2), (9, near), (12, t3), (12, ""), (14, t3), (14, t2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=2).collect())
    assert got == brute(rows)
    assert {(d, c) for d, n, c, _ in got if n} == {(d, 3) for d in (3, 7, 9, 12, 14)}


def test_parts_of_a_centre_and_ids_beyond_the_broadcast_bound(spark, monkeypatch):
    from tarnwatch.llm import near_dup

    monkeypatch.setattr(near_dup, "MEMBERS", 3)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 2)
    rows = corpus(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect())
    assert got == brute(rows)


def test_blocks_of_few_very_long_sets(spark, monkeypatch):
    """Several long texts in one bucket, apart after the stars, are cut into blocks by their shingles."""
    from tarnwatch.llm import near_dup

    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    texts = []
    for i in range(24):  # all share buckets; a text is near to its twin only
        copy = list(base)
        for k in range(0, 6000, 24):
            copy[k + i // 2] = f"t{i // 2}k{k}"
        if i % 2:
            copy[-1] = "twin"
        texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, percent=97)
    assert len({c for _, _, c, _ in want}) == 12
    for bound in (4_000_000, 13_000, 1):
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", bound)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=2, percent=97).collect())
        assert got == want
