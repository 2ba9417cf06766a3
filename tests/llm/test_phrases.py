import hashlib
import random

import pytest

from tarnwatch.llm.phrases import Fingerprinter, as_text, compare_with_next, likeness, parse


def plain_phrases(text):
    seen, word, out = set(), "", []
    for c in text:
        word += c
        if word not in seen:
            seen.add(word)
            out.append(word)
            word = ""
    return out + [word] * bool(word)


@pytest.mark.parametrize("seed", range(4))
def test_parse_against_code_point_by_code_point(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 50, 3000):
        text = "".join(rng.choices("abé\0😀", k=n))
        ends = parse(text, 0, {})[0]
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == plain_phrases(text)


def brute(rows):
    prints = Fingerprinter()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        a, b, c = prints(text), prints(edited), prints(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def rows_of(n, seed=0):
    rng = random.Random(seed)
    texts = [None, "", "a", "é😀"] + [" ".join(rng.choices(["the", "cat", "sät", "on", "mat", "x" * 9], k=rng.randrange(300))) for _ in range(n)]
    ids = rng.sample(range(-5, 10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("rows", [rows_of(60), rows_of(60)[:1], rows_of(9) + [(None, "null id text")], [(1, "long " * 30000), (2, "long " * 29000)]])
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS range", "'x' AS role", "2 AS guest")
    assert sorted(map(tuple, compare_with_next(df).collect()), key=str) == brute(rows)


def test_ties_and_empty_table(spark):
    df = spark.createDataFrame([(1, "b b b"), (1, "a a a"), (1, "a a a"), (2, "c c")], "doc_id long, text string")
    got = compare_with_next(df).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3
    assert compare_with_next(df.limit(0)).count() == 0


def test_likeness_orders_texts():
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    a = " ".join(rng.choices(vocab, k=800))
    b = a[: len(a) // 2] + " ".join(rng.choices(vocab, k=400))
    c = "".join(chr(rng.randrange(300, 900)) for _ in range(4000))
    prints = Fingerprinter()
    assert likeness(prints(a), prints(a)) == 1 > likeness(prints(a), prints(b)) > likeness(prints(a), prints(c))
