import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline as C
import test_line_dedup
import test_near_dup
import test_quality
import test_secrets

SPACE = " \t\n\x0b\x0c\r"


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(90):
        lines = [" ".join(rng.choices(vocab, k=rng.randrange(8, 30))) for _ in range(rng.randrange(1, 9))]
        if i % 2:
            lines.insert(0, "All Rights Reserved by the site of vocabulary")
        if i % 7 == 0:
            lines.append("password: hunter" + str(rng.randrange(10**9)))
        if i % 11 == 0:
            lines.append("key " + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=44)))
        rows.append((i, "\n".join(lines), "en", "s" if i % 3 else None, 0))
    base = rng.choices(vocab, k=150)
    for i in range(90, 96):  # near copies, each of one line
        copy = list(base)
        copy[i] = "changed"
        rows.append((i, " ".join(copy), "en", "s", 0))
    rows += [(96, rows[3][1], "en", "s", 0), (97, None, None, None, None), (98, "", "en", "s", 0), (99, "rep eat " * 100, "en", "s", 0), (100, "long text " + " ".join(rng.choices(vocab, k=40000)), "en", "s", 0)]
    return rows


def brute_quality(rows, least=20, share=0.05, kept=0.3):
    key = lambda x: x.strip(SPACE).lower()
    count, first, hosts = defaultdict(int), {}, defaultdict(int)
    for doc, text, _, host, _ in rows:
        hosts[host] += 1
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            count[host, k] += 1
            first[host, k] = min(doc, first.get((host, k), doc))
    out = []
    for doc, text, lang, host, _ in rows:
        lines = (text or "").split("\n")
        over = lambda x: key(x) and count[host, key(x)] >= max(least, share * hosts[host]) and first[host, key(x)] != doc  # noqa: B023, E731
        clean = "\n".join(x for x in lines if not over(x))
        gone = sum(len(x) for x in lines if over(x))
        if not test_quality.brute_base(text)[5] and not (gone and len(text) - gone < kept * len(text)):
            out.append((doc, clean, lang, host, len(clean)))
    return out


def test_stages_against_brute_force(spark):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    stages = dict(C.STAGES)
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)

    want = brute_quality(rows)
    got = sort(stages["quality rules"](spark, docs, ""))
    assert got == sorted(want, key=str) and len(got) < len(rows)

    docs = spark.createDataFrame(got, schema)
    digests = {d: (n, gone) for d, _, n, gone in ((x[0], None, x[1], x[2]) for x in test_line_dedup.brute([(r[0], r[1]) for r in got]))}
    got2 = sort(stages["line dedup"](spark, docs, ""))
    texts = {r[0]: r[1] for r in got}
    for doc, text, *_ in got2:
        assert len(texts[doc].split("\n")) - len(text.split("\n")) == digests[doc][1]
    assert {r[0] for r in got} - {r[0] for r in got2} == {d for d, (n, gone) in digests.items() if n == gone}

    docs = spark.createDataFrame(got2, schema)
    keep = {r[0] for r in test_near_dup.brute([(r[0], r[1]) for r in got2], size=5) if r[3]}
    got3 = sort(stages["near dedup"](spark, docs, ""))
    assert got3 == [r for r in got2 if r[0] in keep] and len(got3) < len(got2)

    docs = spark.createDataFrame(got3, schema)
    spans = {doc: s for doc, _, s in test_secrets.brute([(r[0], r[1]) for r in got3])}
    got4 = sort(stages["secret scan"](spark, docs, ""))
    for (doc, before, *_), (same, after, *_) in zip(got3, got4, strict=True):
        at, out = 0, ""
        for start, _, end in spans[doc]:
            if start >= at:
                out += before[at:start] + "[SECRET]"
            at = max(at, end)
        assert doc == same and after == out + before[at:]
    assert any("[SECRET]" in r[1] for r in got4) and all(r[4] == len(r[1]) for r in got4)

    from tokenizers import Tokenizer

    from tarnwatch.llm.packing import default_tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    ids = {r[0]: [*plain.encode(r[1], add_special_tokens=False).ids, 1] for r in got4}
    seen = defaultdict(int)
    for p in stages["packing"](spark, spark.createDataFrame(got4, schema), "").collect():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        seen[p.doc_id] += p.length
    assert seen == {d: len(x) for d, x in ids.items()}

    assert C.ORACLE_SQL is None and re.match("[a-z ]+$", C.STAGES[0][0])


def test_run_of_few_rows_and_none(spark, tmp_path):
    rows = [(1, " ".join(f"w{i}" for i in range(80)), "en", "s", 0), (2, None, None, None, None), (3, " ".join(f"w{i}" for i in range(81)), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, want in (("few", rows, {1}), ("none", [], set())):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert {r.doc_id for r in C.run(spark, str(tmp_path / name)).collect()} == want


def test_stages_with_clashing_columns_nulls_ties_and_no_rows(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "en", None, None), (1, base, "en", None, None), (None, base + " x", None, "s", 5), (2, None, None, None, None), (3, base, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'a' AS _key", "'b' AS spans", "'c' AS kept_text", "'d' AS _id", "'e' AS component_id", "'f' AS n_words", "4 AS START")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == C.COLUMNS
        got = sorted((r.doc_id or 0, r.text) for r in out.collect())
        want = {
            "quality rules": [(0, base + " x"), (1, base), (1, base), (3, base)],
            "line dedup": [(0, base + " x"), (1, base), (1, base), (2, "")],
            "near dedup": [(0, base + " x"), (1, base), (1, base), (2, None)],
            "secret scan": [(0, base + " x"), (1, base), (1, base), (2, ""), (3, base)],
        }[name]
        assert [(d, t or "") for d, t in got] == [(d, t or "") for d, t in want], name
        assert stage(spark, docs.limit(0), "").count() == 0
    pieces = C.STAGES[-1][1](spark, docs, "").collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 1)


def test_stages_with_texts_of_very_many_lines_and_spans(spark):
    lines = "\n".join(f"line of words {k} {k % 97}" for k in range(60_000))
    secrets = " ".join(f"word{k} token=abc{k}def" for k in range(10_000))
    rows = [(1, lines, "en", "s", 0), (2, lines + "\nlast line of its own", "en", "s", 0), (3, secrets, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    stages = dict(C.STAGES)
    assert {r.doc_id: r.text for r in stages["line dedup"](spark, docs, "").collect()} == {1: lines, 2: "last line of its own", 3: secrets}
    assert {r.doc_id for r in stages["near dedup"](spark, docs, "").collect()} == {1, 3}
    clean = {r.doc_id: r.text for r in stages["secret scan"](spark, docs, "").collect()}
    assert clean[3] == " ".join(f"word{k} [SECRET]" for k in range(10_000)) and clean[1] == lines
