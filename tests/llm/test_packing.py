import random
import zlib
from collections import defaultdict

import pytest

from tarnwatch.llm.packing import Encoder, default_tokenizer, pack_documents, pack_pool


@pytest.mark.parametrize("seed", range(5))
def test_pool_covers_every_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 40, 255, 256, 257, 600, 1024, 2047, 2048, 5000]) + rng.randrange(3) for _ in range(rng.choice([1, 7, 300]))]
    seen = defaultdict(list)
    sizes = []
    for seq in pack_pool(lengths):
        sizes.append(sum(p[2] for p in seq))
        for doc, start, length in seq:
            assert length > 0
            seen[doc].append((start, length))
    assert all(0 < s <= 2048 and s & (s - 1) == 0 for s in sizes)  # no padding at all
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


def test_ids_and_offsets(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    texts = ["Hello  world", None, "", "a   b\n c \n\n d ", "it's <|endoftext|>  x", "né " * 3000, "x\0 y", "dup dup", "dup dup", "\n\n a", "tab\t word"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "1 AS offset")
    pieces = pack_documents(df, default_tokenizer()).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    covered = defaultdict(int)
    places = defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_cache_that_overflows_gives_the_same_ids():
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(30)]
    assert list(Encoder(default_tokenizer(), cache_words=25)(texts)) == list(Encoder(default_tokenizer())(texts))


def test_ids_equal_the_library_on_mixed_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    rng = random.Random(9)
    parts = ["don't", "WE'LL", "naïve", "Ærø", "12½", "x²", "漢字", "😀!", "ʒ", "\u00a0", "\u00ad", "\x1c", "…", "<|endoftext|>", "a\nb", "\r\n", "'s", "''", "ẞ", "\u0300", "tab\t", "ªº", "٣"]
    texts = [" ".join(rng.choices(parts, k=20)) + rng.choice(["", "  ", "\n\n", " \n "]) + "".join(rng.choices(parts, k=9)) for _ in range(400)]
    texts += ["".join(map(chr, range(a, a + 60))) + " x" for a in range(0, 0x260, 20)]
    got = list(Encoder(default_tokenizer())(texts))
    for text, raw in zip(texts, got):
        assert raw == b"".join(x.to_bytes(4, "little") for x in plain.encode(text, add_special_tokens=False).ids)


def test_empty_table_and_bad_tiers(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        pack_documents(empty, default_tokenizer(), tiers=(300, 2048))


def test_padding_and_step_groups_by_an_independent_count(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 80, 300, 900])))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = pack_documents(df, default_tokenizer()).collect()
    size, group = defaultdict(int), {}
    for p in pieces:
        size[p.sequence_id] += p.length
        group[p.sequence_id] = p.step_group
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.values())  # padded to 2048 but at powers of two: none here
    assert sum(size.values()) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    tokens, count = defaultdict(int), defaultdict(int)
    for k, n in size.items():
        tokens[group[k]] += n
        count[group[k]] += 1
    assert len(tokens) == 8 and max(count.values()) - min(count.values()) <= 1 and max(tokens.values()) - min(tokens.values()) <= 2 * 2048
    # A lower bound: no packing needs fewer sequences than windows of tokens; short tiers add theirs.
    assert len(size) >= -(-sum(size.values()) // 2048)


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr("*", "'x' AS start", "'y' AS LENGTH", "3 AS tier")
    assert {p.doc_id for p in pack_documents(df, default_tokenizer()).collect()} == {1, 2}
