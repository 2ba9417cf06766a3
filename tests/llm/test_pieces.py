import random

import numpy as np
import pytest

from tarnwatch.llm.pieces import MARK, PENALTY, Merges, Pieces, decode_documents, default_model, encode_documents


def walk(b, i=0):
    def varint(i):
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return r, i

    while i < len(b):
        start = i
        tag, i = varint(i)
        if tag & 7 == 0:
            _, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            yield start, tag >> 3, i, n
            i += n
            continue
        else:
            i += 4 if tag & 7 == 5 else 8
        yield start, tag >> 3, i, 0


@pytest.fixture(scope="module")
def library():
    """The same model with its type set to unigram: the best of the library's n-best lists is
    then the segmentation of the highest sum of scores."""
    import sentencepiece

    data = bytearray(open(default_model(), "rb").read())
    spec = next((at, n) for _, field, at, n in walk(data) if field == 2)
    kind = next(start for start, field, _, _ in walk(data[spec[0] : spec[0] + spec[1]]) if field == 3)
    data[spec[0] + kind + 1] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


@pytest.fixture(scope="module")
def pieces():
    return Pieces(default_model())


def brute(text):
    """Viterbi over the whole text, code point by code point."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    plain = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    lowest = min(model.get_score(i) for i in plain.values()) - PENALTY
    s = MARK + text.replace(" ", MARK) if text else ""
    best = [(0.0, 0, [])] + [None] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 16), j):
            part = s[i:j]
            if part in plain:
                score, ids = model.get_score(plain[part]), [plain[part]]
            elif j - i == 1:
                score, ids = lowest, [model.piece_to_id(f"<0x{x:02X}>") for x in part.encode()]
            else:
                continue
            if best[j] is None or best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, i, ids)
    out, j = [], len(s)
    while j:
        out = best[j][2] + out
        j = best[j][1]
    return out


def test_against_the_library(pieces, library):
    rng = random.Random(1)
    vocab = ["the", "Reading", "naïve", "straße,", "données", "internationalisation", "über.Die", "whether", "thing"]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 8))) for _ in range(50)] + ["a", "supercalifragilisticexpialidocious" * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(texts)] == [library.nbest_encode_as_ids(t, 2)[0] for t in texts]


def test_against_brute_force(pieces):
    texts = ["", " ", "  a  b ", "漢字 😀 mixed\n\ttext", "x\0y", f"mark{MARK}inside {MARK}", "trailing ", "word " * 50 + "z" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(texts)] == [brute(t) for t in texts]


def test_round_trip_through_spark(spark, pieces):
    texts = [None, "", " lead", "été\r\n漢😀", "long " * 40000, "n" * 60000, "dup", "dup", "a  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_ids")
    coded = encode_documents(df, default_model())
    assert {r.doc_id: r.text for r in decode_documents(coded, default_model()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.decoded_equal and r.n_ids == len(r.ids) for r in coded.collect())
    assert encode_documents(df.limit(0), default_model()).count() == 0


def test_the_search_beside_the_merged_ids(spark):
    import zlib

    texts = [None, "", "committee  meets", "漢字 😀 mixed\n\ttext", "internationalisation über.Die", "z" * 300, "dup", "dup"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_documents(df, default_model(), with_ids=False, searched=True).collect():
        want = brute(texts[r.doc_id] or "")
        assert (r.viterbi_n_ids, r.viterbi_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert "viterbi_n_ids" not in encode_documents(df, default_model()).columns


def test_small_cache_gives_the_same_ids(pieces):
    texts = [f"w{i} v{i * 7} common words" for i in range(200)]
    small = Pieces(default_model(), cache_words=50)
    assert [x for i in range(0, 200, 9) for x in small.encode(texts[i : i + 9])] == pieces.encode(texts)


def test_ids_of_a_bpe_model_are_those_of_the_library(spark):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = random.Random(4)
    vocab = ["committee", "the", "Reading", "naïve", "straße,", "données", "internationalisation", "über.Die", "aaaa", "漢字仮名", "x\ty", "😀"]
    texts = ["", "a", "  a  b ", "committee", "n" * 3000, "ab" * 2000, "漢字 😀 mixed\n\ttext", "x\0y"]
    texts += [" ".join(rng.choices(vocab, k=rng.randrange(1, 30))) for _ in range(50)] + ["".join(rng.choices("abcdeins ", k=400)) for _ in range(200)]
    want = [plain.encode(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode_documents(df, default_model()).collect()} == dict(enumerate(want))
    alone = Merges(default_model())
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in alone.encode([t])] == want


def test_a_very_long_word_is_cut_where_no_piece_lies_across():
    import sentencepiece

    rng = random.Random(12)
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    own = Merges(default_model())
    for text in ("".join(rng.choice("abcdeéжф漢字😀.,;:0123456789") for _ in range(30_000)), "word" * 5000, "x" * 9000):
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == model.encode(text) and own.decode(np.array(ids, dtype="<u4").tobytes()) == text
    parts = own._parts("".join(rng.choice("aeиж漢字") for _ in range(10_000)))
    assert len(parts) > 1000 and not any(a[-1] + b[0] in own.pairs for a, b in zip(parts, parts[1:]))


def test_a_worker_loads_its_models_once_and_keeps_their_words():
    import pyarrow as pa

    from tarnwatch.llm.pieces import _encoded, encoders

    path = default_model()
    batch = lambda first: pa.record_batch([pa.array([1, 2], pa.int64()), pa.array([first, None])], names=["doc_id", "text"])
    a = next(_encoded(iter([batch("some words here")]), path, True, True)).to_pydict()
    kept = encoders(path, True)
    assert len(kept[0].cache) >= 3 and len(kept[1].cache) >= 3
    b = next(_encoded(iter([batch("some words here")]), path, True, True)).to_pydict()
    assert a == b and encoders(path, True) is kept
