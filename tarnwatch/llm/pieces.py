"""SentencePiece encoding and decoding in numpy, in batches of words.

The model file gives pieces, scores and the kind of the model. Of a BPE model the scores are
merge ranks: of all neighbours that make a piece together, those of the best score merge
first, of equal ones the leftmost (Merges). Of a unigram model a text's ids are the
segmentation of the highest sum of scores (of equal ones, at each end the longest last piece;
Pieces); op5_sentencepiece gives that of its BPE model beside the merged ids, as if its ranks were
scores. A code point that no piece covers goes to byte pieces. No piece goes on past a word, so words (a run of space marks and
what follows up to the next one) are encoded apart: distinct words of equal length advance
together. Substrings are hashed at once and probe the sorted hashes of the pieces; in the
Viterbi search of Pieces the maxima over piece lengths are the backpointers.

Defined cases: a null text is empty and has no ids; a text that holds the space mark itself
decodes to a space there; equal rows give equal ids; of merges or segmentations of equal score
the leftmost, or the longest last piece, wins; an empty table gives an empty table. Texts are not
normalised beyond spaces becoming marks: the model's own normaliser, if it has one, is not run, so
ids are the library's where that leaves a text as it is. A very long text is encoded whole; a word
of more than LONG code points is cut between neighbours that no piece holds together, which
changes no id. What can't be cut is held whole, about 250 bytes a code point of a BPE model. Other
columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .sketch import U64, mix

MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_WORDS = 400_000
#: Code points times words that one step of the search holds.
STEP = 100_000
#: Bits of a hash that say where among the sorted keys to look.
TOP = 20
#: Texts that are encoded in one go.
TEXTS = 2048
#: Longer words are cut where no piece can lie across.
LONG = 4096
#: Up to so many words of one length are merged one by one.
FEW = 20
#: Fields of the model file: trainer_spec, and in it model_type.
_TRAINER, _KIND, _BPE = 2, 3, 2
#: What a code point without a piece costs beyond the lowest score.
PENALTY = 10.0


class Pieces:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_at = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
            raise ValueError("a piece goes on past a word")
        self.longest = max(len(names[i]) for i in plain)
        self.pairs = {names[i][k : k + 2] for i in plain for k in range(len(names[i]) - 1)}
        self.powers = self.inverse = np.ones(1, dtype=U64)
        keys = np.array([self._whole(names[i]) for i in plain], dtype=U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, dtype=np.int32)[order]
        # Where the keys of each first TOP bits begin, and how many share them at most.
        self.begins = np.searchsorted(self.keys, np.arange(1 << TOP, dtype=U64) << U64(64 - TOP)).astype(np.int32)
        self.crowd = int(np.bincount((self.keys >> U64(64 - TOP)).astype(np.int64)).max())
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.lowest = float(self.scores.min()) - PENALTY
        self.raw = [bytes([self.bytes_at.index(i)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(2 * len(self.powers), n + 1)
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums of a row of code points each, from which any substring's hash follows."""
        self._grow(codes.shape[1])
        sums = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=U64)
        np.cumsum((codes.astype(U64) + U64(1)) * self.powers[: codes.shape[1]], axis=1, out=sums[:, 1:])
        return sums

    def _hash(self, sums: np.ndarray, length: int) -> np.ndarray:
        last = sums.shape[1] - length
        return mix((sums[:, length:] - sums[:, :last]) * self.inverse[:last] + U64(length))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """For each hash the place of the first sorted key that isn't below it (or the last key):
        from the keys of the same first bits on, step by step."""
        at = np.minimum(self.begins[(h >> U64(64 - TOP)).astype(np.int64)], len(self.keys) - 1)
        for _ in range(self.crowd - 1):
            at += (self.keys[at] < h) & (at < len(self.keys) - 1)
        return at

    def _whole(self, piece: str) -> int:
        return int(self._hash(self._sums(np.frombuffer(piece.encode("utf-32-le"), "<u4").reshape(1, -1)), len(piece))[0, 0])

    def _search(self, codes: np.ndarray) -> list[bytes]:
        """Ids of words of equal length, a row each, as little-endian bytes."""
        m, length = codes.shape
        sums = self._sums(codes)
        top = min(length, self.longest)
        # gain[l][:, i], piece[l][:, i]: of the piece of l + 1 code points that begins at i.
        gain, piece = [], []
        for k in range(1, top + 1):
            h = self._hash(sums, k)
            at = self._find(h)
            hit = self.keys[at] == h
            gain.append(np.where(hit, self.scores[at], self.lowest if k == 1 else -np.inf))
            piece.append(np.where(hit, self.ids[at], -1))
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, length + 1), dtype=np.int8 if self.longest < 128 else np.int32)
        for j in range(1, length + 1):
            sizes = range(min(j, top), 0, -1)  # the longest first: argmax takes the first of equals
            paths = np.stack([best[:, j - k] + gain[k - 1][:, j - k] for k in sizes], axis=1)
            pick = paths.argmax(axis=1)
            best[:, j] = paths[np.arange(m), pick]
            back[:, j] = min(j, top) - pick
        out = np.full((m, length), -2, dtype=np.int32)
        place, rows, column = np.full(m, length), np.arange(m), length
        while rows.size:
            column -= 1
            size = back[rows, place[rows]].astype(np.int64)
            place[rows] -= size
            for k in np.unique(size):
                own = rows[size == k]
                out[own, column] = piece[k - 1][own, place[own]]
            rows = rows[place[rows] > 0]
        lone = (out == -1).any(axis=1)
        results = [row[row != -2].astype("<u4").tobytes() for row in out] if m < 4 else self._cut(out)
        for i in np.flatnonzero(lone).tolist():
            results[i] = self._with_bytes(codes[i], out[i])
        return results

    @staticmethod
    def _cut(out: np.ndarray) -> list[bytes]:
        raw, width = out.astype("<i4").tobytes(), out.shape[1] * 4
        first = (out == -2).sum(axis=1) * 4
        return [raw[i * width + f : (i + 1) * width] for i, f in enumerate(first.tolist())]

    def _with_bytes(self, codes: np.ndarray, row: np.ndarray) -> bytes:
        """Unknown code points as byte pieces."""
        ids, at = [], 0
        for piece in row[row != -2].tolist():
            if piece == -1:
                ids += [self.bytes_at[b] for b in chr(codes[at]).encode()]
                at += 1
            else:
                ids.append(piece)
                at += len(self.raw[piece].decode())
        return np.array(ids, dtype="<u4").tobytes()

    def _parts(self, word: str) -> list[str]:
        """The word cut between neighbours that no piece holds together."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        split = []
        for text in texts:
            if "  " in text or MARK in text or "\0" in text or text.startswith(" ") or text.endswith(" "):
                split.append(_WORDS.findall(MARK + text.replace(" ", MARK)))
            else:
                split.append((MARK + text.replace(" ", "\0" + MARK)).split("\0") if text else [])
        distinct = set().union(*split)
        long = {w: self._parts(w) for w in distinct if len(w) > LONG}
        if long:
            split = [[p for w in words for p in long.get(w, (w,))] for words in split]
            distinct = set().union(*split)
        missing = distinct - self.cache.keys()
        if len(self.cache) + len(missing) > self.cache_words:
            self.cache.clear()
            missing = distinct
        by_length: dict[int, list[str]] = {}
        for word in missing:
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            each = max(1, STEP // length)
            for at in range(0, len(words), each):
                part = words[at : at + each]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), length)
                self.cache.update(zip(part, self._search(codes), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


class Merges(Pieces):
    """Ids of a BPE model: neighbours merge by rank, as in the library's encode()."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__(path, cache_words)
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.named = {model.id_to_piece(i): (s, i) for s, i in zip(self.scores.tolist(), self.ids.tolist(), strict=True)}

    def _probe(self, sums: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the substrings [start, end) of rows; -inf and -1 where no piece is."""
        h = mix((sums[rows, end] - sums[rows, start]) * self.inverse[start] + (end - start).astype(U64))
        at = self._find(h)
        hit = self.keys[at] == h
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.ids[at], -1)

    def _search(self, codes: np.ndarray) -> list[bytes]:
        m, length = codes.shape
        if m <= FEW:
            return [self._merge_one(row) for row in codes]
        sums = self._sums(codes)
        every = np.repeat(np.arange(m), length)
        place = np.tile(np.arange(length), m)
        # At the first code point of each symbol: its id, where the one before begins and where
        # it ends, and score and id of what it makes with the next one. -2: inside a symbol.
        out = self._probe(sums, every, place, place + 1)[1].reshape(m, length).astype(np.int32)
        ends = np.tile(np.arange(1, length + 1), (m, 1))
        before = np.tile(np.arange(-1, length), (m, 1))
        score, made = np.full((m, length), -np.inf), np.full((m, length), -1, dtype=np.int32)
        if length > 1:
            two = place < length - 1
            s, i = self._probe(sums, every[two], place[two], place[two] + 2)
            score[:, :-1], made[:, :-1] = s.reshape(m, -1), i.reshape(m, -1)
        rows = np.arange(m)
        while rows.size:
            left = score[rows].argmax(axis=1) if rows.size < m else score.argmax(axis=1)
            more = score[rows, left] > -np.inf
            rows, left = rows[more], left[more]
            right = ends[rows, left]
            end = ends[rows, right]
            out[rows, left], out[rows, right] = made[rows, left], -2
            ends[rows, left], before[rows, end], score[rows, right] = end, left, -np.inf
            score[rows, left] = -np.inf
            on = end < length
            r, a = rows[on], left[on]
            score[r, a], made[r, a] = self._probe(sums, r, a, ends[r, end[on]])
            on = left > 0
            r = rows[on]
            a = before[r, left[on]]
            score[r, a], made[r, a] = self._probe(sums, r, a, end[on])
        whole, flat = out != -2, out.astype("<i4")[out != -2].tobytes()
        cuts = np.concatenate([[0], np.cumsum(whole.sum(axis=1) * 4)]).tolist()
        results = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero((out == -1).any(axis=1)).tolist():
            results[i] = self._with_bytes(codes[i], out[i])
        return results

    def _merge_one(self, codes: np.ndarray) -> bytes:
        """The same for one word, with a heap of neighbours; for words of any length."""
        word, n, named = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), len(codes), self.named
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        out = [named.get(c, (0.0, -1))[1] for c in word]
        heap = [(-named[word[i : i + 2]][0], i, i + 2) for i in range(n - 1) if word[i : i + 2] in named]
        heapq.heapify(heap)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = ends[left]
            # Outdated if one of the two has merged since.
            if out[left] == -2 or right >= end or ends[right] != end:
                continue
            out[left], out[right] = named[word[left:end]][1], -2
            ends[left], before[end] = end, left
            if end < n and (hit := named.get(word[left : ends[end]])):
                heapq.heappush(heap, (-hit[0], left, ends[end]))
            if left and (hit := named.get(word[before[left] : end])):
                heapq.heappush(heap, (-hit[0], before[left], end))
        row = np.array(out, dtype=np.int32)
        return self._with_bytes(codes, row) if -1 in out else row[row != -2].astype("<u4").tobytes()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _field(data: bytes, number: int, default):
    """The last value of a field in a protobuf message: an int or bytes."""
    at, found = 0, default
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        if tag >> 3 == number:
            found = value
    return found


def pieces_of(path: str) -> Pieces:
    """Merges for a BPE model, Pieces for a unigram model."""
    with open(path, "rb") as f:
        kind = _field(_field(f.read(), _TRAINER, b""), _KIND, 1)
    if kind not in (1, _BPE):
        raise ValueError("neither a unigram nor a BPE model")
    return Merges(path) if kind == _BPE else Pieces(path)


@lru_cache(maxsize=1)
def encoders(path: str, searched: bool) -> tuple[Pieces, Pieces | None]:
    """One for each Python worker: its next task finds the model loaded and the caches filled."""
    return pieces_of(path), Pieces(path) if searched else None


SCHEMA = "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_equal boolean"


#: What the search for the highest sum of scores adds.
SEARCHED = ", viterbi_n_ids long, viterbi_crc32 long"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, searched: bool) -> Iterator[pa.RecordBatch]:
    pieces, search = encoders(path, searched)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        every = lambda p: [x for at in range(0, len(texts), TEXTS) for x in p.encode(texts[at : at + TEXTS])]  # noqa: B023, E731
        coded = every(pieces)
        columns = [
            batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()),
            pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([pieces.decode(c) == t for c, t in zip(coded, texts, strict=True)], pa.bool_()),
        ]
        names = ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_equal"]
        if search:
            best = every(search)
            columns += [pa.array([len(c) // 4 for c in best], pa.int64()), pa.array([zlib.crc32(c) for c in best], pa.int64())]
            names += ["viterbi_n_ids", "viterbi_crc32"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True, searched: bool = False) -> DataFrame:
    """Ids of every whole text, their number and CRC, and whether they decode to the text. searched
    adds number and CRC of the ids of the highest sum of scores, by the Viterbi search."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda it: _encoded(it, model, with_ids, searched), SCHEMA + SEARCHED * searched + ", ids array<int>" * with_ids)


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_model(), with_ids=False, searched=True)
