"""Hierarchical packing of documents into sequences.

Each document's ids (with the closing id) are cut into full windows and a rest; the rest is
routed to the tier of the smallest context size that holds it. Every tier is packed best
fit decreasing, gaps of the longest windows are filled from the shorter tiers (largest that
fits first), and a last gap takes the head of a shorter document. What is left of a pool is
cut at powers of two, which need no padding. Sequences are dealt to step groups in turn, so
that the groups of a pool hold nearly equal numbers of tokens.

A pool is a bounded number of tokens inside one task: packing needs no shuffle, and a lost
task is repeated with the same result.

Defined cases: a null or empty text is the closing id alone; equal rows are separate
documents; texts longer than a window are cut; of pieces of equal length the earlier document goes
first; an empty table gives no pieces. A very long text is encoded whole in one task and ends its
pool. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 4_000_000
STEP_GROUPS = 8
CACHE_WORDS = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int"
#: A space beside other white space: there a text can't be cut at its spaces alone.
_UNEVEN = re.compile(r" \s|\s ")


_NOT_LATIN = re.compile("[^\\x00-\u024f]")
#: The pattern of byte-level pre-tokenisation: a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level(path: str):
    """The same model in tiktoken if the file is plain byte-level BPE, else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
    if not plain:
        return None
    # The format writes bytes as printable characters: these stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes (as array("I") has them on Spark's platforms).

    The ids are those of the tokenizers library. It spends most of its time on set-up for each
    short string, so Latin chunks not met before go to tiktoken with the same file's merges
    (ranks are ids in this format); everything else goes to the library itself.

    Byte-level pre-tokenisation always begins a new piece at a single space between two
    other characters, so a text is looked up chunk by chunk in a bounded cache; chunks not
    met yet go to the tokenizer together.
    """

    group = 256

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.latin = _byte_level(path)

    def _raw(self, texts: list[str]) -> list[bytes]:
        # No cycles here, and the collector would walk the whole cache again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            if collects:
                gc.enable()

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        latin, other = [], []
        for c in chunks:
            (other if self.latin is None or _NOT_LATIN.search(c) else latin).append(c)
        yield from zip(other, self._raw(other), strict=True)
        if latin:
            encode = self.latin.encode_ordinary
            yield from ((c, array("I", encode(c)).tobytes()) for c in latin)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), self.group):
            yield from self._group(texts[at : at + self.group])

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        chunks = [None if _UNEVEN.search(t) or "\0" in t else t.replace(" ", "\0 ").split("\0") for t in texts]
        distinct = set().union(*filter(None, chunks))
        missing = list(distinct - self.cache.keys())
        if len(self.cache) + len(missing) > self.cache_words:
            self.cache.clear()
            missing = list(distinct)
        self.cache.update(self._chunks(missing))
        get = self.cache.__getitem__
        for text, parts in zip(texts, chunks, strict=True):
            yield self._raw([text])[0] if parts is None else b"".join(map(get, parts))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: its next task finds the tokenizer loaded and the cache filled."""
    return Encoder(path)


class _Open:
    """A sequence that still has room."""

    __slots__ = ("pieces", "room", "size")

    def __init__(self, size: int):
        self.pieces: list[tuple[int, int, int]] = []
        self.room = self.size = size

    def put(self, piece: tuple[int, int, int]) -> None:
        self.pieces.append(piece)
        self.room -= piece[2]


def _best_fit(pieces: list[tuple[int, int, int]], size: int) -> list[_Open]:
    """Best fit over open sequences, longest pieces first; a piece is (document, start, length)."""
    out: list[_Open] = []
    rooms: list[tuple[int, int]] = []  # (room, number), sorted
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        at = bisect.bisect_left(rooms, (piece[2], -1))
        if at == len(rooms):
            out.append(_Open(size))
            number = len(out) - 1
        else:
            number = rooms.pop(at)[1]
        out[number].put(piece)
        if out[number].room:
            bisect.insort(rooms, (out[number].room, number))
    return out


def pack_pool(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for one pool; documents are numbers 0, 1, ..."""
    window = tiers[-1]
    done: list[list[tuple[int, int, int]]] = []
    rest: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % window, window):
            done.append([(doc, start, window)])
        if n % window:
            rest[tiers[bisect.bisect_left(tiers, n % window)]].append((doc, n - n % window, n % window))
    long = _best_fit(rest[window], window)
    # Shorter tiers' pieces by length, to fill the gaps of long windows.
    short = sorted(p[::-1] for t in tiers[:-1] for p in rest[t])  # (length, start, document)
    for seq in long:
        while seq.room and short:
            at = bisect.bisect_right(short, (seq.room, 1 << 62, 1 << 62)) - 1
            if at >= 0:
                length, start, doc = short.pop(at)
                seq.put((doc, start, length))
            else:  # all are longer than the gap: the shortest gives its head
                length, start, doc = short.pop(0)
                head = seq.room
                seq.put((doc, start, head))
                bisect.insort(short, (length - head, start + head, doc))
    # What the gaps left is packed in its own tiers; full sequences of a tier stand as they are.
    open_ = [s for s in long if s.room]
    left = {t: [] for t in tiers[:-1]}
    for length, start, doc in short:
        left[tiers[bisect.bisect_left(tiers, length)]].append((doc, start, length))
    for t in tiers[:-1]:
        open_ += _best_fit(left[t], t)
    done += [s.pieces for s in long if not s.room]
    done += [s.pieces for s in open_ if not s.room]
    # The others run together into windows; the last is cut at powers of two.
    run = [p for s in open_ if s.room for p in s.pieces]
    total = sum(p[2] for p in run)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
    at = 0
    for size in sizes:
        seq, room = [], size
        while room:
            doc, start, length = run[at]
            take = min(room, length)
            seq.append((doc, start, take))
            room -= take
            if take == length:
                at += 1
            else:
                run[at] = (doc, start + take, length - take)
        done.append(seq)
    return done


def _packed(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int, pool_tokens: int, groups: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = end_id.to_bytes(4, "little")
    first = TaskContext.get().partitionId() << 36
    ids: list[int | None] = []
    coded: list[bytes] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal first, held
        sequences = pack_pool([len(c) // 4 for c in coded], tiers)
        # Fullest first, dealt in turn and back: groups of equal counts and nearly equal tokens.
        order = sorted(range(len(sequences)), key=lambda i: -sum(p[2] for p in sequences[i]))
        group = {i: (k % groups if k // groups % 2 == 0 else groups - 1 - k % groups) for k, i in enumerate(order)}
        rows: list[tuple] = []
        for number, seq in enumerate(sequences):
            size = sum(p[2] for p in seq)
            tier = tiers[bisect.bisect_left(tiers, size)]
            offset = 0
            for doc, start, length in seq:
                rows.append((ids[doc], start, length, zlib.crc32(coded[doc][4 * start : 4 * (start + length)]), len(coded[doc]) // 4, first + number, offset, tier, group[number]))
                offset += length
        first += len(sequences)
        ids.clear()
        coded.clear()
        held = 0
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000], strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc, raw in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
            ids.append(doc)
            coded.append(raw + end)
            held += len(coded[-1]) // 4
            if held >= pool_tokens:
                yield from flush()
    if coded:
        yield from flush()


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, step_groups: int = STEP_GROUPS) -> DataFrame:
    """One row per piece of a document in a sequence; tokenizer is the path of a tokenizers file
    that every executor has. Tiers are powers of two, ascending; the last is the window."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    return docs.select("doc_id", "text").mapInArrow(lambda it: _packed(it, tokenizer, tiers, end_id, pool_tokens, step_groups), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_tokenizer())
