"""Byte-level BPE encoding and decoding, two tiers.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: one
slot per entry, no empty slots) resolves a whole pre-token that is itself an
entry. Tier two: a pre-token that misses is merged by a heap of candidate pairs
over its linked bytes, lowest rank first, leftmost on ties.

The tables are built on the driver from the vocabulary file and broadcast; their
size is the vocabulary's, not the data's. Documents are encoded where they lie:
no shuffle. Workers keep a bounded memory of pre-tokens already resolved, their ids
as 4-byte numbers that a text's are joined from. Decoding takes the entries of a
whole piece of rows at once.

Defined results: a NULL text is an empty text and gives no ids; very long texts
and pre-tokens take n log n time; repeated rows are encoded each; other columns
pass through (one named like an output is replaced by it); empty tables stay empty. Decoding NULL gives empty bytes; an unknown id
is an error.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm.common import hold, let_go, prepare, text_of

#: Pre-tokens a worker remembers before it starts over.
REMEMBER = 300_000
#: Pre-tokens whose number of ids a worker remembers (a number takes half the room of the ids).
REMEMBER_SIZES = 600_000
#: Bytes of a pre-token that is counted by looking through its pairs; the heap pays off beyond.
SCAN_TO = 32
#: Texts are handed on in pieces of about so many characters.
PIECE_CHARS = 4_000_000
_BYTES = [bytes([i]) for i in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Entries of a ``base64 rank`` file, by rank (ranks are 0..n-1)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        entries[int(rank)] = base64.b64decode(token)
    return entries


class PerfectHash:
    """Minimal perfect hash of byte strings: ``slot[key]`` in 0..n-1 without gaps.

    Keys fall into buckets by one half of a 64-bit hash; buckets, largest first,
    get the first displacement that sends all their keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = max(1, len(keys))
        self.m = m = max(1, n // per_bucket)
        self.displace = [0] * m
        self.index = np.full(n, -1, np.int32)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            buckets[(h >> 32) % m].append((h & 0xFFFFFFFF, i))
        used = bytearray(n)
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            if not buckets[b]:
                break
            d = 0
            while True:
                slots = {self._slot(low, d, n) for low, _ in buckets[b]}
                if len(slots) == len(buckets[b]) and not any(used[s] for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for low, i in buckets[b]:
                s = self._slot(low, d, n)
                used[s] = 1
                self.index[s] = i

    @staticmethod
    def _slot(low: int, d: int, n: int) -> int:
        x = (low + d * 0x9E3779B1) & 0xFFFFFFFF
        x = (x ^ (x >> 15)) * 0x85EBCA6B & 0xFFFFFFFF
        return (x ^ (x >> 13)) % n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        return self._slot(h & 0xFFFFFFFF, self.displace[(h >> 32) % self.m], self.n)


class Tables:
    """What a worker needs: the entries by rank, their perfect hash and the pattern."""

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, pattern
        self.hash = PerfectHash(entries)
        self.slots = self.hash.index.tolist()


class Known(dict):
    """Pre-token -> its ids, 4 bytes each; learnt when first asked for."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, token: str) -> bytes:
        raw = self[token] = array("i", self.ids_of(token)).tobytes()
        return raw


class Codec:
    """Encoder and decoder over broadcast tables, with a bounded memory."""

    def __init__(self, tables: Tables):
        self.entries, self.hash, self.slots = tables.entries, tables.hash, tables.slots
        self.find = regex.compile(tables.pattern).findall
        self.pattern = regex.compile(tables.pattern)
        self.known = Known(self.ids_of)
        self.sizes: dict[str, int] = {}
        # rank of a joined pair, for the merges of tier two
        self.rank = {e: i for i, e in enumerate(self.entries)}

    def whole(self, piece: bytes) -> int:
        """Id of a pre-token that is an entry, else -1."""
        i = self.slots[self.hash.slot(piece)]
        return i if i >= 0 and self.entries[i] == piece else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no entry: a heap of pairs over linked bytes."""
        rank, entries = self.rank, self.entries
        get, n = rank.get, len(piece)
        part: list[bytes | None] = list(map(_BYTES.__getitem__, piece))
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        # a pair is one number: its rank, then its place
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & low
            left = part[i]
            if left is None:
                continue
            j = nxt[i]
            if j >= n:
                continue
            pair = entries[x >> bits]
            if left + part[j] != pair:  # one of the two has grown since
                continue
            part[i], part[j] = pair, None
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                s = get(pair + part[k])
                if s is not None:
                    push(heap, s << bits | i)
            p = prev[i]
            if p >= 0:
                s = get(part[p] + pair)
                if s is not None:
                    push(heap, s << bits | p)
        return tuple([rank[p] for p in part if p is not None])

    def ids_of(self, token: str) -> tuple[int, ...]:
        piece = token.encode("utf-8")
        i = self.whole(piece)
        return (i,) if i >= 0 else self.merge(piece)

    def size_of(self, token: str) -> int:
        """How many ids a pre-token has; few pairs are looked through for the lowest rank each time."""
        piece = token.encode("utf-8")
        if self.whole(piece) >= 0:
            return 1
        if len(piece) > SCAN_TO:
            return len(self.merge(piece))
        get, entries = self.rank.get, self.entries
        none = len(entries)
        part = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            r = min(pairs)
            if r == none:
                break
            i = pairs.index(r)
            pair = part[i] = entries[r]
            del part[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(pair + part[i + 1], none)
            if i:
                pairs[i - 1] = get(part[i - 1] + pair, none)
        return len(part)

    def learn_sizes(self, tokens: Iterable[str]) -> dict[str, int]:
        """``sizes`` with all of ``tokens`` in it."""
        if len(self.sizes) > REMEMBER_SIZES:
            self.sizes.clear()
        sizes = self.sizes
        for t in set(tokens).difference(sizes):
            sizes[t] = self.size_of(t)
        return sizes

    def learn(self, tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of every one of ``tokens``."""
        return {t: tuple(np.frombuffer(self.known[t], np.int32).tolist()) for t in set(tokens)}

    def packed(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


_CODECS: dict[int, Codec] = {}
#: Entries by rank, of workers that decode.
_ENTRIES: dict[int, pa.BinaryArray] = {}
#: The driver's broadcasts: tables are built once per context and vocabulary.
_SHARED: dict = {}


def _forget() -> None:
    _CODECS.clear()
    _ENTRIES.clear()


def codec(shared) -> Codec:
    """The worker's codec of a broadcast (one per process and vocabulary), until another operator's task."""
    hold("bpe", _forget)
    if shared.id not in _CODECS:
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


def _entries(shared) -> pa.BinaryArray:
    """The worker's entries of a broadcast by rank: all that decoding needs."""
    hold("bpe", _forget)
    if shared.id not in _ENTRIES:
        _ENTRIES[shared.id] = pa.array(shared.value.entries, pa.binary())
    return _ENTRIES[shared.id]


def decoded_lists(entries: pa.BinaryArray, lists: pa.ListArray) -> pa.BinaryArray:
    """The joined entries of every list of ids (NULL: empty bytes)."""
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("an id is NULL")
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if not len(flat):
        return pa.array([b""] * len(lists), pa.binary())
    # the entries taken lie one after the other: a list's bytes begin with its first and end with its last
    took = entries.take(flat)
    _, offsets, data = took.buffers()
    at = np.frombuffer(offsets, np.int32)[took.offset + ends]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), data or pa.py_buffer(b"")])


def share_tables(spark: SparkSession, vocab: str, pattern: str):
    """Broadcast the tables of a vocabulary file (bounded by the vocabulary)."""
    prepare(spark)
    key = (id(spark.sparkContext), vocab, pattern)
    if key not in _SHARED:
        _SHARED[key] = _Shared(spark.sparkContext.broadcast(Tables(load_ranks(vocab), pattern)))
    return _SHARED[key]


class _Shared:
    """A broadcast with a stable id for the worker's cache."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self) -> Tables:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def _pieces(batch: pa.RecordBatch, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` each, so that outputs stay small."""
    start, held = 0, 0
    for i, s in enumerate(sizes):
        held += s
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocab: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an ``array<int>`` column of token ids; the text column is dropped."""
    shared = share_tables(docs.sparkSession, vocab, pattern)
    rest = [c for c in docs.columns if c not in (text, out)]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(f"`{text}`").alias("_text"))
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for b in batches:
            col = b.column(b.num_columns - 1)
            sizes = pa.compute.binary_length(col).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_CHARS):
                raws = list(map(c.packed, col.slice(lo, hi - lo).to_pylist()))
                ends = np.cumsum([0, *(len(r) >> 2 for r in raws)])
                raw = pa.py_buffer(b"".join(raws))
                del raws
                arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                               pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, raw]))
                kept = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, arr], names=[*rest, out])
        let_go()

    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocab: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with a binary column of the decoded bytes."""
    tokens = tokens.drop(out)
    shared = share_tables(tokens.sparkSession, vocab, pattern)
    names = tokens.columns
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _entries(shared)
        for b in batches:
            col = b.column(at)
            sizes = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_CHARS // 4):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded_lists(entries, part.column(at))], names=[*names, out])
        let_go()

    return tokens.mapInArrow(run, schema)
