"""SentencePiece encoding and decoding for merge-type vocabularies.

The model file lists pieces with scores. A text is written with a leading space,
spaces become U+2581, every code point is a symbol, and adjacent symbols that form
a piece stand on an agenda ordered by score (ties: leftmost). The best pair is
merged and its new neighbours join the agenda until it is empty; symbols that are no
piece become the byte pieces of their UTF-8 form.

No merge reaches across a place that no piece spans, so a text is cut there (before
a run of U+2581, around characters that stand in no longer piece) and each segment's
ids are remembered, a bounded number of them, by the worker. Cuts and characters
are read off the vocabulary, not assumed. Documents are encoded where they lie: no
shuffle; only the model file is broadcast. ``disagreements`` runs the sentencepiece
library beside it over whole Arrow batches and returns the rows that differ.

Defined results: a NULL text is an empty text (no ids but the end id); segments and
very long texts take n log n time; repeated rows are encoded each; other columns pass through (one
named like an output is replaced by it); empty tables stay empty. Decoding NULL gives
the empty text; an unknown id is an error. Models of other types, with a character
map, own symbols or without byte pieces are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm.bpe import _pieces
from airseries.llm.common import prepare, text_of

#: Segments a worker remembers before it starts over.
REMEMBER = 300_000
#: Texts are handed on in pieces of about so many bytes.
PIECE_BYTES = 4_000_000
SPACE = "▁"
# Fixed values of the model format: piece types and the type of a merge-type model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
#: Segments up to so many code points keep their agenda in a list.
SHORT = 32
#: No piece.
NEVER = 1 << 60
#: A letter, as the segment patterns see it.
LETTER = re.compile(r"[^\W\d_]")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value, i = raw[i:i + size], i + size
        yield key >> 3, value


class Model:
    """Pieces, scores and types of a model file, by id."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.types.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("not a merge-type model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("models that rewrite characters or white space are not supported")
        if not trainer.get(35) or {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError("models without byte pieces, or with own or unused symbols, are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        control = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == CONTROL}
        self.begin = control.get(trainer.get(46, b"<s>").decode("utf-8"))
        self.end = control.get(trainer.get(47, b"</s>").decode("utf-8"))


def _listed(chars: set[str]) -> str:
    """Characters as the inside of a pattern's class."""
    return "".join(re.escape(c) for c in sorted(chars)) or "\\0"


class Codec:
    """Encoder and decoder of one model, with a bounded memory."""

    def __init__(self, raw: bytes):
        m = self.model = Model(raw)
        normal = [i for i, t in enumerate(m.types) if t == NORMAL]
        self.ids = {m.pieces[i]: i for i in normal}
        #: The agenda serves the least first: places of the scores, from high to low.
        place = {score: k for k, score in enumerate(sorted({m.scores[i] for i in normal}, reverse=True))}
        self.cost = {m.pieces[i]: place[m.scores[i]] for i in normal if len(m.pieces[i]) > 1}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(m.pieces, m.types, strict=True)):
            if kind == BYTE:
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind == CONTROL:
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append((m.unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode("utf-8"))
        self.segments = re.compile(self._cuts()).findall
        #: Segments with their ids as int32 bytes.
        self.known: dict[str, bytes] = {}

    def _cuts(self) -> str:
        """A pattern whose matches are the segments of a text: no piece spans two of them."""
        lone = {chr(c) for c in range(256)} - set(chain.from_iterable(self.cost))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.cost):
            return f"(?s)[^{_listed(lone)}]+|."
        # a run of letters ends before a character that no piece has right behind a letter
        joins = {p[i] for p in self.cost for i in range(1, len(p)) if LETTER.match(p[i - 1]) and not LETTER.match(p[i])}
        lone = {c for c in lone if not LETTER.match(c)}
        rest = f"[^{SPACE}{_listed(lone)}]*"
        tail = f"{LETTER.pattern}+(?:[{_listed(joins)}]{rest})?|[^{SPACE}{_listed(lone)}]{rest}"
        return f"(?s){SPACE}+(?:{tail})?|{tail}|."

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: the agenda of adjacent pairs, best score first, leftmost on ties."""
        out: list[int] = []
        for symbol in (self._few if len(segment) <= SHORT else self._many)(segment):
            i = self.ids.get(symbol)
            if i is None:
                out += map(self.byte_ids.__getitem__, symbol.encode("utf-8"))
            else:
                out.append(i)
        return out

    def _few(self, segment: str) -> list[str]:
        """Symbols of a short segment: its agenda is a list with one entry per adjacent pair."""
        get = self.cost.get
        part = list(segment)
        agenda = [get(a + b, NEVER) for a, b in zip(segment, segment[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            part[i] = pair = part[i] + part[i + 1]
            del part[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(pair + part[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(part[i - 1] + pair, NEVER)
        return part

    def _many(self, segment: str) -> list[str]:
        """Symbols of a segment of any length: its agenda is a heap over linked symbols."""
        get = self.cost.get
        n = len(segment)
        part: list[str | None] = list(segment)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i) for i in range(n - 1) if (c := get(segment[i:i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            c, i = heapq.heappop(agenda)
            j = nxt[i]
            if part[i] is None or j >= n or get(pair := part[i] + part[j]) != c:
                continue  # merged away, or one of the two has grown since
            part[i], part[j] = pair, None
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (c := get(pair + part[k])) is not None:
                    heapq.heappush(agenda, (c, i))
            p = prev[i]
            if p >= 0 and (c := get(part[p] + pair)) is not None:
                heapq.heappush(agenda, (c, p))
        return [p for p in part if p is not None]

    def packed(self, text: str) -> bytes:
        """Ids of a text as int32 bytes."""
        if not text:
            return b""
        if self.model.prefix:
            text = " " + text
        segments = self.segments(text.replace(" ", SPACE))
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for s in set(segments).difference(known):
            known[s] = array("i", self.merge(s)).tobytes()
        return b"".join(map(known.__getitem__, segments))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        types, of = self.model.types, self.bytes_of
        lead = 0
        while lead < len(ids) and types[ids[lead]] == CONTROL:
            lead += 1
        skip = int(self.model.prefix and lead < len(ids) and types[ids[lead]] == NORMAL and
                   self.model.pieces[ids[lead]].startswith(SPACE))
        try:
            return b"".join(map(of.__getitem__, ids))[skip:].decode("utf-8")
        except UnicodeDecodeError:
            pass
        out, held = [], b""
        for i in ids:  # byte pieces in a row are read together
            if types[i] == BYTE:
                held += of[i]
                continue
            out += [_lenient(held), of[i].decode("utf-8")]
            held = b""
        return "".join([*out, _lenient(held)])[skip:]


def _lenient(raw: bytes) -> str:
    """UTF-8 read code point by code point; a byte that starts none is U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        i += size
    return "".join(out)


_CODEC: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """The worker's codec of a model; a worker holds one at a time."""
    key = xxhash.xxh128_hexdigest(raw)
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(raw)
    return _CODEC[key]


def _share(df: DataFrame, model: str):
    """Broadcast a model file (bounded by the vocabulary), checked on the driver."""
    prepare(df.sparkSession)
    with open(model, "rb") as f:
        raw = f.read()
    Model(raw)
    return df.sparkSession.sparkContext.broadcast(raw)


def _ends(c: Codec, begin: bool, end: bool) -> tuple[bytes, bytes]:
    def pack(i: int) -> bytes:
        return np.array([i], np.int32).tobytes()
    return pack(c.model.begin) if begin else b"", pack(c.model.end) if end else b""


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids", begin: bool = False,
           end: bool = False) -> DataFrame:
    """``docs`` with an ``array<int>`` column of piece ids; the text column is dropped."""
    shared = _share(docs, model)
    rest = [c for c in docs.columns if c not in (text, out)]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(f"`{text}`").alias("_text"))
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        first, last = _ends(c, begin, end)
        for b in batches:
            col = b.column(b.num_columns - 1)
            sizes = pc.binary_length(col).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_BYTES):
                flat = [first + c.packed(t) + last for t in col.slice(lo, hi - lo).to_pylist()]
                starts = np.cumsum([0, *map(len, flat)]) // 4
                arr = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
                kept = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, arr], names=[*rest, out])

    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with a string column of the decoded text."""
    tokens = tokens.drop(out)
    shared = _share(tokens, model)
    names = tokens.columns
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            sizes = pc.list_value_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_BYTES // 4):
                part = b.slice(lo, hi - lo)
                texts = [c.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else [])
                         for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, out])

    return tokens.mapInArrow(run, schema)


def disagreements(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ids or decoded text differ from the sentencepiece library's,
    with both id lists; each Arrow batch goes through the library and this module."""
    shared = _share(docs, model)
    lists = T.ArrayType(T.IntegerType())
    named = [c for c in docs.columns if c not in ("ids", "library_ids")]
    schema = T.StructType([*[docs.schema[c] for c in named], T.StructField("ids", lists), T.StructField("library_ids", lists)])
    src = docs.select(*[F.col(f"`{c}`") for c in named], text_of(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        c = codec(shared.value)
        for b in batches:
            texts: Iterable[str] = b.column(b.num_columns - 1).to_pylist()
            theirs = library.encode(texts, num_threads=1)
            ours = [c.encode(t) for t in texts]
            bad = [i for i, (x, y) in enumerate(zip(ours, theirs, strict=True)) if x != y or c.decode(x) != library.decode(y)]
            part = b.take(pa.array(bad, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([ours[i] for i in bad], pa.list_(pa.int32())),
                 pa.array([theirs[i] for i in bad], pa.list_(pa.int32()))], names=[*named, "ids", "library_ids"])

    return src.mapInArrow(run, schema)
