"""Alignment of two tokenizers over the same bytes, scored by inverted pair bitmaps.

A byte-level BPE (A) and a merge-type piece model (B) cut the same bytes; offsets
where a token of each ends cut both into groups, and the two tokens that end there are
a link. Per pair of ids the documents that link it are a compressed bitmap over a
chunk's document slots (sorted 16-bit slots while that is shorter, else 65,536 bits;
as in ``bitmap_or``, partial bitmaps of a chunk are OR-merged when it closes), and how
often a document links it stands in multiplicity planes: plane 0 holds the documents,
plane k the documents whose count less one has bit k - 1. Popcounts give document
counts, popcounts times the planes' weights give link counts (``pair_counts``); both are
sums over chunks, so the hottest pair is pre-aggregated like any other.

The counts go back the same way: each pair's score is joined to its postings, and the
postings of a chunk, cogrouped with its documents, return every document's sums. A
chunk holds at most 65,536 documents and, but for one longer text, about a million postings:
no task holds an unbounded group. Texts are tokenised once; documents and postings are
written to the shared folder together, so a lost task costs its own rows again.

Defined results: NULL and empty texts, and texts whose tokens do not give back their
bytes (U+2581 in a text is one), have no tokens: zeros and no groups. Very long texts are
taken whole. Repeated rows are rows of their own. Pairs of equal count are all best.
Empty tables stay empty. Columns named like an output are replaced by it, others pass.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm import bpe, piece
from airseries.llm.common import Scratch, prepare

#: Documents of a chunk: a slot is 16 bits.
SLOTS = 1 << 16
#: Bytes of a plain bitmap; sorted slots are used while they are shorter.
DENSE = SLOTS // 8
#: A chunk closes when it holds so many postings.
POSTINGS = 1_000_000
#: Texts are tokenised in runs of about so many bytes, new stretches in blocks of so many characters.
RUN_BYTES, BLOCK_CHARS = 1_000_000, 60_000
#: Stretches a worker remembers before it starts over.
REMEMBER = 200_000
#: Spaces and what follows them; where other white space stands before a space, the exact cut.
RUNS = re.compile(r" +[^ ]*")
WHITE_BEFORE = re.compile(r"[^\S ] ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: The byte alphabet of the vocabulary file: printable bytes stand for themselves, the
#: others, in order, for the code points from 256.
_SELF = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

OUTPUTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def byte_entries(path: str) -> list[bytes]:
    """Entries of a byte-level BPE file, by id; ids must rise with the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["id"] for t in spec.get("added_tokens", [])}
    listed = sorted((i, t) for t, i in vocab.items() if i not in special)
    if spec["model"]["type"] != "BPE" or [i for i, _ in listed] != list(range(len(listed))):
        raise ValueError("not a byte-level BPE with gapless ids")
    joined = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in merges]
    if [vocab[t] for t in joined] != list(range(256, 256 + len(joined))):
        raise ValueError("ids do not rise with the merges")
    other = [b for b in range(256) if b not in set(_SELF)]
    value = {chr(b): b for b in _SELF} | {chr(256 + k): b for k, b in enumerate(other)}
    return [bytes(map(value.__getitem__, t)) for _, t in listed]


class Pair:
    """Both tokenizers of a worker (their libraries), and what it knows of stretches of text.

    Both cut a text before a space behind another character than white space: A's pattern
    starts a match there, and no piece of B spans it (else texts are taken whole). Such a
    stretch therefore always gives the same groups and links, and is aligned once."""

    def __init__(self, entries: list[bytes], pattern: str, raw: bytes):
        import sentencepiece
        import tiktoken
        model = piece.Codec(raw)  # refuses models that rewrite text
        self.apart = not any(re.search(f"[^{piece.SPACE}]{piece.SPACE}", t) for t in model.cost)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={e: i for i, e in enumerate(entries)}, special_tokens={})
        self.own = None
        self.tables = entries, pattern
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.space = model.merge(piece.SPACE)  # B's tokens of a lone space: an empty text gets none of its own
        self.len_a = np.array([len(e) for e in entries], np.int64)
        self.len_b = np.array([len(e) for e in model.bytes_of], np.int64)
        # digits and the mark behind them: A's list ends with "|", B's with ";"
        self.digits = [b"%d%s" % (i, mark) for n, marks in ((len(entries), b",|"), (len(model.bytes_of), b",;"))
                       for i in range(n) for mark in (marks[:1], marks[1:])]
        #: Stretch -> groups, links as packed pairs, and its tokens of A << 32 | of B.
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    def ids_a(self, text: str) -> np.ndarray:
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except Exception:  # noqa: BLE001 - its pattern search gives up on runs of white space of a million and more
            if self.own is None:
                self.own = bpe.Codec(bpe.Tables(*self.tables))
            return np.array(self.own.encode(text), np.int64)

    def stretches(self, text: str) -> list[str]:
        """A text, with the space before it, in stretches that each start with a space.

        A text with U+2581 has none: B gives it back with spaces. Any other text comes back
        whole from both: A cuts it in order, B writes all but spaces as they are."""
        if not text or piece.SPACE in text:
            return []
        text = " " + text
        if not self.apart:
            return [text]
        return BEFORE_SPACE.split(text) if WHITE_BEFORE.search(text) else RUNS.findall(text)

    def learn(self, stretches: list[str]) -> None:
        """Align stretches that are not known yet, all at once over their joined bytes."""
        open_ended = [c for c in stretches if c[-1].isspace()]  # would melt into what follows
        rest = [c for c in stretches if not c[-1].isspace()]
        blocks, held = [], 0
        for c in rest:
            if not held:
                blocks.append([])
            blocks[-1].append(c)
            held += len(c)
            if held >= BLOCK_CHARS or not self.apart:
                held = 0
        blocks += [[c] for c in open_ended]
        joined = ["".join(block) for block in blocks]
        a = np.concatenate([self.ids_a(t) for t in joined])
        ids_b = self.b.encode([t[1:] for t in joined], num_threads=1)
        b = np.concatenate([np.array(x if t != " " else self.space, np.int64) for x, t in zip(ids_b, joined, strict=True)])
        order = rest + open_ended
        ends = np.cumsum([len(c.encode("utf-8")) for c in order])
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        if end_a[-1] != ends[-1] or end_b[-1] != ends[-1]:
            raise ValueError("tokens do not give back the text")
        at = np.zeros(int(ends[-1]) + 1, bool)
        at[end_a] = True
        cut_b = at[end_b]              # a token of A ends here too
        at[:] = False
        at[end_b] = True
        cut_a = at[end_a]
        # groups: A's tokens of a group, then B's; a mark behind the last of each
        starts_b = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
        stops_a = np.flatnonzero(cut_a) + 1
        mixed = np.empty(len(a) + len(b), np.int64)
        mixed[np.arange(len(a)) + starts_b[np.cumsum(cut_a) - cut_a]] = a * 2 + cut_a
        mixed[np.arange(len(b)) + stops_a[np.cumsum(cut_b) - cut_b]] = (b + len(self.len_a)) * 2 + cut_b
        links = (a[cut_a] << 32 | b[cut_b]).tobytes()
        upto_a, upto_b = np.searchsorted(end_a, ends, side="right"), np.searchsorted(end_b, ends, side="right")
        upto_link = np.concatenate([[0], np.cumsum(cut_a)])[upto_a] * 8
        sizes = (np.diff(upto_a, prepend=0) << 32 | np.diff(upto_b, prepend=0)).tolist()
        marks, listed = self.digits, mixed.tolist()
        lo = link = 0
        for c, hi, to, size in zip(order, (upto_a + upto_b).tolist(), upto_link.tolist(), sizes, strict=True):
            self.known[c] = b"".join(map(marks.__getitem__, listed[lo:hi]))[:-1], links[link:to], size
            lo, link = hi, to


_PAIR: dict[int, Pair] = {}


def _pair(key: int, shared) -> Pair:
    """The worker's tokenizers; a worker holds one pair at a time."""
    if key not in _PAIR:
        _PAIR.clear()
        _PAIR[key] = Pair(*shared.value)
    return _PAIR[key]


class Run:
    """Groups and links of some documents."""

    def __init__(self, p: Pair, texts: list[str]):
        cut = [p.stretches(t) for t in texts]
        if len(p.known) > REMEMBER:
            p.known.clear()
        if fresh := set().union(*cut).difference(p.known):
            p.learn(list(fresh))
        known = [list(map(p.known.__getitem__, c)) for c in cut]
        self.groups = [b";".join([k[0] for k in ks]) for ks in known]
        links = [b"".join([k[1] for k in ks]) for ks in known]
        sizes = np.array([sum([k[2] for k in ks]) for ks in known], np.int64)
        self.n_a, self.n_b = sizes >> 32, sizes & 0xFFFFFFFF
        self.n_groups = np.array([len(x) // 8 for x in links], np.int64)
        pairs = np.frombuffer(b"".join(links), np.int64)
        self.link_a, self.link_b = pairs >> 32, pairs & 0xFFFFFFFF
        self.doc = np.repeat(np.arange(len(texts)), self.n_groups)


def pack(keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Bitmaps of sorted, distinct ``pair << 16 | slot`` keys: the pairs and their slots, compressed."""
    pairs = keys >> 16
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(keys) else np.zeros(0, np.int64)
    slots = (keys & (SLOTS - 1)).astype("<u2")
    bounds = np.append(first, len(keys))
    sizes = np.diff(bounds)
    if not (sizes * 2 >= DENSE).any():
        bitmaps = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * 2).astype(np.int32)),
                                                                 pa.py_buffer(slots)])
        return pairs[first], bitmaps
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        part = slots[lo:hi]
        if (hi - lo) * 2 >= DENSE:
            bits = np.zeros(SLOTS, np.uint8)
            bits[part] = 1
            part = np.packbits(bits)
        out.append(part.tobytes())
    return pairs[first], pa.array(out, pa.binary())


def slots_of(bitmap: bytes) -> np.ndarray:
    """The slots of one compressed bitmap."""
    if len(bitmap) < DENSE:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every set bit of a column of bitmaps."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    dense = sizes >= DENSE
    sparse = bitmaps.filter(pa.array(~dense)) if dense.any() else bitmaps
    data = np.frombuffer(b"".join(sparse.to_pylist()), "<u2").astype(np.int64)
    rows = [np.repeat(np.flatnonzero(~dense), sizes[~dense] // 2)]
    slots = [data]
    for r in np.flatnonzero(dense).tolist():
        found = slots_of(bitmaps[r].as_py())
        rows.append(np.full(len(found), r))
        slots.append(found)
    return np.concatenate(rows), np.concatenate(slots)


def bitmap_or(parts: list[np.ndarray]) -> np.ndarray:
    """Partial bitmaps, as sorted keys, OR-merged (a stable sort merges sorted runs)."""
    keys = np.sort(np.concatenate(parts), kind="stable")
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


class Chunk:
    """Postings of the documents that share one slot space."""

    def __init__(self, number: int):
        self.number, self.docs, self.held = number, 0, 0
        self.planes: dict[int, list[np.ndarray]] = {}

    def add(self, run: Run, width: int) -> np.ndarray:
        """Slots of the run's documents; its links join the planes."""
        slots = self.docs + np.arange(len(run.n_a))
        pairs = run.link_a * width + run.link_b
        keys, counts = np.unique(pairs << 16 | slots[run.doc], return_counts=True)
        more, k = counts - 1, 0
        self.planes.setdefault(0, []).append(keys)
        while len(keys) and more.any():
            k += 1
            self.planes.setdefault(k, []).append(keys[more & 1 == 1])
            more >>= 1
        self.docs += len(run.n_a)
        self.held += len(keys)
        return slots

    def rows(self, names: list[str], doc_types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for plane, parts in sorted(self.planes.items()):
            pairs, bitmaps = pack(bitmap_or(parts))
            n = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(n, t) for t in doc_types], pa.array(np.full(n, self.number)), pa.nulls(n, pa.int32()),
                 pa.array(pairs), pa.array(np.full(n, plane), pa.int32()), bitmaps], names=names)


def _tokenised(docs: DataFrame, shared, width: int, text: str, digest: bool) -> DataFrame:
    """Rows of two kinds: documents (with chunk and slot, ``_pair`` NULL) and postings (``_pair``, plane, bitmap)."""
    rest = [c for c in docs.columns if c not in (text, *OUTPUTS)]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    fields = [T.StructField("_row", src.schema["_row"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    fields += [T.StructField("groups", T.StringType()), T.StructField("_chunk", T.LongType()), T.StructField("_slot", T.IntegerType()),
               T.StructField("_pair", T.LongType()), T.StructField("_plane", T.IntegerType()), T.StructField("_bitmap", T.BinaryType())]
    names = [f.name for f in fields]
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pair(key, shared)
        base = TaskContext.get().partitionId() << 32
        chunk, doc_types = Chunk(base), None
        for b in batches:
            texts = b.column(1)
            doc_types = [b.column(0).type, *[pa.int64()] * 3, pa.string()]
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in bpe._pieces(b, sizes, RUN_BYTES):
                if chunk.docs and (chunk.docs + hi - lo > SLOTS or chunk.held >= POSTINGS):
                    yield from chunk.rows(names, doc_types)
                    chunk = Chunk(chunk.number + 1)
                r = Run(p, texts.slice(lo, hi - lo).to_pylist())
                slots = chunk.add(r, width)
                if digest:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in r.groups]
                else:
                    groups = [g.decode("ascii") for g in r.groups]
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(r.n_a), pa.array(r.n_b), pa.array(r.n_groups), pa.array(groups, pa.string()),
                     pa.array(np.full(n, chunk.number)), pa.array(slots, pa.int32()), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if doc_types:
            yield from chunk.rows(names, doc_types)

    return src.mapInArrow(run, T.StructType(fields))


def popcount(bitmap: Column) -> Column:
    """Documents of a compressed bitmap."""
    size = F.octet_length(bitmap)
    return F.when(size < DENSE, (size / 2).cast("long")).otherwise(F.bitmap_count(bitmap))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(_pair, n_docs, n_links) of a table of postings."""
    n = postings.select("_pair", "_plane", popcount(F.col("_bitmap")).alias("n"))
    weight = F.when(F.col("_plane") <= 1, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, _plane - 1)"))
    return n.groupBy("_pair").agg(F.sum(F.when(F.col("_plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"),
                                  F.sum(F.col("n") * weight).alias("n_links"))


def _return_scores(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with n_best and count_sum, from the scored postings of their own chunk."""
    schema = T.StructType([*docs.schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = schema.names

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        best, total = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        left = left.combine_chunks()
        for b in left.to_batches():
            rows, slots = unpack(b.column("_bitmap"))
            plane = b.column("_plane").to_numpy(zero_copy_only=False).astype(np.int64)
            weight = np.int64(1) << np.maximum(plane - 1, 0)
            links = b.column("n_links").to_numpy(zero_copy_only=False)
            top = b.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(total, slots, (weight * links)[rows])
            np.add.at(best, slots, (weight * top)[rows])
        at = right.column("_slot").to_numpy()
        return pa.Table.from_arrays([*right.columns, pa.array(best[at]), pa.array(total[at])], names=names)

    return scored.withColumnRenamed("_chunk", "_of").groupBy("_of").cogroup(docs.groupBy("_chunk")).applyInArrow(back, schema)


def align(docs: DataFrame, vocab_a: str, pattern: str, model_b: str, *, text: str = "text", digest: bool = False,
          counts: bool = False):
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups (as text, or its SHA-256 with ``digest``).

    With ``counts``, also the table (a, b, n_docs, n_links) of every linked pair of ids."""
    spark = docs.sparkSession
    prepare(spark)
    entries = byte_entries(vocab_a)
    with open(model_b, "rb") as f:
        raw = f.read()
    width = len(piece.Model(raw).pieces)
    shared = spark.sparkContext.broadcast((entries, pattern, raw))  # bounded by the vocabularies
    scratch = Scratch(spark)
    both = scratch.write(_tokenised(docs, shared, width, text, digest), "align")
    postings = both.where("_pair IS NOT NULL").select("_chunk", "_pair", "_plane", "_bitmap")
    rows = both.where("_pair IS NULL").drop("_pair", "_plane", "_bitmap")
    pairs = scratch.write(pair_counts(postings), "align-pairs")
    top = pairs.groupBy((F.col("_pair") % width).alias("_b")).agg(F.max("n_links").alias("_top"))
    judged = (pairs.select("_pair", "n_links", (F.col("_pair") % width).alias("_b")).join(top, "_b")
              .select("_pair", "n_links", (F.col("n_links") == F.col("_top")).alias("best")))
    scored = postings.join(judged, "_pair").drop("_pair")
    done = _return_scores(scored, rows)
    rest = [F.col(f"_row.`{c}`") for c in rows.schema["_row"].dataType.names]
    out = done.select(*rest, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
    if not counts:
        return out
    return out, pairs.select(F.expr(f"CAST(_pair DIV {width} AS INT)").alias("a"), (F.col("_pair") % width).cast("int").alias("b"),
                             "n_docs", "n_links")
