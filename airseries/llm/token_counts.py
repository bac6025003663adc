"""Token counts that follow edits, with a segment tree of pre-tokens per document.

``build`` counts every document once and keeps, per document, the length and the
token count of each pre-token. ``apply_edits`` hangs them in a segment tree (leaves:
blocks of pre-tokens; nodes: sums of characters and of tokens below), finds the place
of an edit by descending, re-encodes from the last pre-token whose match cannot
have seen the edit until a new pre-token starts where an old one behind the
edit did, and adds the difference along the path to the root. What lies outside is
neither scanned nor encoded again.

The pre-token pattern looks ahead, never back; a match reads at most ``LOOK`` characters
behind its end, which gives the boundary context.

Defined results: NULL text is an empty text (0 tokens); an edit is (start, length,
text) in code points, applied in order, each to the result of the one before;
starts and lengths beyond the text are clipped, negative ones count as 0; NULL in an
edit counts as 0 or as empty; NULL or missing edits change nothing; repeated rows are
each counted; other columns of the documents pass through ``build`` (one named like an
output is replaced by it); rows with one doc_id all get that doc_id's edits (NULL doc_id: none); empty
tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm.bpe import PIECE_CHARS, Codec, _pieces, codec, share_tables
from airseries.llm.common import text_of

#: Pre-tokens of a leaf; a leaf that outgrows four times this makes the tree be laid out anew.
BLOCK = 64
#: Characters behind its end that a match of the pattern reads at most.
LOOK = 2
EDITS = "array<struct<start:int,length:int,text:string>>"
STATE = ("lens", "counts", "n_tokens")


class Tree:
    """Blocks of pre-tokens under sums of characters and tokens."""

    def __init__(self, lens: np.ndarray, counts: np.ndarray):
        self._lay_out(np.asarray(lens, np.int32), np.asarray(counts, np.int32))

    def _lay_out(self, lens: np.ndarray, counts: np.ndarray) -> None:
        """Sums over the packed leaves; a block becomes a list when an edit touches it."""
        starts = np.arange(0, max(len(lens), 1), BLOCK)
        self.lens: list = [lens[i:i + BLOCK] for i in starts]
        self.counts: list = [counts[i:i + BLOCK] for i in starts]
        self.size = 1 << (len(starts) - 1).bit_length()
        self.chars, self.tokens = (self._sums(v, starts) for v in (lens, counts))

    def _sums(self, values: np.ndarray, starts: np.ndarray) -> list[int]:
        level = np.zeros(self.size, np.int64)
        if len(values):
            level[:len(starts)] = np.add.reduceat(values.astype(np.int64), starts)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def packed(self) -> tuple[bytes, bytes]:
        """lens and counts of all leaves as int32 bytes."""
        return tuple(np.concatenate([np.asarray(b, np.int32) for b in rows]).tobytes() for rows in (self.lens, self.counts))

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, char: int) -> tuple[int, int, int]:
        """(block, index, start) of the pre-token that holds a character; the end if none does."""
        if char >= self.chars[1]:
            last = len(self.lens) - 1
            return last, len(self.lens[last]), self.chars[1]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.size
        for i, n in enumerate(map(int, self.lens[block])):
            if char < start + n:
                return block, i, start
            start += n
        raise AssertionError("sums and leaves differ")

    def following(self, block: int, i: int) -> Iterator[tuple[int, int, int]]:
        """(block, index, length) of the pre-tokens from a place on."""
        while block < len(self.lens):
            for j in range(i, len(self.lens[block])):
                yield block, j, int(self.lens[block][j])
            block, i = block + 1, 0

    def replace(self, begin: tuple[int, int], end: tuple[int, int], lens: list[int], counts: list[int]) -> None:
        """Puts pre-tokens in the place of those in [begin, end), and mends the sums above."""
        (b, i), (c, j) = begin, end
        for rows, new in ((self.lens, lens), (self.counts, counts)):
            for k in {b, c}:
                rows[k] = list(rows[k])
            if b == c:
                rows[b][i:j] = new
            else:
                rows[b][i:] = new
                for k in range(b + 1, c):
                    rows[k] = []
                rows[c][:j] = []
        if len(self.lens[b]) > 4 * BLOCK:
            self._lay_out(*(np.frombuffer(x, np.int32) for x in self.packed()))
            return
        for k in range(b, c + 1):
            node = k + self.size
            more, plus = int(sum(self.lens[k])) - self.chars[node], int(sum(self.counts[k])) - self.tokens[node]
            while node and (more or plus):
                self.chars[node] += more
                self.tokens[node] += plus
                node //= 2


def edited(c: Codec, tree: Tree, text: str, start: int, length: int, insert: str) -> tuple[str, int]:
    """The text after an edit, and how many pre-tokens were encoded for it."""
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    new = text[:start] + insert + text[start + length:]
    shift, behind = len(insert) - length, start + length
    b, i, old = tree.find(max(0, start - LOOK))
    pos, begin = old, (b, i)
    rest = tree.following(b, i)
    at, end = next(rest, None), begin
    lens, pieces = [], []
    while True:
        # old pre-tokens that start before this place are gone
        while at is not None and old < pos - shift:
            old += at[2]
            end = (at[0], at[1] + 1)
            at = next(rest, None)
        if pos >= start + len(insert) and old == pos - shift and old >= behind:
            end = (at[0], at[1]) if at is not None else end
            break
        if pos >= len(new):
            break
        m = c.pattern.match(new, pos)
        pieces.append(m[0])
        lens.append(m.end() - pos)
        pos = m.end()
    sizes = c.learn_sizes(pieces)
    tree.replace(begin, end, lens, [sizes[p] for p in pieces])
    return new, len(pieces)


def build(docs: DataFrame, vocab: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with its state: lens, counts (int32 bytes, a number per pre-token) and n_tokens."""
    shared = share_tables(docs.sparkSession, vocab, pattern)
    rest = [c for c in docs.columns if c != text and c not in STATE]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(f"`{text}`").alias(text))
    schema = T.StructType([*src.schema.fields, *T._parse_datatype_string(
        "lens binary, counts binary, n_tokens long").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for b in batches:
            col = b.column(b.num_columns - 1)
            sizes = pa.compute.binary_length(col).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_CHARS):
                lens, counts, totals = [], [], []
                for t in col.slice(lo, hi - lo).to_pylist():
                    tokens = c.find(t)
                    n = np.fromiter(map(c.learn_sizes(tokens).__getitem__, tokens), np.int32, len(tokens))
                    lens.append(np.fromiter(map(len, tokens), np.int32, len(tokens)).tobytes())
                    counts.append(n.tobytes())
                    totals.append(int(n.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, hi - lo).columns, pa.array(lens, pa.binary()), pa.array(counts, pa.binary()),
                     pa.array(totals, pa.int64())], names=names)

    return src.mapInArrow(run, schema)


def apply_edits(state: DataFrame, edits: DataFrame, vocab: str, pattern: str, *, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The state after ``edits``: a table of (doc_id, seq, start, length, text), applied by seq."""
    listed = edits.groupBy(F.col(doc_id).alias("_id")).agg(F.sort_array(F.collect_list(
        F.struct("seq", "start", "length", F.col("text").alias("text")))).alias("_e"))
    trimmed = listed.select("_id", F.transform("_e", lambda e: F.struct(
        e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["text"].alias("text"))).alias("edits"))
    joined = state.join(trimmed, state[doc_id] == trimmed["_id"], "left").drop("_id")
    return apply_listed(joined, vocab, pattern, text=text).drop("edits")


def apply_listed(state: DataFrame, vocab: str, pattern: str, *, text: str = "text", edits: str = "edits") -> DataFrame:
    """The state after the edits in an array column of each row (no shuffle), with
    n_before (tokens) and n_encoded (pre-tokens encoded for the edits)."""
    state = state.drop("n_before", "n_encoded")
    shared = share_tables(state.sparkSession, vocab, pattern)
    names = [*state.columns, "n_before", "n_encoded"]
    schema = T.StructType([*state.schema.fields, *T._parse_datatype_string("n_before long, n_encoded long").fields])
    at = {c: names.index(c) for c in (text, edits, *STATE)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for b in batches:
            sizes = pa.compute.binary_length(b.column(at["lens"])).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in _pieces(b, sizes, PIECE_CHARS):
                part = b.slice(lo, hi - lo)
                out: dict[str, list] = {x: [] for x in (text, *STATE, "n_before", "n_encoded")}
                cols = [part.column(at[x]) for x in (text, edits, "lens", "counts", "n_tokens")]
                for t, todo, lens, counts, n in zip(*cols):
                    t, n, done = t.as_py(), n.as_py(), 0
                    raw = lens.as_py(), counts.as_py()
                    total = n
                    if todo := todo.as_py():
                        tree = Tree(*(np.frombuffer(x, np.int32) for x in raw))
                        for e in todo:
                            if e is not None:
                                t, k = edited(c, tree, t, e["start"] or 0, e["length"] or 0, e["text"] or "")
                                done += k
                        raw, total = tree.packed(), tree.total
                    for x, v in zip(out, (t, *raw, total, n, done)):
                        out[x].append(v)
                arrays = list(part.columns)
                arrays += [pa.array(out["n_before"], pa.int64()), pa.array(out["n_encoded"], pa.int64())]
                arrays[at[text]] = pa.array(out[text], pa.string())
                for x, kind in zip(STATE, (pa.binary(), pa.binary(), pa.int64())):
                    arrays[at[x]] = pa.array(out[x], kind)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return state.mapInArrow(run, schema)
