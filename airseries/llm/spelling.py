"""Spelling variant grouping: words one edit apart, found by a relational trie frontier.

Words are vertices of two tries, one over the words and one over their reversals, given
as a distributed table of edges (node, symbol, child); the symbol of an edge that ends a
word is empty and its child is the word. States (word, rest of the word from its
position, node, edits) form a frontier that is joined with the edges of one depth after
the other: an unedited state takes an edge with a symbol of its own as inserted or
replaced code point, an edited one only follows its rest, and an edited state at a word's
end is a neighbour. One edit stands in the first or in the second half of a word, so a
state enters at half its word's length: the first half runs through the other trie, and
the crowded nodes near the roots are never expanded. A deletion is an insertion seen from
the other word, a replacement is made from the lesser symbol, so pairs are found once and
mirrored.

An edge also carries two 64-bit signatures of the remainders below it (OR of one hashed
bit each): a state whose rest is in neither has no end below the edge and dies before it is
written. Edges are built from the written table of words for the depth at hand, so each
is shuffled for one join. A node's row of edges is bounded by the alphabet; a node with
very many states is split by the skew join, as its edge side is small.

Nodes are 64-bit hashes of prefixes: a collision can only add states, and neighbours are
checked on the words themselves. Words over ``LONG`` code points take one compressed edge
for all of the rest behind the edit (the hash of the word it must lead to), in time and
rows linear in their length.

Defined results: NULL texts hold no word, a NULL id reads as empty in the hash; runs of
any length are taken whole; ties go to the smallest word in code-point order; repeated
rows count again; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airseries.llm.common import Scratch, prepare

#: Code points a word is made of.
LETTERS = "A-Za-zÀ-ÿ"
#: Least code points of a word, least occurrences, and how many times rarer a variant is than its form.
MIN_LETTERS, MIN_COUNT, RARER = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
SLIP = 31
#: Words up to so many code points walk edge by edge; longer ones take a compressed last edge.
LONG = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the prefix hashes (odd, modulo 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(docs: DataFrame, *, text: str = "text", key: str = "doc_id", slip: int = SLIP, min_letters: int = MIN_LETTERS,
          min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, one in ``slip`` (document, run) pairs less one code point.

    Shorter runs cannot give a word, so they are not cut out at all."""
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{LETTERS}]{{{min_letters},}})"), F.lit(1))).alias("_run"))
    runs = runs.select("_key", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_key", "_run").cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(h % slip == 0, less).otherwise(F.col("_run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= min_letters)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _values(points: np.ndarray, side: int) -> np.ndarray:
    """A 64-bit value per code point and trie."""
    x = points.astype(np.uint64) + np.uint64(1 + 0x110000 * side)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE))])[:n]


def _prefixes(word: str, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of a word (from the empty one) and its weighted values."""
    v = _values(np.frombuffer(word.encode("utf-32-le"), np.uint32), side) * _powers(len(word))
    return np.concatenate([np.array([side], np.uint64), np.uint64(side) + np.cumsum(v, dtype=np.uint64)]), v


def _at_depth(words_: DataFrame, depth: int) -> DataFrame:
    """(node, x, child, wid, rest, own) of every word that passes a node of this depth in its second half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(depth + 1)
        for b in batches:
            ids = b.column(0).to_numpy()
            forward = np.array(b.column(1).to_pylist(), dtype=object)
            size = np.array([len(w) for w in forward], np.int64)
            there = (size >= depth) & (depth >= (size - 1) // 2) & (size <= LONG + 1)
            if not there.any():
                continue
            ids, forward, size = ids[there], forward[there].tolist(), size[there]
            for side, listed in ((0, forward), (1, [w[::-1] for w in forward])):
                points = np.array(listed, dtype=f"U{depth + 1}").view(np.uint32).reshape(len(listed), depth + 1)
                v = _values(points, side) * power
                node = np.uint64(side) + v[:, :depth].sum(1, dtype=np.uint64)
                ends = size == depth
                child = np.where(ends, ids, (node + v[:, depth]).view(np.int64))
                rest = [w[depth:] for w in listed]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array([r[:1] for r in rest], pa.string()), pa.array(child), pa.array(ids),
                     pa.array(rest, pa.string()), pa.array((depth >= size // 2) & (size <= LONG))],
                    names=["node", "x", "child", "wid", "rest", "own"])

    return words_.select("wid", "word").mapInArrow(run, "node long, x string, child long, wid long, rest string, own boolean")


def _bit(rest: Column, seed: int) -> Column:
    """One of 64 bits, by the hash of a remainder."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(rest, F.lit(seed)), F.lit(64)).cast("int"))


def _below(rest: Column) -> Column:
    """Whether a remainder can stand below the edge at hand."""
    return (F.col("s0").bitwiseAND(_bit(rest, 0)) != 0) & (F.col("s1").bitwiseAND(_bit(rest, 1)) != 0)


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The frontier behind the edges of one depth: (wid, node, rest, found); ``found`` is a neighbour."""
    rest, x = F.col("rest"), F.col("x")
    first, tail = F.substring(rest, 1, 1), F.expr("substring(rest, 2)")
    fresh = (F.col("edits") == 0) & (x != "") & (x != first)
    insert = fresh & _below(rest)
    replace = fresh & (first != "") & (x > first) & _below(tail)
    follow = (F.col("edits") == 1) & (x != "") & (x == first) & _below(tail)
    done = (F.col("edits") == 1) & (x == "") & (rest == "")
    met = states.join(edges, "node").where(insert | replace | follow | done)

    def to(cond: Column, left: Column, found: Column) -> Column:
        return F.when(cond, F.struct(F.col("child").alias("node"), left.alias("rest"), found.alias("found")))

    none = F.lit(None).cast("long")
    moves = F.array_compact(F.array(to(insert, rest, none), to(replace | follow, tail, none), to(done, rest, F.col("child"))))
    return met.select("wid", F.inline(moves))


def _frontier(words_: DataFrame, depths: range, scratch: Scratch) -> list[DataFrame]:
    """(wid, found) tables of the neighbours of words up to ``LONG`` code points, level by level."""
    found, front = [], None
    for depth in depths:
        passing = _at_depth(words_, depth)
        edges = passing.groupBy("node", "x", "child").agg(
            *[F.bit_or(_bit(F.expr("substring(rest, 2)"), seed)).alias(f"s{seed}") for seed in (0, 1)])
        states = passing.where("own").select("wid", "node", "rest", F.lit(0).alias("edits"))
        if front is not None:
            states = states.unionByName(front.select("wid", "node", "rest", F.lit(1).alias("edits")))
        level = scratch.write(_step(states, edges), "frontier")
        front = level.where("found IS NULL")
        found.append(level.where("found IS NOT NULL").select("wid", "found"))
    return found


def _long_rows(words_: DataFrame) -> DataFrame:
    """Nodes in the second half of every long word: its edge there, and what the rest adds to a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wid, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for side, w in ((0, word), (1, word[::-1])):
                    node, _ = _prefixes(w, side)
                    lo, n = (len(w) - 1) // 2, len(w)
                    child = np.append(node[lo + 1:], node[n:])
                    xs = [*w[lo:], ""]
                    own = np.arange(lo, n + 1) >= n // 2
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n + 1 - lo, wid)), pa.array(node[lo:].view(np.int64)), pa.array(xs, pa.string()),
                         pa.array(child.view(np.int64)), pa.array(((node[n] - node[lo:]) * BASE).view(np.int64)),
                         pa.array((node[n] - child).view(np.int64)), pa.array(own)],
                        names=["wid", "node", "x", "child", "if_inserted", "if_replaced", "own"])

    return words_.where(F.char_length("word") > LONG).select("wid", "word").mapInArrow(
        run, "wid long, node long, x string, child long, if_inserted long, if_replaced long, own boolean")


def _long(words_: DataFrame, scratch: Scratch) -> DataFrame:
    """(wid, found) of the neighbours of words over ``LONG`` code points."""
    rows = scratch.write(_long_rows(words_), "long-nodes")
    edges = rows.where("x <> ''").select("node", F.col("x").alias("y"), F.col("child").alias("to")).distinct()
    met = rows.where("own").join(edges, "node").where("x <> y").select("wid", "to", "x", "y", "if_inserted", "if_replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wid, to = b.column(0).to_numpy(), b.column(1).to_numpy()
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            swap = np.array([p != "" and q > p for p, q in zip(x, y, strict=True)], bool)
            inserted, replaced = to + b.column(4).to_numpy(), (to + b.column(5).to_numpy())[swap]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([wid, wid[swap]])), pa.array(np.concatenate([inserted, replaced]))],
                                             names=["wid", "node"])

    targets = met.mapInArrow(run, "wid long, node long")
    ends = rows.where("x = ''").select("node", F.col("wid").alias("found"))
    return targets.join(ends, "node").select("wid", "found")


def neighbours(words_: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), both ways and once each: all pairs of words that differ by one edit.

    ``words_``: (wid, word), a table with distinct words and ids."""
    low, high = words_.agg(F.min(F.char_length("word")), F.max(F.char_length("word"))).first()
    if low is None:
        return words_.select(F.col("wid").alias("a"), F.col("wid").alias("b")).where("false")
    # every word has a node of the depth of half its length
    parts = _frontier(words_, range((low - 1) // 2, min(high, LONG + 1) + 1), scratch)
    if high > LONG:
        parts.append(_long(words_, scratch))
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    both = one.select(F.col("wid").alias("a"), F.col("found").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    of_a = words_.select(F.col("wid").alias("a"), F.col("word").alias("_a"))
    of_b = words_.select(F.col("wid").alias("b"), F.col("word").alias("_b"))
    return both.join(of_a, "a").join(of_b, "b").where(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def variants(counted: DataFrame, *, rarer: int = RARER) -> DataFrame:
    """Words with their near words, form and root: (word, form, root, n, n_near, form_n).

    ``counted``: (word, n), distinct words."""
    spark = counted.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    known = scratch.write(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    pairs = neighbours(known, scratch)
    near = pairs.join(known.select(F.col("wid").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "b")).alias("best"))
    told = known.join(best, known["wid"] == best["a"], "left").drop("a")
    has = -F.col("best.less") >= rarer * F.col("n")
    told = scratch.write(told.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                     *[F.when(has, F.col(c)).alias(a) for c, a in (("best.form", "form"), ("best.b", "fid"))],
                                     F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    # forms are followed from every word at once; n rises tenfold with each, so the chains are short
    step = told.where("fid IS NOT NULL").select(F.col("wid").alias("at"), F.col("fid").alias("to"), F.col("form").alias("via"))
    ends = step.select(F.col("at").alias("wid"), F.col("to").alias("rid"), F.col("via").alias("root"))
    while True:
        moved = ends.join(step, ends["rid"] == step["at"], "left")
        ends = scratch.write(moved.select("wid", F.coalesce("to", "rid").alias("rid"), F.coalesce("via", "root").alias("root"),
                                          F.col("to").isNotNull().alias("moved")), "roots")
        if ends.where("moved").isEmpty():
            break
        ends = ends.drop("moved")
    roots = ends.select(F.col("wid").alias("_w"), "root")
    return (told.join(roots, told["wid"] == roots["_w"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
