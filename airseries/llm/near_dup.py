"""Near-duplicate classes with Order MinHash and banded alignment.

Texts are sequences of lower-cased words, compared by their shingles of five
words. A sketch takes, under a hash of its own, the few smallest
occurrence-labelled shingles and keeps them in text order, so two texts share
it only if they share those shingles in that order. Texts that share a sketch
are candidates; a banded alignment of their words decides: with m shingles inside
aligned runs, texts of k and l shingles are linked if m / (k + l - m) >= 0.8.

Work is kept off the square of a group's size without losing links:
equal word sequences are one node from the start; a bucket's texts are first
compared with the bucket's least node only; after the components of those
links, pairs are formed only between different classes of a bucket, and only
of texts that share enough shingles with other classes to reach the similarity
with anyone. Those meet by their rarest shingles: a pair that shares enough has the
first shingle it shares, rarest first, near the front of both (exact bounds, by
length and place). So a group of copies costs its size and what of its classes is nearly
or truly similar; texts that are only of one group make no pairs. Nothing is capped.

Sketches: texts of at least LONG_FROM shingles have LONG sketches of six
shingles; texts of at most SHORT_TO have SHORT sketches of two (both, in
between, so that any pair with similar lengths has a family in common). A pair
of similarity 0.8 misses all its sketches with probability (1 - 0.8**6)**40,
about 5e-6.

Defined results: NULL text is an empty text; texts with equal words (or, without
words, equal characters) are one class; a text of fewer than five words has no
other near-duplicates; rows with one doc_id are one class; NULL doc_ids form classes
like others (class_id is NULL if a class has no doc_id at all); negative doc_ids are
ids like others (all are below 2**62); repeated rows are each returned; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import Scratch, hold, let_go, prepare, released, text_of, written
from airseries.llm.graph import components

SHINGLE, SIMILAR = 5, 0.8
#: (number of sketches, shingles of a sketch) for long and for short texts.
LONG, SHORT = (40, 6), (12, 2)
LONG_FROM, SHORT_TO = 18, 24
#: Rounds against one node of a bucket before its classes are compared (saves work, changes no result).
STAR_ROUNDS = 1
#: Ids are below this; rows without one are known by a number from here on.
UNNAMED = 1 << 62
#: Words a worker remembers the hash of.
REMEMBER = 150_000
#: Cells of the hash matrix at once (long texts are done in groups of sketches).
CELLS = 1_000_000

WORD = re.compile(r"\w+")
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_word_hash: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """32-bit hash of every word, in text order."""
    if len(_word_hash) > REMEMBER:
        _word_hash.clear()
    words = WORD.findall(text.lower())
    for w in set(words).difference(_word_hash):
        _word_hash[w] = xxhash.xxh32_intdigest(w)
    return np.fromiter(map(_word_hash.__getitem__, words), np.uint32, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of five words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, _U)
    w = words.astype(_U)
    h = np.zeros(n, _U)
    for j in range(SHINGLE):
        h = _mix(h * _GOLDEN + w[j:j + n] + _U(j + 1))
    return h


def _labelled(h: np.ndarray) -> np.ndarray:
    """Hash of (shingle, how often it has occurred before)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.arange(len(h))
    nth = np.empty(len(h), _U)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(_U)
    return _mix(h + nth * _U(0xD6E8FEB86659FD93))


def _seeds(n: int, family: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _GOLDEN + _U(family))


def sketches(h: np.ndarray, count: int, size: int, family: int) -> np.ndarray:
    """``count`` order-min-hashes of ``size`` shingles each, as signed 64-bit values."""
    n = len(h)
    labelled, seeds = _labelled(h), _seeds(count, family)
    out = np.empty(count, _U)
    step = max(1, CELLS // n)
    for lo in range(0, count, step):
        s = seeds[lo:lo + step, None]
        m = (labelled[None, :] ^ s) * (s | _U(1))
        m ^= m >> _U(32)
        rows = cols = None
        if n > 64:  # the smallest lie below a small quantile; a row with too few is done in full
            rows, cols = np.nonzero(m < _U(int(2 ** 64 * 32 / n)))
            if np.bincount(rows, minlength=len(s)).min() < size:
                rows = None
        if rows is None:
            cols = np.argpartition(m, size - 1, axis=1)[:, :size] if n > size else np.tile(np.arange(n), (len(s), 1))
            rows, cols = np.repeat(np.arange(len(s)), cols.shape[1]), cols.ravel()
        order = np.lexsort((cols, m[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        start = np.searchsorted(rows, np.arange(len(s)))
        pick = (start[:, None] + np.arange(size)).ravel()
        at = np.sort(cols[pick].reshape(len(s), size), axis=1)  # text order
        v = np.repeat(s, 1, axis=1)[:, 0]
        for j in range(size):
            v = _mix(v * _GOLDEN + h[at[:, j]])
        out[lo:lo + step] = v
    return out.view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    n, parts = len(h), []
    if n >= LONG_FROM:
        parts.append(sketches(h, *LONG, 1))
    if SHORT[1] <= n <= SHORT_TO:
        parts.append(sketches(h, *SHORT, 2))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles two texts share in any order, with multiplicity: a bound for any alignment."""
    u, c = np.unique(a, return_counts=True)
    v, d = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(c[i], d[j]).sum())


def aligned_shingles(a: list[int], b: list[int], band: int) -> int:
    """Shingles inside the matched runs of an alignment with the fewest word edits;
    -1 if it needs more than ``band`` insertions and deletions."""
    n, m = len(a), len(b)
    far, got = {1: 0}, {1: 0}
    for d in range(band + 1):
        for k in range(-d, d + 1, 2):
            if k == -d or k != d and far[k - 1] < far[k + 1]:
                x, s = far[k + 1], got[k + 1]
            else:
                x, s = far[k - 1] + 1, got[k - 1]
            y = x0 = x
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            far[k], got[k] = x, s + max(0, x - x0 - SHINGLE + 1)
            if x >= n and y >= m:
                return got[k]
    return -1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences have similarity SIMILAR or more."""
    k, l = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    if k < 1 or l < 1:
        return np.array_equal(a, b)
    least = SIMILAR / (1 + SIMILAR) * (k + l) - 1e-9  # shared shingles of a linked pair
    if min(k, l) < least or shared_at_most(shingles(a), shingles(b)) < least:
        return False
    # every unmatched word spoils a shingle of its own, but for those at the ends
    band = int(k + l - 2 * least) + 2 * SHINGLE
    return aligned_shingles(a.tolist(), b.tolist(), band) >= least


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, sketch) of every row; equal word sequences have equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _word_hash.clear)
        for b in batches:
            keys, ns, marks = [], [], []
            for t in b.column(1).to_pylist():
                w = word_hashes(t)
                keys.append(xxhash.xxh128_digest(" ".join(WORD.findall(t.lower())) if len(w) else "\n" + t))
                h = shingles(w)
                ns.append(len(h))
                marks.append(sketch(h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(ns, pa.int32()),
                 pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sketch"])
        let_go()
    return docs.mapInArrow(run, "doc_id long, key binary, n int, sketch array<long>")


def _words(docs: DataFrame) -> DataFrame:
    """(node, words) from (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _word_hash.clear)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([word_hashes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())],
                names=["node", "words"])
        let_go()
    return docs.mapInArrow(run, "node long, words binary")


def _linked(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _word_hash.clear)
        for b in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32))
                    for x, y in zip(b.column(2), b.column(3))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])
        let_go()
    left = words.select(F.col("node").alias("u"), F.col("words").alias("a"))
    right = words.select(F.col("node").alias("v"), F.col("words").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of its class) of every row."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = scratch.write(_nodes(src), "near-rows")
    # a node: the least doc_id with these words; without any, a number of the words above all ids
    unnamed = F.pmod(F.xxhash64("key"), F.lit(UNNAMED)) + F.lit(UNNAMED)
    nodes = scratch.write(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                            F.first("sketch").alias("sketch"))
                    .select("key", F.coalesce("doc_id", unnamed).alias("node"), "n", "sketch"), "near-nodes")
    # sketches are most of the bytes: they lie on the disk in one form at a time
    keyed = scratch.write(rows.select("doc_id", "key"), "near-keyed")
    scratch.drop("near-rows")
    marks = scratch.write(nodes.select("node", "n", F.explode("sketch").alias("mark")), "near-marks")
    named = scratch.write(nodes.select("key", "node"), "near-named")
    scratch.drop("near-nodes")
    released(scratch.spark)
    # buckets with several nodes, each compared with its least one
    leads = scratch.write(marks.groupBy("mark").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last"))
                    .where("lead.node <> last").select("mark", F.col("lead.node").alias("u"), F.col("lead.n").alias("un")),
                    "near-leads")
    released(scratch.spark)
    shared = scratch.write(marks.join(leads, "mark").select("mark", "node", "n", "u", "un"), "near-shared")
    scratch.drop("near-marks", "near-leads")
    released(scratch.spark)
    in_range = (F.col("n") >= F.col("un") * SIMILAR) & (F.col("un") >= F.col("n") * SIMILAR)
    stars = scratch.write(shared.where(in_range & (F.col("node") != F.col("u")))
                    .select("u", F.col("node").alias("v")).distinct(), "near-stars")
    words = _words_of(scratch, src, shared)
    released(scratch.spark)
    links = scratch.write(_linked(stars, words), "near-links")
    # pairs that no chain of links joins yet, between the classes of a bucket
    cc = components(links)
    classed = scratch.write(shared.select("mark", "node", "n").join(cc, "node", "left")
                      .select("mark", "node", "n", F.coalesce("component", "node").alias("class")), "near-classed")
    scratch.drop("near-shared")
    released(scratch.spark)
    mixed = scratch.write(classed.groupBy("mark").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
                    .where("lo < hi").select("mark"), "near-mixed")
    if not mixed.isEmpty():
        open_ = scratch.write(classed.join(mixed, "mark", "left_semi"), "near-open")
        scratch.drop("near-classed")
        # only texts that can reach the similarity at all meet: what a linked pair shares, each of
        # the two shares with another class
        told = scratch.write(_rare_first(scratch, open_, words), "near-told")
        scratch.drop("near-shingles", "near-several")
        released(scratch.spark)
        able = scratch.write(open_.join(told.select("node", "shared"), "node")
                             .where(F.col("shared") >= F.col("n") * SIMILAR - 1e-9), "near-able")
        least = SIMILAR / (1 + SIMILAR) * (F.col("n") + F.col("un")) - 1e-9
        enough = F.least("shared", "us") >= least
        # a round against one node of each bucket, another one this time: it joins most of a group
        # at the cost of its size
        for turn in range(STAR_ROUNDS):
            chosen = F.min_by(F.struct("node", "n", "class", "shared"), F.xxhash64("node", F.lit(turn)))
            lead = scratch.write(able.groupBy("mark").agg(chosen.alias("l")).select(
                F.col("mark").alias("m"), F.col("l.node").alias("u"), F.col("l.n").alias("un"),
                F.col("l.class").alias("uc"), F.col("l.shared").alias("us")), "near-leads")
            met = (able.join(lead, (able["mark"] == lead["m"]) & in_range & enough & (F.col("class") != F.col("uc")))
                   .select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
                   .join(stars, ["u", "v"], "left_anti"))
            met = scratch.write(met, "near-stars")
            cc = _joined(cc, scratch.write(_linked(met, words), "near-links"))
            stars = scratch.write(stars.unionByName(met), "near-stars")
            able = scratch.write(able.drop("class").join(cc, "node", "left").select(
                "mark", "node", "n", F.coalesce("component", "node").alias("class"), "shared"), "near-able")
        # what is still apart meets where one of its rarest shingles is shared
        cross = _crossed(scratch, able, told, in_range & enough, least).join(stars, ["u", "v"], "left_anti")
        cc = _joined(cc, scratch.write(_linked(scratch.write(cross, "near-cross"), words), "near-links"))
    classes = named.join(cc, "node", "left").select(
        "key", F.coalesce("component", "node").alias("class"))
    out = keyed.join(classes, "key")
    out = written(out.select("doc_id", F.when(F.col("class") < UNNAMED, F.col("class")).alias("class_id")), "near-classes")
    scratch.drop()
    released(scratch.spark)
    return out


def _joined(cc: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``cc`` with more links."""
    return components(cc.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))


def _rare_first(scratch: Scratch, open_: DataFrame, words: DataFrame) -> DataFrame:
    """(node, shared, heads): how many shingles (with multiplicity) of a text occur in a text of another
    class, and (h, at) of those among its rarest; ``at`` shingles of the text come before one in the order
    (occurrences, hash). A linked pair shares enough that the first it shares is a head of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _word_hash.clear)
        for b in batches:
            for node, cls, raw in zip(*(c.to_pylist() for c in b.columns)):
                h = _labelled(shingles(np.frombuffer(raw, np.uint32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(h), node)), pa.array(np.full(len(h), cls))],
                    names=["h", "node", "class"])
        let_go()
    texts = open_.select("node", "class").distinct().join(words, "node").select("node", "class", "words")
    rows = scratch.write(texts.mapInArrow(run, "h long, node long, class long"), "near-shingles")
    seen = scratch.write(rows.groupBy("h").agg(F.count("*").alias("many"), (F.min("class") < F.max("class")).alias("several")),
                         "near-several")
    listed = rows.join(seen, "h").groupBy("node").agg(
        F.count_if("several").alias("shared"), F.sort_array(F.collect_list(F.struct("many", "h", "several"))).alias("all"))
    first = F.slice("all", 1, (F.floor(F.size("all") * (1 - SIMILAR) + 1e-9) + 1).cast("int"))
    heads = F.filter(F.transform(first, lambda x, i: F.struct(x["h"].alias("h"), i.alias("at"), x["several"].alias("several"))),
                     lambda x: x["several"])
    return listed.select("node", "shared", heads.alias("heads"))


def _crossed(scratch: Scratch, able: DataFrame, told: DataFrame, fits, least) -> DataFrame:
    """(u, v) of different classes that share a sketch and may share ``least`` shingles.

    Before the first shingle they share, each of the two has only shingles that the other lacks; a
    text of n with ``at`` of them shares n - at at most. The shorter one of a pair leaves out fewer.
    As most texts with a shingle are of one class, only the others meet all of them."""
    one = able.groupBy("node").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.first("shared").alias("shared"))
    heads = scratch.write(one.join(told.select("node", "heads"), "node").select(
        "node", "n", "class", "shared", F.explode("heads").alias("k")).select("node", "n", "class", "shared", "k.h", "k.at"), "near-heads")
    main = (heads.groupBy("h", "class").agg(F.count("*").alias("c")).groupBy("h")
            .agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1"))
    heads = scratch.write(heads.join(main, "h").select("*", (F.col("class") != F.col("main")).alias("rest")), "near-heads")
    short = heads.where(F.col("n") - F.col("at") >= 2 * SIMILAR / (1 + SIMILAR) * F.col("n") - 1e-9)
    long = heads.select("h", F.col("node").alias("u"), F.col("n").alias("un"), F.col("class").alias("uc"),
                        F.col("shared").alias("us"), F.col("at").alias("uat"), F.col("rest").alias("urest"))
    order = F.struct("n", "node") < F.struct("un", "u")
    reach = (F.col("class") != F.col("uc")) & order & fits & (F.least(F.col("n") - F.col("at"), F.col("un") - F.col("uat")) >= least)
    met = [a.join(b, "h").where(reach).select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
           for a, b in ((short.where("rest"), long), (short.where("NOT rest"), long.where("urest")))]
    pairs = scratch.write(met[0].unionByName(met[1]).distinct(), "near-met")
    marks = scratch.write(able.groupBy("node").agg(F.collect_set("mark").alias("marks")), "near-sketches")
    left, right = (marks.select(F.col("node").alias(x), F.col("marks").alias(f"{x}_marks")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").where(F.arrays_overlap("u_marks", "v_marks")).select("u", "v")


def _words_of(scratch: Scratch, src: DataFrame, marks: DataFrame) -> DataFrame:
    """Words of the nodes in ``marks``: the documents are read again, not kept."""
    wanted = scratch.write(marks.select("node").distinct(), "near-wanted")
    named = src.join(wanted, src["doc_id"] == wanted["node"]).select("node", "text")
    texts = named.unionByName(_unnamed(src, wanted))
    return scratch.write(_words(texts), "near-words")


def _unnamed(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of nodes without a doc_id (their rows carry none to join by)."""
    null = src.where("doc_id IS NULL")
    keyed = _nodes_text(null)
    node = F.pmod(F.xxhash64("key"), F.lit(UNNAMED)) + F.lit(UNNAMED)
    return (keyed.select(node.alias("node"), "text").groupBy("node").agg(F.min("text").alias("text"))
            .join(wanted, "node", "left_semi"))


def _nodes_text(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dup", _word_hash.clear)
        for b in batches:
            keys = []
            for t in b.column(0).to_pylist():
                w = WORD.findall(t.lower())
                keys.append(xxhash.xxh128_digest(" ".join(w) if w else "\n" + t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)], names=["key", "text"])
    return docs.select("text").mapInArrow(run, "key binary, text string")
