"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). For a cut of the dimensions into
equal segments, a vector keeps each segment's mean and deviation (root of the
summed squared distances from the mean). By Cauchy-Schwarz a pair's score is at
most  sum over segments (length * mean * mean' + deviation * deviation'),
equivalently a lower bound of the distance. Levels run from one segment to
many: a pair whose bound at some level is below the query's bar, its k-th best score so
far, is dropped, and exact scores are computed for the survivors: one by one, or by
matrix products where the bounds leave more than a tenth of the pairs (as
they do on vectors without structure, whose norms bound nothing).

Vectors are packed in blocks of at most ``BLOCK`` rows, in the smallest integers that
hold them, and so are the queries, each with its k-th best score in its own block and
a few others as the first bar. Every query block is copied to every lane and meets the lane's blocks of
candidates one after the other; it carries the k best of each query along and leaves
them once a lane, as one row. A last pass merges the lanes' rows of a query block one by
one. The copies go through a shuffle whatever their size: the files they are copied from
are small enough for a broadcast long after the copies are too large for the driver.

Defined results: vectors that are NULL, or hold NULL or non-finite components,
take no part; only vectors of equal length are compared; an empty vector scores
0; rows with equal vec_id stay separate candidates, a query skips only its own
row; ties go to the smaller vec_id; an empty table gives an empty result. Queries
with fewer than k candidates return them all. Components must stay below 2**31
after scaling (an error tells otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import written

BLOCK = 2048
SEGMENTS = (1, 4, 16)
#: Share of a slice's pairs up to which survivors are scored one by one.
MANY = 0.1
#: Queries that go through levels and products together; a block of queries keeps about so many scores.
SLICE, KEPT = 256, 20 * BLOCK
#: Where the bounds leave many pairs, they are asked again at every so many meetings.
ASK = 8
#: Blocks that give a query its first bar.
FIRST = 8
#: Share of |q| * |x|, the most that all terms of a bound can be, that covers their rounding in 32 bits.
SLACK = 1e-5
#: Below every score: the bar of a query with fewer than k candidates so far.
NONE = -np.iinfo(np.int64).max
_BLOCKS = "block long, dim int, n int, ids binary, comps binary"
_QUERIES = "qblock long, dim int, origins binary, rows binary, qids binary, bars binary, qcomps binary"
_KEPT = "qblock long, qids binary, scores binary, vec_ids binary"
_RANKED = "query_id long, rank int not null, vec_id long, score long"


def quantised(vec: str = "embedding", scale: float = 64.0) -> Column:
    """array<long> of floor(scale * x), NULL when the vector takes no part."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    top = F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < top))
    return F.when(ok, F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")))


def _packed(comps: np.ndarray) -> bytes:
    """Components in the smallest integers that hold them all."""
    lo, hi = comps.min(initial=0), comps.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
    return comps.astype(kind).tobytes()


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{len(raw) // (n * dim) if n * dim else 1}").reshape(n, dim)


def pack_blocks(vectors: DataFrame) -> DataFrame:
    """(vec_id, q array<long>) rows packed into blocks of one length, in whatever order they lie."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal uid
            ids, rows = held.pop(dim)
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([uid], pa.int64()), "dim": pa.array([dim], pa.int32()),
                "n": pa.array([len(ids)], pa.int32()),
                "ids": [np.array(ids, np.int64).tobytes()],
                "comps": [_packed(np.array(rows, np.int64))]})
            uid += 1
            return out

        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False)
            if flat.size and np.abs(flat).max() >= 2 ** 31:
                raise ValueError("a component leaves 32 bits after scaling")
            for i, vid in enumerate(b.column(0).to_numpy(zero_copy_only=False).tolist()):
                v = flat[offsets[i]:offsets[i + 1]]
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(vid)
                rows.append(v)
                if len(ids) == BLOCK:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(pack, _BLOCKS)


def query_blocks(blocks: DataFrame, divisor: int, k: int) -> DataFrame:
    """The rows of ``blocks`` whose id is divisible by ``divisor``, packed again with their origin and first bar."""
    most = min(BLOCK, max(1, KEPT // k))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 32
        held: dict[int, list[list[np.ndarray]]] = {}
        seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal uid
            if not held[dim] or sum(len(p[0]) for p in held[dim]) < least:
                return
            whole = [np.concatenate(c) for c in zip(*held[dim], strict=True)]
            for lo in range(0, len(whole[0]) - least + 1, most):
                *rest, comps = [c[lo:lo + most] for c in whole]
                yield pa.RecordBatch.from_pydict({
                    "qblock": pa.array([uid], pa.int64()), "dim": pa.array([dim], pa.int32()),
                    **{name: [c.tobytes()] for name, c in zip(("origins", "rows", "qids", "bars"), rest, strict=True)},
                    "qcomps": [_packed(comps)]})
                uid += 1
                done = lo + most
            held[dim] = [[c[done:] for c in whole]]

        for r in _rows(batches):
            ids, x = np.frombuffer(r["ids"], np.int64), _unpacked(r["comps"], r["n"], r["dim"])
            rows, others = np.flatnonzero(ids % divisor == 0), seen.setdefault(r["dim"], [])
            if rows.size:
                best = Best(len(rows), k)
                best_in_block(x[rows], x, ids, rows, best)
                for y, y_ids in others:
                    best_in_block(x[rows], y, y_ids, np.full(len(rows), -1), best)
                held.setdefault(r["dim"], []).append(
                    [np.full(len(rows), r["block"]), rows.astype(np.int32), ids[rows], best.bar, x[rows]])
                yield from flush(r["dim"], most)
            others.append((x, ids))
            del others[:-FIRST + 1]
        for dim in held:
            yield from flush(dim, 1)

    return blocks.mapInArrow(pick, _QUERIES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for j in range(b.num_rows):
            yield {c: b.column(c)[j].as_py() for c in b.schema.names}


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """Per level: segment means times root of length, segment deviations, and the norm."""
    x, out = x.astype(float), []
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    for s in SEGMENTS:
        if 4 * s >= x.shape[1]:
            break  # its statistics cost half as much as the scores or more
        cuts = np.linspace(0, x.shape[1], s + 1).astype(int)
        length = np.diff(cuts)
        mean = np.add.reduceat(x, cuts[:-1], axis=1) / length
        square = np.add.reduceat(x * x, cuts[:-1], axis=1) - mean * mean * length
        out.append(np.hstack([mean * np.sqrt(length), np.sqrt(np.maximum(square, 0)), norm]))
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> type | None:
    """Floats that hold all sums of a score's terms exactly, as integers below 2**24 or 2**53."""
    most = [max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in (q, x)]
    top = most[0] * most[1] * q.shape[1]
    return np.float32 if top < 2 ** 24 else np.float64 if top < 2 ** 53 else None


def _pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    """Exact integer scores of the pairs (i, j)."""
    if exact:
        return np.einsum("ij,ij->i", q[i], x[j]).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q[u], x[v], strict=True)) for u, v in zip(i, j, strict=True)], np.int64)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a mask with few true values."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), max(1, mask.shape[1]))
    eight = np.flatnonzero(flat.view(np.uint64))
    a, b = np.nonzero(flat.reshape(-1, 8)[eight])
    return np.divmod(eight[a] * 8 + b, max(1, mask.shape[1]))


class Best:
    """The k best (score, vec_id) of each of some queries so far, best first; ``first``: bars known from elsewhere."""

    def __init__(self, n: int, k: int, first: np.ndarray | int = NONE):
        self.k, self.first = k, first
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def bar(self) -> np.ndarray:
        """What a score must reach."""
        return np.maximum(self.scores[:, -1], self.first)

    def add(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries i, which rise."""
        last = self.scores[i, -1]
        new = (scores > last) | ((scores == last) & (ids < self.ids[i, -1]))
        if not new.any():
            return
        i, scores, ids = i[new], scores[new], ids[new]
        rows = i[np.concatenate([[True], i[1:] != i[:-1]])]
        at = np.concatenate([np.repeat(rows, self.k), i])
        s = np.concatenate([self.scores[rows].reshape(-1), scores])
        v = np.concatenate([self.ids[rows].reshape(-1), ids])
        order = np.lexsort((v, -s, at))
        stay = order[np.searchsorted(at[order], rows)[:, None] + np.arange(self.k)]
        self.scores[rows], self.ids[rows] = s[stay], v[stay]


def best_in_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, best: Best, ask: bool = True) -> bool:
    """``best`` after the rows of ``x``; ``own[i]``: row that query i skips, or -1. False if the levels left many pairs.

    Queries go through a level in slices: what it leaves above the bars goes on. Where there is
    no bar yet, the k rows a query's coarse bounds promise most set it. As soon as no more than
    a share ``MANY`` of a slice's pairs is left they are scored one by one; if the levels that are
    cheaper than the scores leave more than that, matrix products score it and the slices behind
    it, and so they do at once if not to ``ask`` the levels."""
    n, k, exact = len(x), best.k, _exact(q, x)
    kind = exact or np.float64
    ask = ask or exact is None
    levels = [((a * np.append(np.ones(a.shape[1] - 1), SLACK)).astype(kind), b.astype(kind))
              for a, b in zip(_levels(q), _levels(x), strict=True)] if ask and n > k else []
    q, x = q.astype(kind), x.astype(kind)
    for lo in range(0, len(q), SLICE):
        part = q[lo:lo + SLICE]
        skip = np.flatnonzero(own[lo:lo + SLICE] >= 0)
        mine = own[lo:lo + SLICE][skip]
        bar = best.bar[lo:lo + SLICE].astype(kind)  # rounded, if it is no score of these; the order to their scores stays
        loose = bar == kind(NONE)
        alive = None
        if ask or exact is None:
            alive = np.ones((len(part), n), bool)
            alive[skip, mine] = False
            for mq, mx in levels:
                upper = mq[lo:lo + SLICE] @ mx.T
                if loose.any():
                    upper[~alive] = -np.inf
                    first = np.argpartition(-upper[loose], k - 1, axis=1)[:, :k]
                    i = np.repeat(np.flatnonzero(loose), k)
                    got = _pairs(part, x, i, first.reshape(-1), exact is not None).astype(kind)
                    got[~alive[i, first.reshape(-1)]] = NONE
                    bar[loose] = np.maximum(bar[loose], got.reshape(-1, k).min(1))
                alive &= upper >= bar[:, None]
                if alive.mean() <= MANY:
                    break
            ask = alive.mean() <= MANY
        if exact is None or ask:
            i, j = np.nonzero(alive)
            s = _pairs(part, x, i, j, exact is not None)
        else:
            scores = part @ x.T
            scores[skip, mine] = -np.inf
            if n > k and loose.any():
                bar[loose] = np.maximum(bar[loose], np.partition(scores[loose], n - k, axis=1)[:, n - k])
            i, j = _where(scores >= bar[:, None])
            s = scores[i, j].astype(np.int64)
        best.add(i + lo, s, ids[j])
    return ask


def top_k(vectors: DataFrame, k: int = 20, *, divisor: int = 20, vec_id: str = "vec_id",
          vec: str = "embedding", scale: float = 64.0, lanes: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row whose vec_id is divisible by ``divisor``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(vec, scale).alias("q")).where(
        "vec_id IS NOT NULL AND q IS NOT NULL")
    blocks = written(pack_blocks(rows), "vector-blocks")
    # every lane of candidates meets every query block of its length; a task's blocks go round the lanes
    first = F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(lanes))
    lane = F.pmod(first + F.col("block").bitwiseAND(F.lit(2 ** 32 - 1)), F.lit(lanes)).cast("int")
    candidates = blocks.withColumn("lane", lane).repartition(lanes, "lane", "dim")
    queries = written(query_blocks(blocks, divisor, k), "query-blocks").withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes, "lane", "dim")

    def kept(qblock: int, qids: bytes, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"qblock": pa.array([qblock], pa.int64()), "qids": [qids],
                                           "scores": [best.scores.tobytes()], "vec_ids": [best.ids.tobytes()]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = best = None
        for r in _rows(batches):
            if r["qblock"] != now:
                if best is not None:
                    yield kept(now, qids, best)
                now, qids, met, few = r["qblock"], r["qids"], 0, True
                origins, at = np.frombuffer(r["origins"], np.int64), np.frombuffer(r["rows"], np.int32)
                q = _unpacked(r["qcomps"], len(at), r["dim"])
                best = Best(len(at), k, np.frombuffer(r["bars"], np.int64))
            few = best_in_block(q, _unpacked(r["comps"], r["n"], r["dim"]), np.frombuffer(r["ids"], np.int64),
                                np.where(origins == r["block"], at, -1), best, few or met % ASK == 0)
            met += 1
        if best is not None:
            yield kept(now, qids, best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked() -> pa.RecordBatch:
            i, rank = np.nonzero(best.scores != NONE)
            return pa.RecordBatch.from_pydict({
                "query_id": qids[i], "rank": (rank + 1).astype(np.int32), "vec_id": best.ids[i, rank], "score": best.scores[i, rank]})

        now = best = None
        for r in _rows(batches):
            if r["qblock"] != now:
                if best is not None:
                    yield ranked()
                now, qids = r["qblock"], np.frombuffer(r["qids"], np.int64)
                best = Best(len(qids), k)
            scores, ids = (np.frombuffer(r[c], np.int64).reshape(len(qids), k) for c in ("scores", "vec_ids"))
            i, j = np.nonzero(scores != NONE)
            best.add(i, scores[i, j], ids[i, j])
        if best is not None:
            yield ranked()

    met = queries.hint("merge").join(candidates, ["lane", "dim"]).mapInArrow(meet, _KEPT)
    return met.repartition("qblock").sortWithinPartitions("qblock").mapInArrow(merge, _RANKED)
