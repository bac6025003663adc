"""K-d tree sharding by bytes (DataFrame operations only).

Shards are the leaves of a k-d tree: each node is split along its widest
metadata dimension at a weighted median (weight = bytes of the document), found
by refining distributed histograms; a node of n leaves sends n//2 of n shares
of its bytes left. Documents are routed down the finished tree by one
expression, so nothing is joined back.

The dimensions are metadata of the text itself (bytes, multi-byte surplus,
lines, crc32), so equal texts have equal coordinates and stay together: a cut
is placed between groups of equal texts, unless the group on the cut is heavier
than ``tolerance`` of a shard; only then it is divided, by a hash of doc_id.

Defined results: a NULL text is an empty text; a NULL doc_id hashes like any other
value; repeated rows share a shard and get slots of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airseries.llm.common import text_of, written

#: The order inside a dimension: its value, then the text's hash, then the doc_id's.
TIES = ("_text_hash", "_id_hash")
#: Histogram cells per node and round: what a round sends to the driver is at most nodes x CELLS rows.
CELLS = 512


@dataclass
class Node:
    """``leaves`` shards starting at ``first``; ``rows`` is the path predicate."""
    first: int
    leaves: int
    bytes: int = 0


def metadata(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates; the text itself is left behind."""
    t = text_of(text)
    size = F.octet_length(t).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"), (size + 8).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        size.alias("d_bytes"), (size - F.length(t)).cast("long").alias("d_multibyte"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("d_lines"),
        F.crc32(t.cast("binary")).alias("d_crc"),
        # 32 bits each
        F.shiftrightunsigned(F.xxhash64(t), 32).alias("_text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 32).alias("_id_hash"))


DIMS = ("d_bytes", "d_multibyte", "d_lines", "d_crc")


def _widest(rows: DataFrame, nodes: dict[int, Node]) -> dict[int, str]:
    """Per node the dimension whose range, as a share of the whole table's, is widest."""
    aggs = [f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
    per = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("_bytes"), *aggs).collect()}
    out = {}
    span = {d: max(1, max(r[f"hi_{d}"] for r in per.values()) - min(r[f"lo_{d}"] for r in per.values()))
            for d in DIMS} if per else {}
    for k, node in nodes.items():
        r = per.get(k)
        node.bytes = r["_bytes"] if r else 0
        out[k] = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / span[d]) if r else DIMS[0]
    return out


def _case(by_node: dict[int, Column | object], default=None) -> Column:
    c = None
    for k, v in by_node.items():
        c = F.when(F.col("_node") == k, v) if c is None else c.when(F.col("_node") == k, v)
    return c.otherwise(default) if c is not None else F.lit(default)


def _cuts(rows: DataFrame, nodes: dict[int, Node], dim: dict[int, str], tolerance: float) -> dict[int, list]:
    """Per node the cut [v0, v1, v2] over (value, text hash, id hash): rows below it go left.

    Each round narrows every open node's interval to the cell with the weighted
    median; a node is done when that cell weighs less than the tolerance."""
    share = {k: n.bytes * (n.leaves // 2) / n.leaves for k, n in nodes.items()}
    slack = {k: tolerance * n.bytes / n.leaves for k, n in nodes.items()}
    keys = {k: [dim[k], *TIES] for k in nodes}
    done: dict[int, list] = {}
    # per node: the fixed prefix of the cut, the interval of the open level, bytes left of it
    prefix = {k: [] for k in nodes}
    span: dict[int, tuple[int, int] | None] = {k: None for k in nodes}
    left = {k: 0 for k in nodes}
    while todo := [k for k in nodes if k not in done]:
        cond, value = {}, {}
        for k in todo:
            level = len(prefix[k])
            c = F.lit(True)
            for name, v in zip(keys[k], prefix[k]):
                c &= F.col(name) == v
            value[k] = F.col(keys[k][level])
            if span[k]:
                c &= value[k].between(span[k][0], span[k][1] - 1)
            cond[k] = c
        held = rows.where(F.col("_node").isin(todo)).withColumn("_v", _case(value)).where(_case(cond, F.lit(False)))
        if fresh := [k for k in todo if span[k] is None]:
            ends = held.where(F.col("_node").isin(fresh)).groupBy("_node").agg(F.min("_v"), F.max("_v")).collect()
            got = {r[0]: (r[1], r[2] + 1) for r in ends}
            for k in fresh:
                if k in got:
                    span[k] = got[k]
                else:  # an empty node: nothing to cut
                    done[k] = [0, 0, 0]
            todo = [k for k in todo if k not in done]
            if not todo:
                break
        width = {k: max(1, -(-(span[k][1] - span[k][0]) // CELLS)) for k in todo}
        cell = F.floor((F.col("_v") - _case({k: F.lit(span[k][0]) for k in todo}))
                       / _case({k: F.lit(width[k]) for k in todo})).cast("int")
        hist: dict[int, list] = {k: [] for k in todo}
        for r in held.groupBy("_node", cell.alias("_cell")).agg(F.sum("size").alias("_w")).collect():
            if r["_node"] in hist:
                hist[r["_node"]].append((r["_cell"], r["_w"]))
        for k in todo:
            at, chosen = left[k], None
            for c, w in sorted(hist[k]):
                if at + w >= share[k]:
                    chosen = (c, w)
                    break
                at += w
            if chosen is None:
                done[k] = _padded([*prefix[k], span[k][1]])
                continue
            (c, w), level = chosen, len(prefix[k])
            lo = span[k][0] + c * width[k]
            if w <= slack[k] or (width[k] == 1 and level == len(TIES)):
                near = lo + width[k] if share[k] - at > at + w - share[k] else lo
                done[k] = _padded([*prefix[k], near])
            elif width[k] == 1:  # one value, still too heavy: order its rows by the next tie-break
                prefix[k], span[k], left[k] = [*prefix[k], lo], None, at
            else:
                span[k], left[k] = (lo, lo + width[k]), at
    return done


def _padded(cut: list) -> list:
    return [*cut, *[0] * (len(TIES) + 1 - len(cut))]


def _is_left(dim: str, cut: list) -> Column:
    a, b, c = (F.col(x) for x in (dim, *TIES))
    x, y, z = (F.lit(v) for v in cut)
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))


def kd_shards(docs: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text",
              tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes, slots gapless from 0."""
    rows = written(metadata(docs, doc_id, text), "shard-meta").withColumn("_node", F.lit(0))
    route = F.lit(0)
    level = {0: Node(0, shards)}
    while any(n.leaves > 1 for n in level.values()):
        split = {k: n for k, n in level.items() if n.leaves > 1}
        at = rows.withColumn("_node", route)
        dim = _widest(at, split)
        cuts = _cuts(at, split, dim, tolerance)
        nxt = {k: n for k, n in level.items() if n.leaves == 1}
        step = {}
        for k, n in split.items():
            half = n.leaves // 2
            # a node is named by its first shard, so the left child keeps the name
            step[k] = F.when(_is_left(dim[k], cuts[k]), F.lit(k)).otherwise(F.lit(k + half))
            nxt[k], nxt[k + half] = Node(k, half), Node(k + half, n.leaves - half)
        route = F.when(F.col("_node").isin(list(split)), _case(step)).otherwise(F.col("_node"))
        rows = written(rows.withColumn("_node", route), "shard-level")
        route = F.col("_node")
        level = nxt
    return _slots(rows.withColumnRenamed("_node", "shard"))


def _slots(rows: DataFrame, lanes: int = 64) -> DataFrame:
    """Gapless numbers per shard without a task per shard: rows are numbered in
    (shard, lane) pieces, and a small table of piece sizes gives the offsets."""
    rows = rows.withColumn("_lane", F.pmod("_id_hash", F.lit(lanes)).cast("int"))
    sizes = rows.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("shard", "_lane").orderBy("doc_id", "text_crc32", "size")
    # at most shards x lanes rows, whatever the data
    return (rows.withColumn("_i", F.row_number().over(within) - 1)
            .join(F.broadcast(offset), ["shard", "_lane"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_off") + F.col("_i")).cast("long").alias("slot")))
