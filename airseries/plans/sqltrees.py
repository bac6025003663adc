"""DuckDB SQL that grows the same histogram ensembles as ``operators.trees``."""

from __future__ import annotations

from airseries.operators.trees import _POISSON, MIN_GAIN, SCALE


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _weight(tree: int, seed: int) -> str:
    """The row's bag weight from its ``bag`` key: the mix of ``trees.bag_weight``."""
    m = "CAST(4294967295 AS UBIGINT)"
    x = f"xor(CAST(bag AS UBIGINT) & {m}, CAST({((tree + 1) * 0x9E3779B1 + seed) & 0xFFFFFFFF} AS UBIGINT))"
    step = lambda x, by, k: f"((xor({x}, {x} >> {by}) * CAST({k} AS UBIGINT)) & {m})"
    x = step(f"({x})", 16, 0x85EBCA6B)
    x = step(x, 13, 0xC2B2AE35)
    x = f"xor({x}, {x} >> 16)"
    return "(" + " + ".join(f"CAST({x} >= {int(b)} AS BIGINT)" for b in _POISSON) + ")"


def ensemble_ctes(features, kind: str, trees: int, depth: int, rate: float = 1.0, l2: float = 0.0, bins: int = 32,
                  seed: int = 42, name: str = "m") -> str:
    """CTEs over ``src`` (id, bag, tr, y and the features): ``{name}_pred`` (id, p) of all rows and
    ``{name}_gain`` (tree, f, gain) of all splits. ``tr`` marks the rows to fit."""
    n = name
    out = [f"{n}_base AS MATERIALIZED (SELECT id, bag, tr, CAST(floor(CAST(y AS DOUBLE) * {SCALE} + 0.5) AS BIGINT) AS yq FROM src)",
           f"{n}_long AS MATERIALIZED (" + " UNION ALL ".join(
               f"SELECT id, tr, {i} AS f, CAST({c} AS DOUBLE) AS x FROM src" for i, c in enumerate(features)) + ")",
           f"""{n}_rank AS MATERIALIZED (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS r,
  count(*) OVER (PARTITION BY f) AS n, max(x) OVER (PARTITION BY f) AS hi FROM {n}_long WHERE tr)""",
           f"""{n}_edge AS MATERIALIZED (SELECT DISTINCT f, x FROM {n}_rank JOIN
  (SELECT unnest([{', '.join(_d(k / bins) for k in range(1, bins))}]) AS q) ON r = CAST(floor(q * (n - 1)) AS BIGINT) WHERE x < hi)""",
           f"""{n}_bin AS MATERIALIZED (SELECT l.id, l.f, count(e.x) AS bin FROM {n}_long l LEFT JOIN {n}_edge e ON e.f = l.f AND e.x < l.x
  GROUP BY ALL)""",
           f"{n}_mean AS MATERIALIZED (SELECT CAST(sum(yq) AS DOUBLE) / {SCALE} / count(*) AS base FROM {n}_base WHERE tr)",
           f"{n}_sum0 AS MATERIALIZED (SELECT id, {_d(0)} AS p FROM {n}_base)"]
    score = lambda s, w: f"{s} * {s} / ({w} + {_d(l2)})"
    for t in range(trees):
        a = f"{n}{t}"
        if kind == "forest":
            rows = f"SELECT id, {_weight(t, seed)} AS w, yq AS g FROM {n}_base WHERE tr"
        else:
            rows = f"""SELECT b.id, 1 AS w, yq - CAST(floor((base + {_d(rate)} * s.p) * {SCALE} + 0.5) AS BIGINT) AS g
  FROM {n}_base b JOIN {n}_sum{t} s ON b.id = s.id, {n}_mean WHERE tr"""
        out += [f"{a}_row AS MATERIALIZED (SELECT * FROM ({rows}) WHERE w > 0)", f"{a}_at0 AS MATERIALIZED (SELECT id, 0 AS node FROM {n}_base)"]
        values = [f"SELECT 0 AS node, sn / (wn + {_d(l2)}) AS v FROM (SELECT DISTINCT wn, sn FROM {a}_cum0)"]
        for level in range(depth):
            out += [f"""{a}_cum{level} AS MATERIALIZED (SELECT node, f, bin, CAST(sum(w) OVER u AS BIGINT) AS wl, CAST(sum(s) OVER u AS DOUBLE) / {SCALE} AS sl,
  CAST(sum(w) OVER n AS BIGINT) AS wn, CAST(sum(s) OVER n AS DOUBLE) / {SCALE} AS sn FROM (
  SELECT node, f, bin, sum(w) AS w, sum(w * g) AS s FROM {a}_at{level} a JOIN {a}_row r ON a.id = r.id JOIN {n}_bin b ON a.id = b.id
  WHERE node >= {2 ** level - 1} GROUP BY ALL)
  WINDOW u AS (PARTITION BY node, f ORDER BY bin), n AS (PARTITION BY node, f))""",
                    f"""{a}_best{level} AS MATERIALIZED (SELECT * FROM (
  SELECT *, {score('sl', 'wl')} + {score('(sn - sl)', '(wn - wl)')} - {score('sn', 'wn')} AS gain FROM {a}_cum{level} WHERE wl >= 1 AND wn - wl >= 1)
  WHERE gain > {_d(MIN_GAIN)} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)""",
                    f"""{a}_at{level + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN s.node IS NULL THEN a.node WHEN b.bin <= s.bin THEN 2 * a.node + 1
  ELSE 2 * a.node + 2 END AS node FROM {a}_at{level} a LEFT JOIN {a}_best{level} s ON a.node = s.node
  LEFT JOIN {n}_bin b ON a.id = b.id AND s.f = b.f)"""]
            values += [f"SELECT 2 * node + 1, sl / (wl + {_d(l2)}) FROM {a}_best{level}",
                       f"SELECT 2 * node + 2, (sn - sl) / (wn - wl + {_d(l2)}) FROM {a}_best{level}"]
        out += [f"{a}_val AS MATERIALIZED ({' UNION ALL '.join(values)})",
                f"""{n}_sum{t + 1} AS MATERIALIZED (SELECT s.id, s.p + v.v AS p FROM {n}_sum{t} s JOIN {a}_at{depth} a ON s.id = a.id
  JOIN {a}_val v ON a.node = v.node)"""]
    final = f"p / {trees}" if kind == "forest" else f"base + {_d(rate)} * p"
    out.append(f"{n}_pred AS (SELECT id, {final} AS p FROM {n}_sum{trees}, {n}_mean)")
    out.append(f"{n}_gain AS (" + " UNION ALL ".join(
        f"SELECT {t} AS tree, f, gain FROM {n}{t}_best{level}" for t in range(trees) for level in range(depth)) + ")")
    return ",\n".join(out)
