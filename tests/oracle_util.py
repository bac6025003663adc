"""Local stand-in for the driver's Spark-vs-DuckDB comparison.

Usage: ``python -m tests.oracle_util [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_SPARK2DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
               "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
               "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
               "timestamp": "TIMESTAMP WITH TIME ZONE"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, records):
    out = []
    for r in records:
        out.append(tuple(repr(_norm(r[c])) for c in cols))
    return sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _SPARK2DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    d_rows = [dict(zip(d_cols, r)) for r in rel.fetchall()]
    problems = []
    if sorted(s_types) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_types)} duck={sorted(d_cols)}")
        return problems, len(s_rows), len(d_rows)
    tdiff = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c]}
    if tdiff:
        problems.append(f"types {tdiff}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    cols = sorted(s_types)
    a, b = _rows(cols, s_rows), _rows(cols, d_rows)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        problems.append(f"values differ; spark-only {diff} duck-only {diff2} cols {cols}")
    return problems, len(s_rows), len(d_rows)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from airseries.session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    if os.environ.get("ORACLE_PLAIN") == "1":   # the driver's default-like session
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark("oracle-check")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: {n} rows")
            continue
        try:
            problems, ns, nd = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, ns, nd = [f"error {type(e).__name__}: {str(e)[:400]}"], -1, -1
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {name}: spark={ns} duck={nd} {'; '.join(problems)}", flush=True)
    print(f"{bad} failing of {len([n for n in qs if not names or n in names])}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
