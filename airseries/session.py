"""Session construction and cluster-level helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every airseries job relies on. Time columns are TIMESTAMP_NTZ, so
# results do not depend on the session zone; UTC is pinned for the few LTZ
# values (audit times) only.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_spark(app: str = "airseries", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller's session is used."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset and
    the session is local (tests, local runs) create a fresh scratch folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d and d.startswith("file:"):
        d = d[len("file:"):]
    if not d:
        if default is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder; a machine-local "
                               "scratch folder is only used for local sessions")
        d = default or tempfile.mkdtemp(prefix="airseries-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core conf not settable at run time
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again: cuts the
    lineage with files of known size (a checkpoint keeps the estimates of its plan,
    which multiply from round to round of a loop)."""
    import uuid
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """Bounded size probe: scans at most ``limit + 1`` rows of ``df``."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only behind a checked row bound; otherwise leave the
    join strategy to Catalyst/AQE (shuffle join)."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``airseries`` importable in Python workers (what ``--py-files``
    does): zip the package once per driver process and ``addPyFile`` it.
    Spark's file server distributes it; no shared folder is needed."""
    import os
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="airseries-pyfiles-"), "airseries.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
