"""Session helpers: a tuned local session for tests and benches, and
lineage cuts that go to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "weaklabel", extra: dict | None = None) -> SparkSession:
    """Session for local runs. On a cluster use the cluster's own session;
    every operator only needs ``spark`` to be any live session."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir``. Only a local-mode session without
    the setting gets a private temporary folder (tests, benches); a cluster
    without it is an error, since a machine-local folder does not survive
    the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)")
        conf = tempfile.mkdtemp(prefix="weaklabel-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


#: Tables written to be read again are packed closer than Spark's default, which disks feel and reading does not.
CODEC = "zstd"
#: Seconds of a write after which the files of its shuffles are let go.
LONG_WRITE_S = 1.0


def cut_lineage(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back, in folders of the columns ``by`` if given. The returned
    DataFrame's plan is a plain scan: a lost executor costs a re-read, not a
    recomputation of the upstream plan, and later plans that reuse it stay
    small. Parquet keeps column pruning, filter pushdown and size statistics
    for join planning."""
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    began = time.monotonic()
    df.write.mode("overwrite").option("compression", CODEC).partitionBy(*by or []).parquet(path)
    if time.monotonic() - began > LONG_WRITE_S:
        drop_shuffles(spark)
    out = spark.read.parquet(path)
    out._cut = path
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan reads any more. It
    does so when the driver's garbage is collected, which a driver with memory
    to spare may put off until the disks are full."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete these lineage cuts, which nothing reads any more; a frame that
    is no lineage cut is left alone."""
    for df in tables:
        sc, path = df.sparkSession.sparkContext, vars(df).get("_cut")
        if path in _CUTS.get(sc.applicationId, []):
            _CUTS[sc.applicationId].remove(path)
            _delete(sc, path)


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Tables written by ``cut_lineage`` and frames persisted by ``keep``, by application.
_CUTS: dict[str, list[str]] = {}
_KEPT: dict[str, list[DataFrame]] = {}


def release(spark: SparkSession) -> int:
    """Delete the lineage cuts this application wrote and unpersist what it
    kept; returns the number of tables deleted. Call it once results are
    written: frames that still read a deleted table fail."""
    sc = spark.sparkContext
    for df in _KEPT.pop(sc.applicationId, []):
        df.unpersist()
    paths = _CUTS.pop(sc.applicationId, [])
    for path in paths:
        _delete(sc, path)
    return len(paths)


def keep(df: DataFrame) -> DataFrame:
    """Persist a result that is read several times within one job (memory,
    spilling to disk). Lineage stays, so lost blocks are recomputed."""
    _KEPT.setdefault(df.sparkSession.sparkContext.applicationId, []).append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (the Arrow UDFs are
    defined here): zip it once per application and register it with
    ``addPyFile``, Spark's own mechanism for shipping code to executors."""
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="weaklabel-py-"), "weaklabel.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
