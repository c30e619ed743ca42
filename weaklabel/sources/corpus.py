"""Sources and sinks (S1-S10): corpus readers, vector files, fingerprinted
stage outputs, dataset statistics."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import CODEC, cut_lineage, drop_shuffles


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a scan at least ``min_partitions`` (default: the cluster's
    parallelism) tasks. A large input already has more splits than that and
    is returned as is, with no shuffle; a small or single-row-group file is
    spread round-robin so text work does not run on one core."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def as_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "sentence",
              label_col: str = "label") -> DataFrame:
    """Rename to the corpus contract ``(doc_id, sentence, label)``."""
    missing = [c for c in (id_col, text_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"corpus is missing columns {missing}")
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                     F.col(text_col).cast("string").alias("sentence"),
                     F.col(label_col).cast("string").alias("label"))


def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
                text_col: str = "sentence", label_col: str = "label", **options) -> DataFrame:
    """Read a corpus from Parquet, JSON or CSV. Only the three needed
    columns reach the plan, so the scan prunes everything else."""
    df = spark.read.format(fmt).options(**options).load(path)
    return spread(as_corpus(df, id_col, text_col, label_col))


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    """Q13: ids that occur more than once (empty when the corpus is valid)."""
    return corpus.groupBy("doc_id").count().where("count > 1")


def assert_unique_ids(corpus: DataFrame) -> DataFrame:
    """Fail early on duplicate ``doc_id`` (one aggregate job)."""
    dup = duplicate_ids(corpus).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate doc_id {dup[0]['doc_id']}")
    return corpus


def full_corpus(split_corpus: DataFrame) -> DataFrame:
    """Labelled and unlabelled parts as joined text, with the part."""
    return split_corpus.select("doc_id", "split", "label",
                               F.array_join("tokens", " ").alias("text"))


def corpus_statistics(split_corpus: DataFrame) -> DataFrame:
    """Size, mean token count and distinct labels per part."""
    return (split_corpus.groupBy("split")
            .agg(F.count(F.lit(1)).alias("size"),
                 F.avg(F.size("tokens")).alias("avg_length"),
                 F.countDistinct("label").alias("n_classes")))


# ---------------------------------------------------------------- vectors

def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors in the text format ``word v1 ... vn`` (one per line).
    A first line of two whole numbers is the ``count dim`` header. Numbers are
    taken from the right, so terms may hold blanks; a line too short for the
    dimension is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "term string, vector array<double>, n_occ bigint")
    head = first[0]["value"].split()
    header = len(head) == 2 and all(x.isascii() and x.isdigit() for x in head)
    if header:
        dim = int(head[1])
        lines = lines.where(F.trim("value") != first[0]["value"].strip())
    else:                                               # the shortest line is a term without a blank
        dim = lines.select(F.min(F.size(F.split(F.trim("value"), " ")))).first()[0] - 1
    p = lines.select(F.split(F.trim("value"), " ").alias("p"))
    n = F.size("p")
    ok = F.when(n > dim, F.lit(True)).otherwise(F.raise_error(F.lit(f"a line has fewer than {dim} numbers")).cast("boolean"))
    return p.where(ok).select(
        F.array_join(F.slice("p", 1, n - dim), " ").alias("term"),
        F.transform(F.slice("p", n - dim + 1, dim), lambda x: x.cast("double")).alias("vector"),
        F.lit(None).cast("bigint").alias("n_occ"))


def write_text_vectors(word_vectors: DataFrame, path: str) -> None:
    """Inverse of ``read_text_vectors`` (no header line)."""
    (word_vectors.select(F.concat_ws(" ", "term", F.array_join(
        F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
     .write.mode("overwrite").text(path))


def save_word_vectors(word_vectors: DataFrame, path: str, config: dict) -> None:
    """Vectors as Parquet, config as JSON beside them."""
    word_vectors.write.mode("overwrite").parquet(path)
    _write_json(word_vectors.sparkSession, os.path.join(path, "_config.json"), config)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The dimension is ``size(vector)``."""
    return spark.read.parquet(path).select("term", "vector", "n_occ")


# ------------------------------------------------------- stage reuse

def fingerprint(config: dict, upstream: str = "") -> str:
    """Stable id of a stage's settings plus its upstream stage's id."""
    blob = json.dumps({"config": config, "upstream": upstream}, sort_keys=True, default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return fs.exists(p)


def _write_json(spark: SparkSession, path: str, obj: dict) -> None:
    fs, p = _hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(obj, sort_keys=True, default=str).encode()))
    out.close()


def cached_stage(spark: SparkSession, root: str, name: str, config: dict, compute,
                 upstream: str = "", partition_by: list[str] | None = None):
    """Reuse a stage's Parquet output when its settings and upstream are
    unchanged, else compute, write and re-read it. Returns
    ``(DataFrame, fingerprint)``; the fingerprint feeds the next stage, so a
    changed upstream forces a rerun downstream. Works on any Hadoop path."""
    fp = fingerprint(config, upstream)
    path = f"{root.rstrip('/')}/{name}-{fp}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        w = compute().write.mode("overwrite").option("compression", CODEC)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        drop_shuffles(spark)
        _write_json(spark, f"{path}/_config.json", {"name": name, "config": config,
                                                    "upstream": upstream})
    return spark.read.parquet(path), fp


def input_digest(df: DataFrame) -> str:
    """Id of what ``df`` reads: its files with lengths and times of change, and
    its plan; a table without files is digested by its rows (one aggregate)."""
    spark = df.sparkSession
    files = []
    for name in sorted(df.inputFiles()):
        fs, p = _hadoop_fs(spark, name)
        status = fs.getFileStatus(p)
        files.append([name, status.getLen(), status.getModificationTime()])
    if files:
        return fingerprint({"files": files, "plan": df._jdf.queryExecution().analyzed().canonicalized().toString()})
    n, h = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(30,0)"))).first()
    return fingerprint({"rows": n, "hash": str(h), "schema": df.schema.json()})


def settings_of(config: dict) -> dict:
    """``config`` with functions by name and tables by their input, so that
    its fingerprint is the same in every session."""
    return {k: f"{v.__module__}.{v.__qualname__}" if callable(v) else input_digest(v) if isinstance(v, DataFrame) else v
            for k, v in config.items()}


class Stages:
    """S4 across a run: each stage's table is kept under ``root`` by the
    fingerprint of its settings and of the stages it reads, from the input's
    digest on, and is read back if it is there; so a changed setting or input
    reruns what hangs on it and nothing else. Without a root stages are lineage
    cuts of this run. A function counts as changed with its name only.
    ``written`` lists the stages that this run computed."""

    def __init__(self, spark: SparkSession, root: str | None, source: DataFrame):
        self.spark, self.root = spark, root
        self.ids = {"source": input_digest(source)} if root else {}
        self.written: list[str] = []

    def __call__(self, name: str, inputs: list[str], config: dict, compute) -> DataFrame:
        def noted():
            self.written.append(name)
            return compute()
        if not self.root:
            return cut_lineage(noted(), name)
        upstream = "-".join(self.ids[i] for i in inputs)
        df, self.ids[name] = cached_stage(self.spark, self.root, name, settings_of(config), noted, upstream)
        return df


def write_split(split_corpus: DataFrame, path: str) -> None:
    """The processed corpus as one table partitioned by part, so a
    reader of one part scans only that part's files."""
    split_corpus.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col("split") == part)
