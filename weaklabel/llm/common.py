"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The batch's texts, a null one as the empty text."""
    return [t or "" for t in batch.column(col).to_pylist()]


def hashed_share(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """About ``rows`` of the rows of ``df``, chosen by a hash of ``cols``: the
    same ones each time, and none are sorted or gathered to choose them."""
    n = df.count()
    share = 1.0 if n <= rows else rows / n
    return df.where(F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(id, root)``, root
    the smallest id of the component; ids without an edge do not occur.

    Alternating large-star and small-star rounds: each node points its
    neighbours at the smallest one it sees. The edge table never grows, a
    round is two aggregations and two joins (AQE splits a hot centre), and
    each round's edges are written to the checkpoint folder. Rounds grow with
    the logarithm of the longest path."""
    def down(df):
        return (df.where("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut_lineage(down(edges), name)
    now = state(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = down(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        e = cut_lineage(down(small), name)
        was, now = now, state(e)
        if now == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
            .union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))
