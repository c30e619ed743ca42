"""Similarity and confidence.

Scoring documents against classes is map-only: the class matrix is small
by construction (one row per class), its size is checked, and it travels
as a broadcast variable to an Arrow-batched numpy matmul. No join, no
shuffle. A class table above the broadcast limit is cut into blocks, each
its own broadcast and its own column of the same projection; results are
merged per row, so the answer stays exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import cut_lineage

MAX_BROADCAST_BYTES = 256 << 20
#: Bytes of all blocks together; a larger table is no table of classes.
MAX_CLASS_BYTES = 2 << 30
#: Rows of either side that are multiplied at a time.
TILE = 2048


def normalize_vectors(df: DataFrame, vec: str = "vector") -> DataFrame:
    """V1."""
    return df.withColumn(vec, vx.normalize(F.col(vec)))


def _blocks(classes: DataFrame, vec: str, max_bytes: int):
    """Collect the class matrix in blocks of bounded size (checked first).
    Blocks are cut by position in the order of ``class_idx``, which may have
    gaps."""
    classes = classes.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _read_blocks(classes, vec, max_bytes)
    finally:
        classes.unpersist()


def _read_blocks(classes: DataFrame, vec: str, max_bytes: int):
    dim = classes.select(F.max(F.size(vec))).first()[0]
    ids = [r[0] for r in classes.select("class_idx").orderBy("class_idx").collect()]
    if 8 * len(ids) * int(dim or 1) > MAX_CLASS_BYTES:
        raise ValueError(f"{len(ids)} class vectors of {dim} dimensions exceed MAX_CLASS_BYTES")
    per_block = max(1, max_bytes // (8 * max(int(dim or 1), 1)))
    out = []
    for at in range(0, len(ids), per_block):
        block = ids[at:at + per_block]
        rows = (classes.where(F.col("class_idx").between(block[0], block[-1]))
                .select("class_idx", vec).orderBy("class_idx").collect())
        m = np.array([r[vec] for r in rows], dtype="float64")
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vx.EPS)
        out.append((m, np.array([r["class_idx"] for r in rows], dtype="int32")))
    return out


def _stack(s: pd.Series, dim: int):
    ok = s.notna().to_numpy()
    x = np.zeros((len(s), dim))
    if ok.any():
        x[ok] = np.stack(s[ok].to_numpy())
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vx.EPS)
    return x, ok


def _tops(x: np.ndarray, m: np.ndarray, k: int):
    """Row-wise the ``k`` greatest similarities and their columns, ties to the
    lower column; similarities exist for one tile at a time only."""
    k = min(k, len(m))
    best = np.full((len(x), k), -np.inf)
    where = np.zeros((len(x), k), dtype="int64")
    odd = not (np.isfinite(x).all() and np.isfinite(m).all())
    for i in range(0, len(x), TILE):
        for j in range(0, len(m), TILE):
            sims = x[i:i + TILE] @ m[j:j + TILE].T
            if odd and k > 1:
                sims[np.isnan(sims)] = -np.inf
            _merge(best[i:i + TILE], where[i:i + TILE], sims, j, k)
    return best, where


def _merge(best: np.ndarray, where: np.ndarray, sims: np.ndarray, first: int, k: int) -> None:
    """Take into ``best`` (rows falling) and ``where`` what beats it in a tile
    whose first column is ``first``, above all columns so far. Only similarities
    over a row's ``k``-th are sorted."""
    if k == 1:
        col = sims.argmax(axis=1)
        top = sims[np.arange(len(sims)), col]
        better = ~(best[:, 0] >= top) & ~np.isnan(best[:, 0])
        best[better, 0], where[better, 0] = top[better], col[better] + first
        return
    if np.isinf(best[:, -1]).any() and sims.shape[1] > k:    # so far fewer than k: the tile's own k-th is a bound
        r, c = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k, None])
    else:
        r, c = np.nonzero(sims > best[:, -1, None])
    if not len(r):
        return
    rows = np.unique(r)
    at = np.concatenate([np.repeat(rows, k), r])
    sim = np.concatenate([best[rows].ravel(), sims[r, c]])
    col = np.concatenate([where[rows].ravel(), c + first])
    order = np.lexsort((col, -sim, at))
    at, sim, col = at[order], sim[order], col[order]
    starts = np.searchsorted(at, rows)
    take = starts[:, None] + np.arange(k)
    best[rows], where[rows] = sim[take], col[take]


def _best_udf(bc):
    @F.pandas_udf("max_sim double, class_idx int")
    def best(v: pd.Series) -> pd.DataFrame:
        m, idx = bc.value
        x, ok = _stack(v, m.shape[1])
        sims, cols = _tops(x, m, 1)
        cls = pd.Series(np.where(ok, idx[cols[:, 0]], 0), dtype="Int32").mask(~ok)
        return pd.DataFrame({"max_sim": pd.Series(np.where(ok, sims[:, 0], np.nan)).mask(~ok),
                             "class_idx": cls})
    return best


def _topk_udf(bc, k: int):
    @F.pandas_udf("array<struct<neg_sim:double,class_idx:int>>")
    def topk(v: pd.Series) -> pd.Series:
        m, idx = bc.value
        x, ok = _stack(v, m.shape[1])
        sims, cols = _tops(x, m, k)
        rows = [[{"neg_sim": s, "class_idx": c} for s, c in zip(a, b)]
                for a, b in zip((-sims).tolist(), idx[cols].tolist())]
        return pd.Series([r if o else None for r, o in zip(rows, ok)], dtype="object")
    return topk


def classify(docs: DataFrame, classes: DataFrame, vec: str = "vector",
             max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """V2/V4: nearest class by cosine. ``classes(label, class_idx, vector)``.
    Adds ``max_sim``, ``class_idx``, ``best_label``; ties go to the lower
    ``class_idx``; a NULL document vector gives NULLs (Q3)."""
    spark = docs.sparkSession
    blocks = _blocks(classes, vec, max_broadcast_bytes)
    if not blocks:
        return (docs.withColumn("max_sim", F.lit(None).cast("double"))
                .withColumn("class_idx", F.lit(None).cast("int"))
                .withColumn("best_label", F.lit(None).cast("string")))
    cols = []
    for b in blocks:
        r = _best_udf(spark.sparkContext.broadcast(b))(F.col(vec))
        cols.append(F.struct(r["max_sim"].alias("s"), (-r["class_idx"]).alias("neg_idx")))
    best = cols[0] if len(cols) == 1 else F.greatest(*cols)
    names = classes.select("class_idx", F.col("label").alias("best_label"))
    out = (docs.withColumn("_best", best)
           .withColumn("max_sim", F.col("_best.s"))
           .withColumn("class_idx", (-F.col("_best.neg_idx")).cast("int"))
           .drop("_best"))
    return out.join(names, "class_idx", "left")


def cosine_topk(docs: DataFrame, classes: DataFrame, k: int = 8, vec: str = "vector",
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """V3: the ``k`` most similar rows of ``classes`` per document, as rows
    ``(.., rank, class_idx, sim)``; includes the document itself when both
    tables are the same. Blocks above the broadcast limit are merged per row."""
    spark = docs.sparkSession
    blocks = _blocks(classes, vec, max_broadcast_bytes)
    if not blocks:
        keep_cols = [c for c in docs.columns if c != vec]
        return docs.where(F.lit(False)).select(*keep_cols, F.lit(0).alias("rank"), F.lit(0).alias("class_idx"),
                                               F.lit(0.0).alias("sim"))
    parts = [_topk_udf(spark.sparkContext.broadcast(b), k)(F.col(vec)) for b in blocks]
    allk = parts[0] if len(parts) == 1 else F.concat(*parts)
    merged = F.slice(F.array_sort(allk), 1, k)
    keep = [c for c in docs.columns if c != vec]
    return (docs.select(*keep, F.posexplode(merged).alias("_r", "_t"))
            .select(*keep, (F.col("_r") + 1).alias("rank"), F.col("_t.class_idx").alias("class_idx"),
                    (-F.col("_t.neg_sim")).alias("sim")))


#: Bytes and rows of one block of vectors; a task of ``self_topk`` holds two.
BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 16_384
#: Rows of a block that is not cut further to give every core a pair of blocks.
LEAST_ROWS = 1_024


def self_topk(df: DataFrame, k: int = 8, vec: str = "vector", id_col: str = "vec_id",
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """V3 with ``self_sim``: for each row the ``k`` most similar rows of the
    same table, itself included, as ``(id, rank, neighbour, sim)``; ties go to
    the smaller id. Rows without a vector are left out, a zero vector is
    similar to nothing (0).

    Rows are dealt to blocks of bounded size, enough of them that the pairs of
    blocks employ every core, and each pair is multiplied once, tile by tile, for the rows of both. A pair of blocks
    hands on ``k`` neighbours a row and no pairs; the best ``k`` of all blocks
    are found by a ranking that Spark limits per task before the shuffle.
    Nothing is collected but a count and the dimension, so the table may be of
    any size (the products still grow with its square)."""
    rows = cut_lineage(df.where(F.col(vec).isNotNull()).select(
        F.monotonically_increasing_id().alias("nr"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x")), "self-rows")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    spread = min(-(-n // LEAST_ROWS), int((8 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1)
    parts = max(1, -(-n * 8 * max(dim or 1, 1) // block_bytes), -(-n // BLOCK_ROWS), spread)
    block = F.pmod(F.xxhash64("nr"), F.lit(parts)).cast("int")
    dealt = (rows.select(block.alias("b"), "id", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o"))
             .select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "x"))
    id_type = rows.schema["id"].dataType.simpleString()

    def tops(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vx.EPS)
        mine = group.column("b").to_numpy() == key[0].as_py()
        sides = [(mine, mine)] if key[0] == key[1] else [(mine, ~mine), (~mine, mine)]
        ids, others, sims = [], [], []
        for left, right in sides:
            if not left.any() or not right.any():
                continue
            best, cols = _tops(x[left], x[right], k)
            width = best.shape[1]
            ids.append(np.repeat(np.flatnonzero(left), width))
            others.append(np.flatnonzero(right)[cols].ravel())
            sims.append(best.ravel())
        at = np.concatenate(ids or [np.empty(0, np.int64)])
        to = np.concatenate(others or [np.empty(0, np.int64)])
        names = group.column("id").combine_chunks()
        return pa.table({"id": names.take(pa.array(at)), "neighbour": names.take(pa.array(to)),
                         "sim": pa.array(np.concatenate(sims or [np.empty(0)]))})
    pairs = dealt.repartition(parts * (parts + 1) // 2, "i", "j")      # as many tasks as pairs, however few their bytes
    found = pairs.groupBy("i", "j").applyInArrow(tops, f"id {id_type}, neighbour {id_type}, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), F.asc("neighbour"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("id").alias(id_col), "rank", "neighbour", "sim"))


def confidence_split(scored: DataFrame, threshold: float = 0.1) -> DataFrame:
    """V7: ``is_confident`` iff ``max_sim >= threshold`` (unconfident is the
    strict ``<``); NULL similarity is unconfident."""
    return scored.withColumn("is_confident", F.coalesce(F.col("max_sim") >= F.lit(float(threshold)),
                                                        F.lit(False)))


def similarity_histogram(scored: DataFrame, col: str = "max_sim", bins: int = 10) -> DataFrame:
    """V5/V6: ``bins`` equal bins from min to max (numpy's rule: the last bin
    is closed; equal min and max widen to +-0.5), with counts and the
    cumulative share in percent, half-even to one decimal. Empty bins stay.
    ``(bin, lo, hi, count, cum_pct)``; the cumulative share belongs to ``hi``."""
    spark = scored.sparkSession
    x = scored.where(F.col(col).isNotNull() & ~F.isnan(col)).select(F.col(col).alias("x"))
    # two numbers reach the driver (one partial aggregate), then the bin rule
    # is a constant expression that stays in generated code
    mn0, mx0 = x.agg(F.min("x"), F.max("x")).first()
    if mn0 is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint, cum_pct double")
    if mn0 == mx0:
        mn0, mx0 = mn0 - 0.5, mx0 + 0.5
    mn, mx = F.lit(float(mn0)), F.lit(float(mx0))
    step = (mx - mn) / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, mx).otherwise(i * step + mn)
    raw = F.floor((F.col("x") - mn) * (F.lit(float(bins)) / (mx - mn))).cast("int")
    i0 = F.when(raw >= bins, bins - 1).otherwise(raw)
    i1 = F.when(F.col("x") < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((F.col("x") >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1)
    counts = x.select(i2.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return (grid.join(counts, "bin", "left").fillna(0, ["count"])
            .withColumn("lo", edge(F.col("bin")))
            .withColumn("hi", edge(F.col("bin") + 1))
            .withColumn("cum_pct", F.bround(F.sum("count").over(run) / F.sum("count").over(total) * 100.0, 1))
            .select("bin", "lo", "hi", "count", "cum_pct"))


def pair_cosine(pairs: DataFrame, u: str = "u_vec", v: str = "v_vec", out: str = "cosine") -> DataFrame:
    """V8: cosine of two vector columns; NULL when either is missing or zero."""
    return pairs.withColumn(out, vx.cosine(F.col(u), F.col(v)))


def word_pair_cosine(pairs: DataFrame, word_vectors: DataFrame, stemmer=None,
                     use_stem: bool = True) -> DataFrame:
    """V9: ``pairs(u, v)`` of words, each looked up with E2's fallbacks;
    NULL when either word is unknown."""
    from .embeddings import word_lookup
    words = pairs.select(F.col("u").alias("term")).union(pairs.select(F.col("v").alias("term")))
    vec = word_lookup(words, word_vectors, stemmer, use_stem)
    uv = vec.select(F.col("term").alias("u"), F.col("vector").alias("u_vec"))
    vv = vec.select(F.col("term").alias("v"), F.col("vector").alias("v_vec"))
    return pair_cosine(pairs.join(uv, "u", "left").join(vv, "v", "left")).drop("u_vec", "v_vec")


def collapse_truth(df: DataFrame, unseen: DataFrame, col: str = "label") -> DataFrame:
    """T11 with a label table: labels not in ``unseen`` become 'Others'."""
    u = unseen.select(F.col("label").alias("_u")).distinct()
    return (df.join(u, df[col] == u["_u"], "left")
            .withColumn(col, F.when(F.col("_u").isNotNull(), F.col(col)).otherwise(F.lit("Others")))
            .drop("_u"))
