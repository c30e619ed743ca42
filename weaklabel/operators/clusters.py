"""Clustering and dimension reduction (U1-U6), plus the choice of the most
representative documents per cluster.

Fits read a lineage-cut copy of their input (written to the shared
checkpoint folder), since they make many passes over it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hash32
from ..session import cut_lineage
from . import mixture as mx


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).withColumn("_features", array_to_vector(F.col(vec)))


def kmeans(df: DataFrame, k: int, restarts: int = 10, seed: int = 0, vec: str = "vector",
           max_iter: int = 300, tol: float = 1e-4, starts: np.ndarray | None = None) -> DataFrame:
    """K-means with ``restarts`` seeded ++ starts (or the given ``starts``,
    (restarts, k, dimensions)), all updated from one scan a round, keeping the
    least cost. Adds ``cluster`` and a one-hot ``prob`` (Q7: k-means has no
    soft assignment). Rows with a NULL vector get NULL (Q3)."""
    rows = mx.numbered(df, vec)
    if rows.isEmpty():
        return _attach(df, df.where(F.lit(False)).drop(vec).select(
            "*", F.lit(0).alias("cluster"), F.array(F.lit(1.0)).alias("prob")), vec)
    if starts is None:
        starts = mx.spread_starts(rows, k, restarts, seed)
    centres, cost = mx.lloyd(rows, starts, max_iter, tol)
    best = df.sparkSession.sparkContext.broadcast(centres[int(cost.argmin())])

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, best.value.shape[1]))
        return pd.Series(mx.squared_distances(x, best.value).argmin(1).astype("int32"))
    data = df.where(F.col(vec).isNotNull())
    out = data.withColumn("cluster", nearest(F.col(vec).cast("array<double>"))).withColumn(
        "prob", F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                            lambda i: F.when(i == F.col("cluster"), 1.0).otherwise(0.0)))
    return _attach(df, out.select(*[c for c in df.columns if c != vec], "cluster", "prob"), vec)


def gmm(df: DataFrame, k: int, restarts: int = 10, seed: int = 0, vec: str = "vector",
        max_iter: int = 100, tol: float = 1e-3, floor: float = 1e-6) -> DataFrame:
    """Gaussian mixture with full covariances, ``restarts`` k-means
    starts, keeping the greatest log-likelihood. Adds ``cluster`` and ``prob``
    (membership probabilities). ``k = 1`` is answered directly: cluster 0,
    prob [1.0]."""
    keep = [c for c in df.columns if c != vec]
    rows = None if k == 1 else mx.numbered(df, vec)
    if k == 1 or rows.isEmpty():                        # Q16: no rows, no fit
        out = df.where(F.col(vec).isNotNull()).select(*keep, F.lit(0).alias("cluster"), F.array(F.lit(1.0)).alias("prob"))
        return _attach(df, out, vec)
    shift = mx.mean_vector(rows)
    centres, _ = mx.lloyd(rows, mx.spread_starts(rows, k, restarts, seed))
    starts = mx.hard_start(rows, centres, shift, floor)
    mixtures, value = mx.fit_mixtures(rows, starts, shift, max_iter, tol, floor)
    return mx.with_memberships(df, mixtures[int(value.argmax())], shift, vec)


def _attach(df: DataFrame, out: DataFrame, vec: str) -> DataFrame:
    """Rows without a vector are kept with NULL cluster (Q3)."""
    missing = df.where(F.col(vec).isNull()).drop(vec).select(
        "*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("array<double>").alias("prob"))
    return out.withColumn("cluster", F.col("cluster").cast("int")).unionByName(missing)


def cluster_samples(probs: DataFrame, k: int = 25, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """U4: per cluster the ``k`` documents most likely to belong to it.

    ``probs(id, cluster, prob)``; ``prob`` is the cluster's own probability
    (a DOUBLE, or the array indexed by ``cluster``). If the 1st and k-th
    largest are equal, the ``k`` are drawn among those tied at the top by a
    seeded hash; fewer rows give what there is (Q8). Both passes are top-k
    windows, which Spark limits per task before the shuffle."""
    p = probs.select(id_col, "cluster", (F.element_at("prob", F.col("cluster") + 1)
                                          if dict(probs.dtypes)["prob"].startswith("array")
                                          else F.col("prob")).alias("p"))
    p = p.where(F.col("cluster").isNotNull())
    first = Window.partitionBy("cluster").orderBy(F.desc("p"), F.asc(id_col))
    top = p.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k)
    edges = top.groupBy("cluster").agg(F.max("p").alias("_first"), F.min("p").alias("_kth"))
    tied = p.join(edges, "cluster").withColumn("_tied", F.col("_first") == F.col("_kth"))
    order = Window.partitionBy("cluster").orderBy(
        F.desc("p"), F.when(F.col("_tied"), hash32(seed, F.col(id_col))).otherwise(F.lit(0)), F.asc(id_col))
    return (tied.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("cluster", id_col, "rank", F.col("p").alias("prob")))


#: Dimensions up to which the covariance is made whole on the driver.
MAX_COVARIANCE = 2_048


@dataclass(frozen=True)
class Projection:
    """Mean, components (columns) and the variance each explains."""
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray


def subspace_pca(df: DataFrame, k: int, vec: str = "vector", oversample: int = 10, seed: int = 0,
                 max_scans: int = 200, tol: float = 1e-9) -> Projection:
    """U5 without a covariance: a random subspace of ``k + oversample``
    directions is multiplied by the centred data and its transpose, one scan a
    round, and made orthonormal, until the explained variances change by less
    than ``tol`` of the greatest. Only dimensions x directions numbers are ever
    in one place; a subspace as wide as the data is exact after one scan.
    Components point so that their largest entry is positive."""
    rows = mx.numbered(df, vec)
    if rows.isEmpty():
        raise ValueError("no vectors to fit")
    mean = mx.mean_vector(rows)
    n, dim = rows.count(), len(mean)
    k = min(k, dim)
    wide = min(dim, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, wide)))[0]
    was = None
    for _ in range(max_scans):
        now = rows.sparkSession.sparkContext.broadcast(q)

        def statistics(x, total, now=now):
            for s in mx.blocks(len(x), dim):
                y = x[s] - mean
                total[0] += (y @ now.value).T @ y
        got = mx.sums(rows, statistics, (1, wide, dim))
        z = np.array([got[0, c] for c in range(wide)]).T / max(1, n - 1)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, components = values[::-1][:k], (q @ turn[:, ::-1])[:, :k]
        if wide == dim or (was is not None and np.abs(values - was).max() <= tol * max(values[0], 1e-300)):
            break
        was, q = values, np.linalg.qr(z)[0]
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(k)])
    return Projection(mean, components * np.where(signs == 0, 1, signs), np.maximum(values, 0))


def pca_fit(df: DataFrame, k: int, vec: str = "vector"):
    """Beyond ``MAX_COVARIANCE`` dimensions by ``subspace_pca``, else
    centred PCA (MLlib's PCA alone does not subtract the mean when
    projecting; a mean-only StandardScaler does). Returns the fitted model."""
    if (df.select(F.max(F.size(vec))).first()[0] or 0) > MAX_COVARIANCE:
        return subspace_pca(df, k, vec)
    data = cut_lineage(_features(df, vec).select("_features"))
    pipe = Pipeline(stages=[
        StandardScaler(withMean=True, withStd=False, inputCol="_features", outputCol="_centred"),
        PCA(k=k, inputCol="_centred", outputCol="_pca"),
    ])
    return pipe.fit(data)


def pca_project(model, df: DataFrame, vec: str = "vector", out: str = "vector") -> DataFrame:
    """Project a table of vectors (documents or classes) with a
    fitted model; NULL vectors stay NULL."""
    keep = [c for c in df.columns if c not in (vec, out)]
    if isinstance(model, Projection):
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("array<double>")
        def projected(v: pd.Series) -> pd.Series:
            ok = v.notna()
            res = pd.Series([None] * len(v), index=v.index, dtype=object)
            if ok.any():
                y = (np.stack(v[ok].to_numpy()).astype(float) - shared.value.mean) @ shared.value.components
                res[ok] = pd.Series(list(y), index=v.index[ok])
            return res
        return df.select(*keep, projected(F.col(vec).cast("array<double>")).alias(out))
    proj = (model.transform(_features(df, vec))
            .select(*keep, vector_to_array("_pca").alias(out)))
    missing = df.where(F.col(vec).isNull()).select(*keep, F.lit(None).cast("array<double>").alias(out))
    return proj.unionByName(missing)


def pca_fit_transform(df: DataFrame, k: int, vec: str = "vector"):
    model = pca_fit(df, k, vec)
    return model, pca_project(model, df, vec)
