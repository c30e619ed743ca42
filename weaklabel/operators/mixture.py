"""Fits of k-means (U1) and Gaussian mixtures (U2/U3) that update all
restarts from one scan a round.

A round broadcasts the current centres or mixtures of every open restart,
sums their statistics inside each task, and adds these sums up as a partial
aggregate: what is shuffled and what reaches the driver does not grow with
the rows. The driver only solves the small matrices of the components.
Starts are drawn on Spark too: each row gets an exponential key over its
weight, and the least key wins, which draws a row in proportion to it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of one batch's distances or densities.
WORK_BYTES = 32 << 20
#: Bytes of a block that is passed over several times.
CACHE_BYTES = 4 << 20


def numbered(df: DataFrame, vec: str = "vector") -> DataFrame:
    """``(nr, x)``: the rows with a vector, numbered once and written, so that
    every scan sees the same rows under the same numbers."""
    x = F.col(vec).cast("array<double>").alias("x")
    return cut_lineage(df.where(F.col(vec).isNotNull()).select(F.monotonically_increasing_id().alias("nr"), x), "fit-rows")


def matrix(batch: pa.RecordBatch, col: str = "x") -> np.ndarray:
    """The batch's vectors as rows."""
    lists = batch.column(col)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks(n: int, width: int, work: int = WORK_BYTES):
    """Slices of ``n`` rows whose work of ``width`` numbers a row stays bounded."""
    step = max(1, work // (8 * max(1, width)))
    return (slice(a, a + step) for a in range(0, n, step))


def sums(rows: DataFrame, statistics, shape: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
    """``{(restart, component): statistics}`` summed over all rows.
    ``statistics(matrix, total)`` adds a batch to an array of ``shape``
    (restarts, components, numbers); a task sends one row for each pair."""
    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                statistics(matrix(b), total)
        r, c = np.indices(shape[:2]).reshape(2, -1)
        yield pa.record_batch([pa.array(r, pa.int32()), pa.array(c, pa.int32()),
                               pa.array(list(total.reshape(-1, shape[2])), pa.list_(pa.float64()))], names=["r", "c", "s"])
    parts = rows.select("x").mapInArrow(run, "r int, c int, s array<double>")
    summed = parts.groupBy("r", "c").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return {(row["r"], row["c"]): np.array(row["s"]) for row in summed.collect()}


# ---------------------------------------------------------------- k-means

def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres), never negative."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
    return np.maximum(d, 0)


def uniforms(nr: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row and the salts alone (mixing
    steps of a 64-bit hash)."""
    z = nr.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salts:
            z = (z ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def spread_starts(rows: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """(restarts, k, dimensions): k-means++ starts. Each further centre is a
    row drawn in proportion to its squared distance from those before it, for
    all restarts in the same scan."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(k):
        now = rows.sparkSession.sparkContext.broadcast([np.array(c) for c in chosen])

        def run(batches, now=now, step=step):
            best = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, nr = matrix(b), b.column("nr").to_numpy()
                for r in range(restarts):
                    w = np.ones(len(x))
                    if step:
                        w = np.concatenate([squared_distances(x[s], now.value[r]).min(1) for s in blocks(len(x), step)])
                    with np.errstate(divide="ignore"):
                        key = -np.log(uniforms(nr, seed, r, step)) / w     # infinite where a centre already lies
                    i = int(np.lexsort((nr, key))[0])
                    if r not in best or (key[i], nr[i]) < best[r][:2]:
                        best[r] = (float(key[i]), int(nr[i]), x[i].tolist())
            cols = list(zip(*((r, *v) for r, v in best.items()), strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.list_(pa.float64()))], names=["r", "key", "nr", "x"])
        least = (rows.mapInArrow(run, "r int, key double, nr bigint, x array<double>")
                 .groupBy("r").agg(F.min_by("x", F.struct("key", "nr")).alias("x")))
        for row in least.collect():
            chosen[row["r"]].append(np.array(row["x"]))
    return np.array(chosen)


def lloyd(rows: DataFrame, starts: np.ndarray, max_iter: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost) of every restart. A restart stops when its centres move
    by at most ``tol`` of the data's mean variance; an empty cluster keeps its
    centre; ties go to the lower cluster."""
    centres = np.array(starts, np.float64)
    restarts, k, dim = centres.shape
    cost = np.full(restarts, np.inf)
    open_ = np.ones(restarts, bool)
    limit = None
    for i in range(max_iter + 1):
        now = rows.sparkSession.sparkContext.broadcast((centres, open_.copy()))

        def statistics(x, total, now=now):
            c, live = now.value
            for s in blocks(len(x), k * restarts):
                part = x[s]
                for r in np.flatnonzero(live):
                    d = squared_distances(part, c[r])
                    own = d.argmin(1)
                    total[r, :, 0] += np.bincount(own, minlength=k)
                    total[r, :, 1] += np.bincount(own, d[np.arange(len(part)), own], minlength=k)
                    place = (own[:, None] * dim + np.arange(dim)).ravel()
                    total[r, :, 2:2 + dim] += np.bincount(place, part.ravel(), k * dim).reshape(k, dim)
                    total[r, :, 2 + dim:] += np.bincount(place, (part * part).ravel(), k * dim).reshape(k, dim)
        got = sums(rows, statistics, (restarts, k, 2 + 2 * dim))
        s = np.array([[got[r, c] for c in range(k)] for r in range(restarts)])
        if limit is None:
            n = s[0, :, 0].sum()
            mean = s[0, :, 2:2 + dim].sum(0) / n
            limit = tol * float((s[0, :, 2 + dim:].sum(0) / n - mean * mean).mean())
        for r in np.flatnonzero(open_):
            cost[r] = s[r, :, 1].sum()
            if i == max_iter:
                continue
            used = s[r, :, 0] > 0
            fresh = centres[r].copy()
            fresh[used] = s[r, used, 2:2 + dim] / s[r, used, 0][:, None]
            moved = ((fresh - centres[r]) ** 2).sum()
            centres[r] = fresh
            open_[r] = moved > limit
        if not open_.any() or i == max_iter:
            break
    if max_iter and not open_.all():
        cost = final_costs(rows, centres)
    return centres, cost


def final_costs(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Sum of squared distances to the nearest centre, by restart."""
    now = rows.sparkSession.sparkContext.broadcast(centres)

    def statistics(x, total):
        for s in blocks(len(x), centres.shape[1]):
            for r, c in enumerate(now.value):
                total[r, 0, 0] += squared_distances(x[s], c).min(1).sum()
    got = sums(rows, statistics, (len(centres), 1, 1))
    return np.array([got[r, 0][0] for r in range(len(centres))])


# --------------------------------------------------------------- mixtures

@dataclass
class Mixture:
    """Weights, means and the Cholesky factors of the inverse covariances."""
    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density), (rows, components)."""
        dim = x.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for c, (w, m, f) in enumerate(zip(self.weights, self.means, self.factors, strict=True)):
            y = (x - m) @ f
            out[:, c] = np.log(w) + np.log(np.diag(f)).sum() - 0.5 * (dim * np.log(2 * np.pi) + (y * y).sum(1))
        return out

    def expected(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(membership probabilities, sum of log-likelihoods)."""
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        p = np.exp(joint - top)
        total = p.sum(1, keepdims=True)
        return p / total, float((np.log(total) + top).sum())


def maximised(s: np.ndarray, dim: int, floor: float) -> Mixture:
    """The mixture of statistics (components, 1 + dim + dim * dim): summed
    probabilities, probability-weighted sums and products; ``floor`` is added
    to every variance."""
    n = s[:, 0] + 10 * np.finfo(float).eps
    means = s[:, 1:1 + dim] / n[:, None]
    factors = []
    for c in range(len(n)):
        cov = s[c, 1 + dim:].reshape(dim, dim) / n[c] - np.outer(means[c], means[c])
        cov = (cov + cov.T) / 2
        cov[np.diag_indices(dim)] += floor
        low = cholesky(cov, floor)
        factors.append(np.linalg.solve(low, np.eye(dim)).T)
    return Mixture(n / n.sum(), means, np.array(factors))


def cholesky(cov: np.ndarray, floor: float) -> np.ndarray:
    """Cholesky factor; a covariance that rounding left indefinite gets its
    small eigenvalues raised to the floor."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        return np.linalg.cholesky((vectors * np.maximum(values, max(floor, 1e-12))) @ vectors.T)


def weighted_statistics(x: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    """Add rows with membership probabilities to (components, numbers)."""
    dim = x.shape[1]
    total[:, 0] += p.sum(0)
    total[:, 1:1 + dim] += p.T @ x
    for c in range(p.shape[1]):
        total[c, 1 + dim:1 + dim + dim * dim] += ((x * p[:, c:c + 1]).T @ x).ravel()


def hard_start(rows: DataFrame, centres: np.ndarray, shift: np.ndarray, floor: float) -> list[Mixture]:
    """For each restart the mixture of the nearest-centre clusters."""
    restarts, k, dim = centres.shape
    now = rows.sparkSession.sparkContext.broadcast(centres)

    def statistics(x, total):
        for s in blocks(len(x), k + dim):
            for r, c in enumerate(now.value):
                own = squared_distances(x[s], c).argmin(1)
                weighted_statistics(x[s] - shift, np.eye(k)[own], total[r])
    got = sums(rows, statistics, (restarts, k, 1 + dim + dim * dim))
    return [maximised(np.array([got[r, c] for c in range(k)]), dim, floor) for r in range(restarts)]


def stacked_mixtures(mixtures: list[Mixture]):
    """Constants (restarts, components), factors side by side (dimensions,
    restarts * components * dimensions) and the means multiplied by them."""
    dim = mixtures[0].means.shape[1]
    f = np.stack([m.factors for m in mixtures])
    diagonal = np.log(np.diagonal(f, axis1=2, axis2=3)).sum(2)
    constant = np.log([m.weights for m in mixtures]) + diagonal - 0.5 * dim * np.log(2 * np.pi)
    means = np.einsum("rcd,rcde->rce", np.stack([m.means for m in mixtures]), f)
    return constant, f.transpose(2, 0, 1, 3).reshape(dim, -1), means.ravel()


def expected_of_all(x: np.ndarray, constant: np.ndarray, factors: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Mixture.expected`` of all restarts: (restarts, components, rows) and
    the sums of log-likelihoods. One multiplication serves all components, and
    rows come last, so that sums over the short axes run along them."""
    y = factors.T @ x.T
    y -= means[:, None]
    y *= y
    joint = constant[:, :, None] - 0.5 * y.reshape(*constant.shape, -1, len(x)).sum(2)
    top = joint.max(1, keepdims=True)
    p = np.exp(joint - top)
    total = p.sum(1, keepdims=True)
    p /= total
    return p, (np.log(total) + top).sum((1, 2))


def fit_mixtures(rows: DataFrame, starts: list[Mixture], shift: np.ndarray, max_iter: int = 100, tol: float = 1e-3,
                 floor: float = 1e-6) -> tuple[list[Mixture], np.ndarray]:
    """(mixtures, mean log-likelihood) of every restart by expectation
    maximisation. A restart stops when its mean log-likelihood changes by less
    than ``tol``. Vectors are shifted by ``shift``, which keeps products
    small; the mixtures are those of the shifted vectors."""
    mixtures = list(starts)
    k, dim = mixtures[0].means.shape
    restarts = len(mixtures)
    value = np.full(restarts, -np.inf)
    open_ = np.ones(restarts, bool)
    for _ in range(max_iter):
        now = rows.sparkSession.sparkContext.broadcast((mixtures, open_.copy()))

        def statistics(x, total, now=now):
            mix, live = now.value
            live = np.flatnonzero(live)
            every = stacked_mixtures([mix[r] for r in live])
            for s in blocks(len(x), (len(live) * k + dim) * dim, CACHE_BYTES):
                part = x[s] - shift
                p, ll = expected_of_all(part, *every)
                # all components' sums and products by one multiplication each
                flat = p.reshape(-1, len(part))
                got = np.empty((len(flat), 1 + dim + dim * dim))
                got[:, 0] = flat.sum(1)
                got[:, 1:1 + dim] = flat @ part
                got[:, 1 + dim:] = flat @ (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
                total[live, :, :-1] += got.reshape(len(live), k, -1)
                total[live, 0, -1] += ll
        got = sums(rows, statistics, (restarts, k, 2 + dim + dim * dim))
        for r in np.flatnonzero(open_):
            s = np.array([got[r, c] for c in range(k)])
            was, value[r] = value[r], s[0, -1] / s[:, 0].sum()
            mixtures[r] = maximised(s[:, :-1], dim, floor)
            open_[r] = not abs(value[r] - was) < tol
        if not open_.any():
            break
    return mixtures, value


def mean_vector(rows: DataFrame) -> np.ndarray:
    return np.array(rows.agg(vector_to_array(Summarizer.mean(array_to_vector("x")))).first()[0])


def with_memberships(df: DataFrame, mixture: Mixture, shift: np.ndarray, vec: str = "vector") -> DataFrame:
    """``df`` (all columns but ``vec``) with ``cluster`` and ``prob``, NULL
    where the vector is."""
    shared = df.sparkSession.sparkContext.broadcast(mixture)

    @F.pandas_udf("array<double>")
    def memberships(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        if ok.any():
            p, _ = shared.value.expected(np.stack(v[ok].to_numpy()).astype(float) - shift)
            out[ok] = pd.Series(list(p), index=v.index[ok])
        return out
    keep = [c for c in df.columns if c != vec]
    return (df.withColumn("prob", memberships(F.col(vec).cast("array<double>")))
            .withColumn("cluster", (F.array_position("prob", F.array_max("prob")) - 1).cast("int")).select(*keep, "cluster", "prob"))
