"""Embedding near-duplicates through a pivot-permutation index.

Pivots are reference vectors from a bounded sample, spaced so that no dense
group supplies more than a few. Each vector is described by its ``DEPTH`` nearest pivots in order; near vectors share most of them.
Inverted lists, one for each pivot and label, hold the vectors that have it,
and two vectors are candidates when they share at least ``SHARED`` pivots.
Such a pair also meets in the lists of the ``DEPTH - SHARED + 1`` rarest
pivots of either (prefix filter), so only these are listed. Lists are cut into
tiles by hash and compared tile by tile: shared-pivot counts first, then the
exact cosine in double precision, each pair counted only in the first list
that holds both. A tile returns link counts and a spanning forest, never its
pairs. Exact copies are collapsed into one weighted vector before.

The number of pivots grows with the square root of the number of vectors up
to ``MAX_PIVOTS``, so lists stay short; the pivot table is at most
``MAX_PIVOTS`` rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different lengths are not compared; repeated rows are vectors of their own; a
null vec_id is never a component id unless its group has no other; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, map_batches

COSINE = 0.98
DEPTH = 12
SHARED = 5
MIN_PIVOTS, MAX_PIVOTS = 128, 4_096
#: Pivots have a cosine below this to each other, or a higher one where vectors lie close; 1 less it is at least TIGHTEST. Rounds in which they are looked for, and the range of the hash that orders them.
SPACING = 0.9
TIGHTEST = 0.003
ROUNDS = 8
RANGE = 1 << 40
TILE = 1_024

CODED = "vec_id bigint, label string, dim int, key binary, unit binary"


def usable(vectors: DataFrame) -> DataFrame:
    """``CODED`` of every row: copies share ``key`` (16 bytes of the vector's
    digest); key and unit vector are null if it can link with nothing."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, keys, units = [], [], []
        labels = batch.column("label").to_pylist()
        for label, v in zip(labels, batch.column("embedding").to_pylist(), strict=True):
            x = np.array(v, np.float64) if v and None not in v else np.empty(0)
            big = np.abs(x).max() if len(x) else 0.0
            if label is None or not np.isfinite(big) or big == 0.0:
                dims.append(None), keys.append(None), units.append(None)
                continue
            y = x / big                                       # no overflow or underflow in the norm
            y = y / np.linalg.norm(y)
            dims.append(len(x))
            keys.append(hashlib.md5((x + 0.0).tobytes()).digest())
            units.append(y.tobytes())
        return pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()),
                                pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
                               names=["vec_id", "label", "dim", "key", "unit"])
    v = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(v, run, CODED)


def choose_pivots(reps: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` vectors of each length, taken in hash order if their cosine
    to all taken before is below a spacing, as rows of a matrix, by vector
    length. So a dense group, whatever its share, supplies a few pivots, and
    the other pivots of its members' lists lie far from all of them alike.

    Where all vectors lie close together (a narrow cone) hardly any are that
    far apart: a length that finds less than half of its pivots tries again
    with half the spacing, down to ``TIGHTEST``. About ``n`` vectors of a
    length are collected in a round."""
    place = F.pmod(F.xxhash64("key"), F.lit(RANGE))
    size = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    out: dict[int, np.ndarray] = {}
    gap = dict.fromkeys(size, 1 - SPACING)
    open_ = set(size)
    while open_:
        got = {d: np.empty((0, d)) for d in open_}
        at = dict.fromkeys(open_, 0)
        for _ in range(ROUNDS):
            short = {d: (at[d], min(RANGE, at[d] + -(-RANGE * n // size[d]))) for d in open_ if len(got[d]) < n and at[d] < RANGE}
            if not short:
                break
            mine = F.lit(False)
            for d, (low, high) in short.items():
                mine |= (F.col("dim") == d) & (place >= low) & (place < high)
                at[d] = high
            found: dict[int, list] = {}
            for r in sorted(reps.where(mine).select("dim", "label", "key", "unit", place.alias("place")).collect(),
                            key=lambda r: (r["place"], r["key"], r["label"])):
                found.setdefault(r["dim"], []).append(np.frombuffer(r["unit"]))
            for d, units in found.items():
                got[d] = spaced(got[d], np.stack(units), n, 1 - gap[d])
        for d in sorted(open_):
            out[d] = got[d] if d not in out or len(got[d]) > len(out[d]) else out[d]
            gap[d] /= 2
        open_ = {d for d in open_ if 2 * len(out[d]) < min(n, size[d]) and gap[d] >= TIGHTEST}
    return out


def spaced(taken: np.ndarray, units: np.ndarray, n: int, spacing: float = SPACING) -> np.ndarray:
    """``taken``, and of ``units`` in order those whose cosine to all before
    is below ``spacing``, up to ``n`` in all."""
    for a in range(0, len(units), 256):
        part = units[a:a + 256]
        if len(taken):
            part = part[(part @ taken.T).max(1) < spacing]
        cosines, fresh = part @ part.T, []
        for i in range(len(part)):
            if not fresh or cosines[i, fresh].max() < spacing:
                fresh.append(i)
        taken = np.concatenate([taken, part[fresh]])
        if len(taken) >= n:
            return taken[:n]
    return taken


def nearest(unit: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Indices of each row's nearest pivots, nearest first (ties: lower index)."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int32)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    coded = cut_lineage(usable(vectors), "vectors")
    reps = cut_lineage(coded.where("key is not null").groupBy("label", "dim", "key").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
        .withColumn("rep", F.xxhash64("label", "dim", "key")), "distinct-vectors")
    n = reps.count()
    want = MIN_PIVOTS
    while want < MAX_PIVOTS and want * want < n:
        want *= 2
    pivots = choose_pivots(reps, want)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column("dim").to_numpy()
        units = batch.column("unit").to_pylist()
        codes: list = [None] * len(units)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for a in range(0, len(rows), 2048):
                part = rows[a:a + 2048]
                got = nearest(np.stack([np.frombuffer(units[i]) for i in part]), pivots[int(d)], depth)
                for i, c in zip(part, got, strict=True):
                    codes[i] = c
        return pa.record_batch([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], names=[*batch.schema.names, "code"])
    described = cut_lineage(map_batches(
        reps.select("rep", "label", "dim", "copies", "unit"), code,
        "rep bigint, label string, dim int, copies bigint, unit binary, code array<int>"), "described")

    # List lengths by pivot, all labels together: at most `want` rows a vector length.
    used = {(r["dim"], r["p"]): r["n"] for r in described.select("dim", F.explode("code").alias("p"))
            .groupBy("dim", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {d: np.argsort(np.argsort([used.get((d, p), 0) for p in range(len(m))], kind="stable"), kind="stable").astype(np.int32)
            for d, m in pivots.items()}

    def reorder(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Pivots by rising list length, as the prefix filter needs them."""
        dims = batch.column("dim").to_pylist()
        codes = [np.sort(rank[d][np.array(c)]) for d, c in zip(dims, batch.column("code").to_pylist(), strict=True)]
        lists = [c[:max(1, len(c) - shared + 1)] for c in codes]
        return pa.record_batch([*batch.columns[:5], pa.array(codes, pa.list_(pa.int32())),
                                pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])
    listed = map_batches(described, reorder, "rep bigint, label string, dim int, copies bigint, unit binary, "
                         "code array<int>, lists array<int>")
    listed = listed.select("rep", "label", "dim", "copies", "unit", "code", F.explode("lists").alias("pivot"))
    sizes = listed.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n"))
    # A list of n vectors is cut into n / TILE slices by hash; each slice meets each other one once.
    sliced = (listed.join(sizes, ["label", "dim", "pivot"])
              .withColumn("slices", F.ceil(F.col("n") / F.lit(TILE)).cast("int"))
              .withColumn("slice", F.pmod(F.xxhash64("rep", "pivot"), F.col("slices")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .select("rep", "label", "dim", "pivot", "copies", "unit", "code", "slice",
                      F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b")))

    def compare(t: pa.Table) -> pa.Table:
        return compare_tile(t, cosine, shared)
    found = cut_lineage(sliced.groupBy("label", "dim", "pivot", "a", "b")
                        .applyInArrow(compare, "rep bigint, links bigint, root bigint"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("root <> rep").select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-components")
    grouped = reps.select("rep", "label", "dim", "key", "first_id", "copies").join(links, "rep", "left").join(
        roots, F.col("rep") == F.col("id"), "left").withColumn("root", F.coalesce("root", "rep"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select(
        "label", "dim", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = coded.where("key is not null").select("vec_id", "label", "dim", "key").join(named, ["label", "dim", "key"]).select(
        "vec_id", "n_links", "component_id").union(
        coded.where("key is null").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def compare_tile(t: pa.Table, cosine: float, shared: int) -> pa.Table:
    """Of the vectors of one tile that have links: how many (copies counted),
    and the smallest vector their links in this tile reach."""
    from .simhash import forest
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    pivot = t.column("pivot")[0].as_py()
    slice_ = t.column("slice").to_numpy()
    order = np.lexsort((t.column("rep").to_numpy(), slice_))
    rep, copies, slice_ = t.column("rep").to_numpy()[order], t.column("copies").to_numpy()[order], slice_[order]
    units = t.column("unit").to_pylist()
    unit = np.stack([np.frombuffer(units[i]) for i in order])
    code = np.stack(t.column("code").to_numpy()[order])
    bits = np.zeros((len(rep), int(code.max()) + 1), np.float32)
    bits[np.arange(len(rep))[:, None], code] = 1.0
    cut = max(1, code.shape[1] - shared + 1)
    prefix = np.zeros_like(bits)
    prefix[np.arange(len(rep))[:, None], code[:, :cut]] = 1.0
    prefix = prefix[:, :pivot]                               # lists that come before this one
    need = min(shared, code.shape[1])
    left, right = np.flatnonzero(slice_ == a), np.flatnonzero(slice_ == b)
    count = np.zeros(len(rep), np.int64)
    root = np.arange(len(rep))
    for x in range(0, len(left), 1024):
        i0 = left[x:x + 1024]
        for y in range(0, len(right), 1024):
            j0 = right[y:y + 1024]
            ok = bits[i0] @ bits[j0].T >= need               # shared-pivot counts
            if pivot:
                ok &= prefix[i0] @ prefix[j0].T == 0         # counted in an earlier list otherwise
            if a == b:
                ok &= i0[:, None] < j0[None, :]
            if not ok.any():
                continue
            ok &= unit[i0] @ unit[j0].T >= cosine
            i, j = np.nonzero(ok)
            i, j = i0[i], j0[j]
            count += np.bincount(i, copies[j], len(rep)).astype(np.int64) + np.bincount(j, copies[i], len(rep)).astype(np.int64)
            forest(root, np.minimum(i, j), np.maximum(i, j))
    has = np.flatnonzero(count)
    return pa.table({"rep": rep[has], "links": count[has], "root": rep[root[has]]})
