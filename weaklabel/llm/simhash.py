"""SimHash near-duplicates through vantage-point trees.

Every text becomes a 64-bit fingerprint: bit i is one if it is set in over
half of the XXH64 hashes of the text's word shingles. Distinct fingerprints
are then partitioned by Hamming distance: a vantage-point tree built from a
bounded sample cuts them into shards, the inside of a node being the
fingerprints within distance ``mu`` of its vantage point. A pair that a node
separates has its inside member within ``radius`` of the boundary (triangle
inequality), so exactly those members are copied to the outside as well:
every pair within ``radius`` bits meets in at least one shard. A shard is cut
in the same way by vantage points of its own until it is small, and its
remaining pairs are compared exactly. A shard returns a spanning forest of its
links, never all pairs of a group, and the links' components are found on
Spark.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; a null doc_id never becomes a
component id unless a group has no other (then it is null); repeated rows get
a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .common import components, free_name, hashed_share, map_batches, texts_of

#: Shingle words, seed and link radius of the contract.
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints a shard should hold, sample for the tree (about), most shards (the tree is a closure of at most that size).
SHARD_ROWS = 2_000
SAMPLE_ROWS = 65_536
MAX_SHARDS = 4_096
#: Below this many fingerprints all pairs of a part are compared.
LEAF = 384
PART = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The text's fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for i in range(0, n, PART):                      # bounded memory for very long texts
        part = words[i:min(n, i + PART) + size - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        x = np.fromiter((h(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, fp the fingerprint as a signed long; map-only."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, size) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, fp bigint")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def cut(fps: np.ndarray, vantage: np.uint64) -> int | None:
    """The boundary that halves ``fps`` best as seen from ``vantage``; None
    if it leaves them all on one side."""
    n = np.cumsum(np.bincount(distance(fps, vantage), minlength=65))
    mu = int(np.argmin(np.abs(n - len(fps) / 2)))
    return mu if 0 < n[mu] < len(fps) else None


def split(fps: np.ndarray, vantage: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the members inside, and of those outside with the inside's
    boundary members, which may have a partner there."""
    d = distance(fps, vantage)
    return d <= mu, d > mu - radius


def tree(sample: np.ndarray, shards: int):
    """Nested ``(vantage, mu, inside, outside)``; a leaf is its number."""
    leaves = 0

    def grow(fps: np.ndarray, want: int, level: int):
        nonlocal leaves
        found = None
        if want > 1 and len(fps) >= 4:
            rng = np.random.default_rng(level * 7919 + len(fps))
            for v in fps[rng.choice(len(fps), min(8, len(fps)), replace=False)]:
                if (mu := cut(fps, v)) is not None:
                    edge = float(np.mean((distance(fps, v) > mu - RADIUS) & (distance(fps, v) <= mu)))
                    if found is None or edge < found[0]:
                        found = (edge, v, mu)
        if found is None:
            leaves += 1
            return leaves - 1
        _, v, mu = found
        d = distance(fps, v)
        return v, mu, grow(fps[d <= mu], want // 2, level + 1), grow(fps[d > mu], want - want // 2, level + 1)
    return grow(sample, shards, 1)


def route(node, fps: np.ndarray, rows: np.ndarray, radius: int, out: list) -> None:
    """Append ``(shard, rows)`` for every shard that the fingerprints reach."""
    if not len(rows):
        return
    if not isinstance(node, tuple):
        out.append((node, rows))
        return
    v, mu, inside, outside = node
    i, o = split(fps[rows], v, mu, radius)
    route(inside, fps, rows[i], radius, out)
    route(outside, fps, rows[o], radius, out)


def near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of a spanning set of the pairs within ``radius`` bits.

    An explicit stack stands in for the recursion, so memory stays linear. In
    a leaf each member is linked to the first member it is near to and, if a
    later one is near too, on from there: at most as many links as near
    members, with the same components as all pairs."""
    us, vs = [], []
    rng = np.random.default_rng(0)
    stack = [np.arange(len(fps))]
    while stack:
        rows = stack.pop()
        if len(rows) > LEAF:
            best = None
            for v in fps[rows[rng.choice(len(rows), 6, replace=False)]]:
                mu = cut(fps[rows], v)
                if mu is not None:
                    i, o = split(fps[rows], v, mu, radius)
                    size = max(int(i.sum()), int(o.sum()))
                    if size < len(rows) and (best is None or size < best[0]):
                        best = (size, i, o)
            if best is not None and best[0] < 0.95 * len(rows):
                stack += [rows[best[1]], rows[best[2]]]
                continue
        root = np.arange(len(rows))                      # blocked: a dense part stays within memory
        for a in range(0, len(rows), 1024):
            x = fps[rows[a:a + 1024]]
            for b in range(a, len(rows), 1024):
                i, j = np.nonzero(distance(x[:, None], fps[rows[b:b + 1024]][None, :]) <= radius)
                i, j = i + a, j + b
                keep = i < j
                forest(root, i[keep], j[keep])
        child = np.flatnonzero(root != np.arange(len(rows)))
        us.append(rows[child])
        vs.append(rows[root[child]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the links ``(i, j)`` into ``root``, the smallest index reached."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: links among the distinct longs of ``fps(fp)`` that span the
    components of all pairs within ``radius`` bits."""
    n = fps.count()
    shards = int(min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS))))
    sample = [r["fp"] for r in hashed_share(fps, SAMPLE_ROWS, "fp").collect()] if shards > 1 else []
    root = tree(np.sort(np.array(sample, np.int64).view(np.uint64)), shards)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        out: list = []
        route(root, x, np.arange(len(x)), radius, out)
        shard = np.concatenate([np.full(len(r), s, np.int32) for s, r in out] or [np.empty(0, np.int32)])
        rows = np.concatenate([r for _, r in out] or [np.empty(0, int)])
        return pa.record_batch([pa.array(shard), pa.array(x[rows].view(np.int64))], names=["shard", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        x = np.unique(group.column("fp").to_numpy().view(np.uint64))
        i, j = near_pairs(x, radius)
        return pa.table({"u": x[i].view(np.int64), "v": x[j].view(np.int64)})

    return (map_batches(fps.select("fp"), deal, "shard int, fp bigint")
            .groupBy("shard").applyInArrow(compare, "u bigint, v bigint"))


def members(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` of every row; root is a fingerprint
    that names the component, also one without any id."""
    fp = cut_lineage(fingerprints(docs, size), "fingerprints")
    first = cut_lineage(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(first.select("fp"), radius), "fingerprint-links")
    grouped = first.join(roots, first["fp"] == roots["id"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "root", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    return members(docs, size, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row (all columns) of each component: that with the smallest id, a
    row without an id only where no other is; of equal ids the one with the
    smallest fingerprint, of equal fingerprints any one. An id that several
    rows share, or none, says nothing about a row's text, so such rows are
    decided by id and fingerprint; normally there are none."""
    groups = cut_lineage(members(docs, size, radius), "near-duplicates")
    key = F.col("doc_id").cast("bigint")
    name, root, first, other = (free_name(docs, c) for c in ("fp", "root", "first", "other_id"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    twice = cut_lineage(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
                        .select(F.col("doc_id").alias(other)), "repeated-ids")
    kept = docs.where(key.isNotNull()).join(gone, key == F.col(other), "left_anti")
    if not twice.limit(1).count() and not groups.where("doc_id is null").limit(1).count():
        return kept
    kept = kept.join(twice, key == F.col(other), "left_anti")
    odd = docs.where(key.isNull()).union(docs.join(twice, key == F.col(other), "left_semi"))

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, size) for t in texts_of(batch)], np.uint64).view(np.int64)
        return batch.append_column(name, pa.array(fp))
    odd = map_batches(odd, add, StructType([*docs.schema.fields, StructField(name, LongType())]))
    firsts = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias(first))
    firsts = firsts.select(F.col("root").alias(root), F.col(first))
    chosen = odd.join(firsts, key.eqNullSafe(F.col(f"{first}.doc_id")) & (F.col(name) == F.col(f"{first}.fp")))
    return kept.union(chosen.dropDuplicates([root]).select(*docs.columns))
