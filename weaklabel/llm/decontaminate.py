"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of distinct word shingles into
powers of two. For each partition, with sizes up to ``u``, a document is seen
as overlapping windows of ``2 u`` shingles, so a short item is never compared
with a whole long document: an item inside a window has a Jaccard similarity
with it of 1/4 to 1/2, whatever the document's length. Items and windows get
``HASHES`` min-hashes; an item and a document are candidates when one of the
item's min-hashes is a window's. At similarity 0.25, 48 hashes miss with
probability 1e-6. Every candidate is verified by the exact share of the item's
shingles that the document holds, over the whole document.

The benchmark is a stated set: it is read in blocks of ``BLOCK_ITEMS`` items,
each block is an index of bounded size that goes to every task, and documents
are scanned where they lie, without a shuffle.

An item with fewer words than a shingle is one shingle of all its words. Such
items are sought as runs of their own length, by the hash of every run of
that length, and verified word by word.

Defined cases: null texts count as empty; items without words match nothing;
repeated rows are matched a row each; empty tables give no rows; extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

SHINGLE = 5
CONTAINED = 0.8
HASHES = 48
BLOCK_ITEMS = 20_000
#: Shingles that are min-hashed at a time; windows overlap across the seam.
PART = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One hash a shingle, from the words' hashes."""
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter((h(x) for x in words), np.uint64, len(words))
    n = len(w) - size + 1
    if not len(w):
        return w
    k, n = (size, n) if n > 0 else (len(w), 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ w[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def factors(n: int) -> np.ndarray:
    """Odd multipliers of the min-hash functions, from a fixed seed."""
    return np.random.default_rng(12).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Index:
    """One block of the benchmark: by size partition the sorted min-hash keys
    and their items, each item's shingles, and the items shorter than one."""
    sizes: list[int]
    keys: list[np.ndarray]
    items: list[np.ndarray]
    ids: list
    sets: list[frozenset]
    short: dict[int, dict[int, list[int]]]                   # words -> hash of the run -> items


def minhash_keys(low: np.ndarray) -> np.ndarray:
    """Keys of min-hash values: row j is made distinct from the others."""
    return low ^ (np.arange(len(low), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]


def build(rows: list[tuple[int, str | None]], size: int = SHINGLE) -> Index:
    by: dict[int, list[tuple[np.ndarray, int]]] = {}
    ids, sets = [], []
    short: dict[int, dict[int, list[int]]] = {}
    mul = factors(HASHES)
    for item, text in rows:
        words = words_of(text)
        if not words:
            continue
        sets.append(frozenset(shingles_of(words, size)))
        ids.append(item)
        h = shingle_hashes(words, size)
        if len(words) < size:
            short.setdefault(len(words), {}).setdefault(int(h[0]), []).append(len(ids) - 1)
            continue
        low = (h[None, :] * mul[:, None]).min(1)
        u = 4
        while u < len(h):
            u *= 2
        by.setdefault(u, []).append((minhash_keys(low[:, None])[:, 0], len(ids) - 1))
    sizes = sorted(by)
    keys, items = [], []
    for u in sizes:
        k = np.concatenate([x for x, _ in by[u]])
        i = np.repeat([n for _, n in by[u]], HASHES)
        order = np.argsort(k, kind="stable")
        keys.append(k[order])
        items.append(i[order])
    return Index(sizes, keys, items, ids, sets, short)


class Matcher:
    """Finds the items of an index in texts."""

    def __init__(self, index: Index, size: int, threshold: float):
        self.index, self.size, self.threshold = index, size, threshold
        self.mul = factors(HASHES)
        # Words of each item's shingles.
        self.words = [min(size, min(x.count(b" ") + 1 for x in s)) for s in index.sets]
        self.seen = []                                       # by partition: bitmap over the keys' low bits
        for keys in index.keys:
            bits = np.zeros(1 << max(12, len(keys).bit_length() + 5), bool)
            bits[keys & np.uint64(len(bits) - 1)] = True
            self.seen.append(bits)

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs that share a min-hash. The documents' shingle
        hashes are read as one stream; a window over a seam belongs to both."""
        found: set[tuple[int, int]] = set()
        if not self.index.sizes or not docs:
            return found
        h = np.concatenate(docs)
        ends = np.cumsum([len(d) for d in docs])
        top = self.index.sizes[-1]
        step = max(PART, 8 * top)
        for at in range(0, len(h), step):
            begin = max(0, at - 2 * top)                     # multiples of every block size
            for first, last, item in self._windows(h[begin:at + step]):
                lo = int(np.searchsorted(ends, begin + first, "right"))
                hi = int(np.searchsorted(ends, min(begin + last, len(h)) - 1, "right"))
                found.update((d, item) for d in range(lo, hi + 1))
        return found

    def _windows(self, part: np.ndarray):
        """(first shingle, end, item) of the windows that share a min-hash."""
        base = width = self.index.sizes[0]
        starts = np.arange(0, len(part), base)
        low = np.empty((len(self.mul), len(starts)), np.uint64)
        scratch = np.empty_like(part)
        for j, m in enumerate(self.mul):
            np.minimum.reduceat(np.multiply(part, m, out=scratch), starts, out=low[j])
        for u, keys, items, seen in zip(self.index.sizes, self.index.keys, self.index.items, self.seen, strict=True):
            while width < u:                                 # blocks of u from pairs of half the size
                if low.shape[1] % 2:
                    low = np.concatenate([low, low[:, -1:]], 1)
                low = np.minimum(low[:, ::2], low[:, 1::2])
                width *= 2
            window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
            k = minhash_keys(window)
            row, at = np.nonzero(seen[k & np.uint64(len(seen) - 1)])
            if len(at):
                k = k[row, at]
                left, right = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                for w, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                    for i in items[x:y].tolist():
                        yield w * width, (w + 2) * width, i

    def runs(self, words: list[list[bytes]]) -> set[tuple[int, int]]:
        """(document, item) pairs of the items shorter than a shingle whose
        hash is that of a run of the document's words."""
        found: set[tuple[int, int]] = set()
        for n, items in self.index.short.items():
            keys = np.sort(np.array(list(items), np.uint64))
            for d, w in enumerate(words):
                if len(w) < n:
                    continue
                h = np.unique(shingle_hashes(w, n))
                hit = h[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h]
                found.update((d, i) for k in hit.tolist() for i in items[k])
        return found

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(item_id, shared, shingles)``, by item."""
        words = [words_of(t) for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        own: dict[tuple[int, int], set] = {}
        pairs = self.candidates([shingle_hashes(w, self.size) if len(w) >= self.size else np.empty(0, np.uint64) for w in words])
        for d, i in sorted(pairs | self.runs(words)):
            n = self.words[i]
            if (d, n) not in own:
                own = {k: v for k, v in own.items() if k[0] == d} | {(d, n): set(shingles_of(words[d], n))}
            shared = len(self.index.sets[i] & own[d, n])
            if shared >= self.threshold * len(self.index.sets[i]):
                out[d].append((self.index.ids[i], shared, len(self.index.sets[i])))
        return out

    def batches(self, texts: list[str | None]):
        """``self`` over runs of texts of bounded size."""
        run: list = []
        size = 0
        for t in texts:
            run.append(t)
            size += len(t or "")
            if size > 4 << 20:
                yield from self(run)
                run, size = [], 0
        yield from self(run)


def matcher_of(index, size: int, threshold: float):
    """A function that gives the matcher of a broadcast index, made once a task."""
    made: list[Matcher] = []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(index.value, size, threshold))
        return made[0]
    return get


def blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS):
    """The benchmark's items in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    n = rows.count()
    parts = max(1, -(-n // block_items))
    if parts == 1:
        yield [(r["item_id"], r["text"]) for r in rows.collect()]
        return
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        yield [(r["item_id"], r["text"]) for r in rows.where(at == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, threshold: float = CONTAINED,
                 block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)``: every pair of
    a document and an item with that share of the item's shingles in it."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    schema = "doc_id bigint, item_id bigint, n_shared bigint, n_shingles bigint, containment double"
    out = None
    for rows in blocks(benchmark, block_items):
        index = docs.sparkSession.sparkContext.broadcast(build(rows, size))
        matcher = matcher_of(index, size, threshold)

        def run(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            matches = matcher().batches(texts_of(batch))
            got = [(d, *m) for d, found in zip(batch.column("doc_id").to_pylist(), matches, strict=True) for m in found]
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            share = pa.array([s / n for s, n in zip(cols[2], cols[3], strict=True)], pa.float64())
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), share],
                                   names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])
        part = map_batches(docs, run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, threshold: float = CONTAINED,
                      block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item; map-only."""
    for rows in blocks(benchmark, block_items):
        index = docs.sparkSession.sparkContext.broadcast(build(rows, size))
        matcher = matcher_of(index, size, threshold)

        def run(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            matches = matcher().batches(texts_of(batch))
            return batch.filter(pa.array([not found for found in matches], pa.bool_()))
        docs = map_batches(docs, run, docs.schema)
    return docs
