"""Substring deduplication through fixed-block anchors.

A repeat of ``WINDOW`` words covers at least one whole block of ``BLOCK``
words at a position that is a multiple of ``BLOCK`` in the document it is
compared with, because 2 * BLOCK - 1 <= WINDOW. So the non-overlapping blocks
of every document are the index, and every rolling window of ``BLOCK`` words
of every document probes it:

1. Documents are dealt into chunks by id. A chunk sends each distinct hash of
   its rolling windows once to the hash's bucket, with two bits: "is an
   aligned block somewhere" and "in several documents".
2. A bucket answers each chunk with its hashes that are a block somewhere and
   occur in more than one document: the hits.
3. The chunk extends its hits to the ``WINDOW``-word windows around them and
   sends each distinct window (a 95-bit hash) with the smallest document id
   that holds it to the hash's bucket, which answers with the windows that a
   smaller id elsewhere holds and those that several ids of the chunk hold.
4. The chunk removes every word of a window that a smaller document also
   holds. Adjacent windows add up to the maximal repeat.

What crosses the network are hashes, at most one for a chunk however often a
passage occurs in it, so a passage in a third of all documents costs one entry
for each chunk. The chunks' texts are shuffled once; that exchange is reused
by the three steps.

Defined cases: a null text has no words; a null doc_id is treated as larger
than any other and removes nothing elsewhere; rows with the same doc_id are
one document's texts and are no reason to remove from each other; a repeat
inside one document stays; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK = 7
#: Bytes of text a chunk holds, at least and at most; a bucket gets as many words' hashes.
CHUNK_BYTES = (2 << 20, 64 << 20)
#: A null id stands after all others.
LAST = np.iinfo(np.int64).max
ONE = np.uint32(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(w: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` words, from the words' hashes."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(salt * 2 + 1))
    for k in range(size):
        h = mix(h + w[k:k + n])
    return h


def hashed(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in words), np.uint64, len(words))


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def payload(h: np.ndarray) -> np.ndarray:
    """The low 30 bits, in the upper bits of a 32-bit entry. With the bucket
    they are a filter: a chance hit costs an extension, never a removal."""
    return (h.astype(np.uint32) << np.uint32(2))


def chunk_hashes(table: pa.Table, buckets: int):
    """Distinct (bucket, entry) of a chunk, sorted; entry bit 0: a block, bit
    1: in several documents."""
    parts, ids, blocks = [], [], []
    for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
        h = rolling(hashed(words_of(t)), BLOCK)
        if len(h):
            parts.append(h)
            ids.append(np.full(len(h), LAST if d is None else d, np.int64))
            blocks.append(np.arange(len(h)) % BLOCK == 0)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h, d, b = np.concatenate(parts), np.concatenate(ids), np.concatenate(blocks)
    key = (buckets_of(h, buckets).astype(np.uint64) << np.uint64(32)) | payload(h)
    order = np.argsort(key, kind="stable")
    key, d, b = key[order], d[order], b[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
    block = np.logical_or.reduceat(b, start)
    key = key[start]
    entry = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32) | block.astype(np.uint32) | (many.astype(np.uint32) << np.uint32(1))
    return (key >> np.uint64(32)).astype(np.int64), entry


def probes(table: pa.Table, buckets: int) -> pa.Table:
    bucket, entry = chunk_hashes(table, buckets)
    return packed(bucket, table.column("chunk")[0].as_py(), [entry])


def answer(table: pa.Table) -> pa.Table:
    """The hits of each chunk that sent entries to this bucket."""
    blobs = table.column("entries").to_pylist()
    sizes = np.array([len(b) // 4 for b in blobs])
    entry = np.frombuffer(b"".join(blobs), np.uint32)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    order = np.argsort(entry & np.uint32(0xFFFFFFFC), kind="stable")
    entry, owner = entry[order], owner[order]
    key = entry >> np.uint32(2)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    hot = (np.bitwise_or.reduceat(entry & np.uint32(1), start) > 0) & (
        (size > 1) | (np.bitwise_or.reduceat(entry & np.uint32(2), start) > 0))
    keep = np.repeat(hot, size)
    key, owner = key[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    key, owner = key[order], owner[order]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
    ends = np.r_[start[1:], len(owner)] if len(owner) else start
    chunk = table.column("chunk").to_numpy()
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"chunk": pa.array(chunk[owner[start]] if len(start) else np.empty(0, np.int64)),
                     "bucket": pa.array([bucket] * len(start), pa.int64()),
                     "hits": pa.array([key[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())})


def hit_windows(words: np.ndarray, hits: np.ndarray, buckets: int) -> np.ndarray:
    """Starts of the windows around at least one hit."""
    n = len(words) - WINDOW + 1
    if n <= 0 or not len(hits):
        return np.empty(0, np.int64)
    h = rolling(words, BLOCK)
    key = (buckets_of(h, buckets).astype(np.uint64) << np.uint64(32)) | (payload(h) >> np.uint32(2))
    at = np.minimum(np.searchsorted(hits, key), len(hits) - 1)
    hit = np.r_[0, np.cumsum(hits[at] == key)]
    return np.flatnonzero(hit[WINDOW - BLOCK + 1:][:n] > hit[:n])


def packed(bucket: np.ndarray, chunk: int, columns: list[np.ndarray]) -> pa.Table:
    """One row a bucket: the entries' columns one after the other, as bytes.
    The entries come sorted by bucket."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    ends = np.r_[start[1:], len(bucket)] if len(bucket) else start
    blobs = [b"".join([c[a:b].tobytes() for c in columns]) for a, b in zip(start, ends, strict=True)]
    return pa.table({"bucket": pa.array(bucket[start]), "chunk": pa.array([chunk] * len(start), pa.int64()),
                     "n": pa.array(ends - start), "entries": pa.array(blobs, pa.binary())})


def extended(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Each distinct window around a hit, as (64 bits, 31 bits and whether
    several ids of this chunk hold it, the smallest of these ids)."""
    none = packed(np.empty(0, np.int64), 0, [])
    if not docs.num_rows or not answers.num_rows:
        return none
    hits = np.sort(np.concatenate([
        (np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64)
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("hits").to_pylist(), strict=True)]))
    h1, h2, ids = [], [], []
    for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        w = hashed(words_of(t))
        s = hit_windows(w, hits, buckets)
        if len(s):
            h1.append(rolling(w, WINDOW, 1)[s])
            h2.append((rolling(w, WINDOW, 2)[s] >> np.uint64(32)).astype(np.uint32) & ~ONE)
            ids.append(np.full(len(s), LAST if d is None else d, np.int64))
    if not h1:
        return none
    a, b, d = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    order = np.lexsort((d, b, a))                            # by the first hash, so by bucket too
    a, b, d = a[order], b[order], d[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    more = d[start] != d[np.r_[start[1:], len(a)] - 1]
    a, b, d = a[start], b[start] | more.astype(np.uint32), d[start]
    return packed(buckets_of(a, buckets), docs.column("chunk")[0].as_py(), [a, b, d])


def settle(table: pa.Table) -> pa.Table:
    """To each chunk the first hashes of its windows that lose words: last bit
    0 if a smaller id elsewhere holds the window, so that every one of the
    chunk's does; 1 if the chunk holds the smallest id, which keeps it."""
    size = table.column("n").to_numpy()
    blobs = table.column("entries").to_pylist()
    a = np.frombuffer(b"".join([x[:8 * n] for x, n in zip(blobs, size, strict=True)]), np.uint64)
    b = np.frombuffer(b"".join([x[8 * n:12 * n] for x, n in zip(blobs, size, strict=True)]), np.uint32)
    low = np.frombuffer(b"".join([x[12 * n:] for x, n in zip(blobs, size, strict=True)]), np.int64)
    owner = np.repeat(np.arange(len(blobs)), size)
    order = np.lexsort((b >> ONE, a))
    a, b, low, owner = a[order], b[order], low[order], owner[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | ((b[1:] ^ b[:-1]) > ONE)])
    least = np.repeat(np.minimum.reduceat(low, start), np.diff(np.r_[start, len(a)]))
    here = least == low
    keep = ~here | ((b & ONE) > 0)
    reply = (a & ~np.uint64(1) | here.astype(np.uint64))[keep]
    owner = owner[keep]
    order = np.argsort(owner, kind="stable")
    return packed_by_owner(reply[order], owner[order], table.column("chunk").to_numpy())


def packed_by_owner(values: np.ndarray, owner: np.ndarray, chunk: np.ndarray) -> pa.Table:
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
    ends = np.r_[start[1:], len(owner)] if len(owner) else start
    return pa.table({"chunk": pa.array(chunk[owner[start]] if len(start) else np.empty(0, np.int64)),
                     "repeats": pa.array([values[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())})


def repeated(words: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows among the sorted ``repeats``, and which they are."""
    if len(words) < WINDOW or not len(repeats):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = rolling(words, WINDOW, 1) & ~np.uint64(1)
    at = np.minimum(np.searchsorted(repeats, h), len(repeats) - 1)   # the hash itself or, for bit 1, right after it
    s = np.flatnonzero(repeats[at] & ~np.uint64(1) == h)
    return s, at[s]


ENTRIES = "bucket bigint, chunk bigint, n bigint, entries binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def cleaned(docs: pa.Table, replies: pa.Table, with_text: bool) -> pa.Table:
    repeats = np.sort(np.frombuffer(b"".join(replies.column("repeats").to_pylist()), np.uint64))
    ids = [LAST if d is None else d for d in docs.column("doc_id").to_pylist()]
    texts = [words_of(t) for t in docs.column("text").to_pylist()]
    found = [repeated(hashed(w) if len(repeats) else np.empty(0, np.uint64), repeats) for w in texts]
    least = np.full(len(repeats), -1, np.int64)              # no id keeps the window here ...
    own = (repeats & np.uint64(1)) > 0
    least[own] = LAST
    for d, (_, which) in zip(ids, found, strict=True):       # ... or the smallest that holds it
        which = which[own[which]]
        least[which] = np.minimum(least[which], d)
    rows: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    for raw, d, words, (s, which) in zip(docs.column("doc_id").to_pylist(), ids, texts, found, strict=True):
        s = s[~own[which] | (least[which] != d)]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n = int(gone.sum())
        kept = b" ".join(words if not n else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        for k, v in zip(rows, (raw, len(words), n, hashlib.sha256(kept).hexdigest(),
                               kept.decode("utf-8", "surrogatepass") if with_text else None), strict=True):
            rows[k].append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)})


def deduplicate(docs: DataFrame, with_text: bool = False, chunk_bytes: tuple[int, int] = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` of every row; kept,
    the text that is left, only ``with_text``.

    One pass first sums the bytes of the texts, to set the number of chunks
    and buckets; they never change a result."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = buckets = max(4, -(-total // min(chunk_bytes[1], max(chunk_bytes[0], total // 512))))
    # Ids are dealt by hash; rows without one, which may be many, by their text.
    at = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks))
    dealt = docs.withColumn("chunk", at)

    def send(t: pa.Table) -> pa.Table:
        return probes(t, buckets)

    def extend(key, d: pa.Table, a: pa.Table) -> pa.Table:
        return extended(d, a, buckets)

    def clean(key, d: pa.Table, r: pa.Table) -> pa.Table:
        return cleaned(d, r, with_text)

    sent = dealt.groupBy("chunk").applyInArrow(send, ENTRIES)
    hits = sent.groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket bigint, hits binary")
    windows = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, ENTRIES)
    repeats = windows.groupBy("bucket").applyInArrow(settle, "chunk bigint, repeats binary")
    return dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(clean, RESULT)
