"""Packing of documents into fixed-length sequences by length patterns.

Documents become token ids; longer ones are cut. Only the histogram of the
piece lengths (at most ``SIZE`` numbers) reaches the driver, where the plan is
made: patterns of two or three lengths that fill a sequence exactly are
enumerated, non-negative least squares fits how often each should be used, the
counts are rounded, and the lengths that are left are packed by best fit on
the histogram. The plan is a list of runs "ranks a to b of length l go to
sequences s, s+1, ... at offset o"; its size depends on ``SIZE``, not on the
data. Each piece then finds its place by its rank within its length, from
counts by (length, salt), so no length is ever ranked in one task.

Defined cases: a null text counts as empty and is the end token alone;
repeated rows are packed a row each; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

SIZE = 2048
END = 0
SALTS = 256
#: Words whose ids a worker keeps at most.
CACHE = 700_000
#: Patterns enumerated a length at most, and steps of the fit.
PARTNERS = 24
ROUNDS = 120
#: Shares of the fitted counts that are tried; a lower one leaves best fit more small pieces to close gaps with.
SHARES = (1.0, 0.6)


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves,
    the others for the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the same as
    ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Words repeat far more often than they are new, so each is encoded once
    and kept; the dict itself is that store. A text of ASCII and Latin-1
    letters, digits and ASCII punctuation is split here as the tokenizer's own
    rules say (runs of letters, single digits, runs of other signs) and its
    words, as Latin-1 bytes, go straight to the merge model. In any other text
    the runs between ASCII white space, as strings, go through the whole
    tokenizer."""
    _letters = [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
    _plain = bytes([*range(9, 14), *range(0x20, 0x27), *range(0x28, 0x7F), *_letters])
    _lower = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
    _parts = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, json: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_str(json)
        self.model = self.tok.model
        self.letters = byte_letters()

    def __missing__(self, part: str | bytes) -> bytes:
        if isinstance(part, str):
            ids = self.tok.encode(part, add_special_tokens=False).ids
        else:
            word = part.decode("latin-1")
            if not part.isascii():
                word = "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.model.tokenize(word)]
        got = array("I", ids).tobytes()
        if len(part) <= 64:                                  # a longer one hardly comes back
            self[part] = got
        return got

    def __call__(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or raw.translate(None, self._plain) or b"<|" in raw:
            return b"".join([self[b.decode()] for b in text.encode().split()])
        return b"".join(map(self.__getitem__, self._parts.findall(raw.translate(self._lower))))


_ENCODERS: dict[int, Encoder] = {}


def encoder(json: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = zlib.crc32(json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json)
    return _ENCODERS[key]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Rows of ``PIECES``; map-only. The vocabulary is read on the driver and
    broadcast (a few MB, whatever the input)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json.value)
        end = np.array([END], "<u4").tobytes()
        n = 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = enc(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    for c, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), n % SALTS), strict=True):
                        c.append(v)
                    n += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All pairs of present lengths that sum to ``size``, and triples: for each
    length up to ``PARTNERS`` evenly spread ones. Rows of three descending
    lengths (zero: none). What they leave out, best fit packs."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    a = present[(present < size) & (2 * present >= size)]
    pairs = np.stack([a, size - a, np.zeros_like(a)], 1)[has[size - a]] if len(a) else np.empty((0, 3), int)
    out = [pairs]
    for x in present[present < size]:
        rest = size - x
        y = present[(present <= x) & (present < rest) & (2 * present >= rest)]
        z = rest - y
        y, z = y[has[z]], z[has[z]]
        if len(y) > PARTNERS:
            at = np.linspace(0, len(y) - 1, PARTNERS).astype(int)
            y, z = y[at], z[at]
        out.append(np.stack([np.full_like(y, x), y, z], 1))
    return np.concatenate(out)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2 (A: how often a
    length occurs in a pattern), by accelerated projected gradient steps."""
    n, size = len(rows), len(counts)
    use = rows > 0

    def times(x):
        return np.bincount(rows[use], np.repeat(x, use.sum(1)), size)

    def back(r):
        return np.where(use, r[rows], 0.0).sum(1)

    v = np.random.default_rng(0).random(n)
    for _ in range(12):                                      # largest eigenvalue of A'A, for the step
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(times(y) - counts) / (1.05 * norm))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        if np.dot(y - new, new - x) < 0:
            y, t2 = new, 1.0
        x, t = new, t2
    return x


class Plan:
    """Runs ``(length, first rank, ranks, a sequence's share, first sequence,
    offset)``, sorted for look-up by (length, rank)."""

    def __init__(self, counts: np.ndarray, size: int = SIZE):
        self.size, self.counts = size, counts.astype(np.int64)
        rows = patterns(np.flatnonzero(self.counts[:size]), size)
        x = fit(rows, np.where(np.arange(size + 1) < size, self.counts, 0).astype(float)) if len(rows) else np.zeros(0)
        best = None
        for share in SHARES:
            self._pack(rows, share * x)
            if best is None or self.sequences < best[0]:
                best = (self.sequences, self.runs)
        self.sequences = best[0]
        runs = np.array(sorted(best[1]), np.int64).reshape(-1, 6)
        self.key = (runs[:, 0] << 48) | runs[:, 1]
        self.share, self.seq, self.offset, self.first = runs[:, 3], runs[:, 4], runs[:, 5], runs[:, 1]

    def _pack(self, rows: np.ndarray, x: np.ndarray) -> None:
        self.left = self.counts.copy()                       # by length, 0 to size
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._put([(self.size, 1)], int(self.left[self.size]))
        self._fitted(rows, x)
        self._best_fit()

    def _put(self, items: list[tuple[int, int]], repeats: int) -> None:
        """``repeats`` sequences, each with these (length, how many)."""
        if repeats <= 0:
            return
        at = 0
        for length, k in items:
            self.runs.append((length, int(self.used[length]), repeats * k, k, self.sequences, at))
            self.used[length] += repeats * k
            self.left[length] -= repeats * k
            at += length * k
        self.sequences += repeats

    def _fitted(self, rows: np.ndarray, x: np.ndarray) -> None:
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i] + 0.5)
            if want <= 0:
                break
            items = [(int(v), int(c)) for v, c in zip(*np.unique(rows[i][rows[i] > 0], return_counts=True), strict=True)][::-1]
            self._put(items, min(want, *(int(self.left[v]) // c for v, c in items)))

    def _best_fit(self) -> None:
        """The largest length left opens a sequence; the one or two lengths
        that fill it best follow until nothing fits. The same sequence is
        repeated as often as the counts allow."""
        while len(have := np.flatnonzero(self.left)):
            left = self.left.copy()
            top = int(have[-1])
            items: dict[int, int] = {top: 1}
            left[top] -= 1
            room = self.size - top
            while room > 0:
                have = np.flatnonzero(left[:room + 1])
                if not len(have):
                    break
                one = int(have[-1])
                pick = [one]
                if one < room:
                    low = np.searchsorted(have, room - have, "right") - 1     # largest second length
                    ok = low >= 0
                    second = have[np.maximum(low, 0)]
                    same = ok & (second == have) & (left[have] < 2)
                    ok &= ~same | (low > 0)
                    second = np.where(same, have[np.maximum(low - 1, 0)], second)
                    total = np.where(ok, have + second, 0)
                    best = int(np.flatnonzero(total == total.max())[-1])
                    if total[best] > one:
                        pick = [int(have[best]), int(second[best])]
                for v in pick:
                    items[v] = items.get(v, 0) + 1
                    left[v] -= 1
                    room -= v
            listed = sorted(items.items(), reverse=True)
            self._put(listed, min(int(self.left[v]) // c for v, c in listed))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces at ``rank`` within ``length``."""
        i = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        t = rank - self.first[i]
        return self.seq[i] + t // self.share[i], self.offset[i] + t % self.share[i] * length


RESULT = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Rows of ``RESULT``, one a piece. The pieces (without ids) are written
    once; the histogram, the ranks and the result read them back."""
    p = cut_lineage(pieces(docs, tokenizer_path, size), "pieces")
    by_salt = cut_lineage(p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect():   # at most `size` rows
        counts[r["length"]] = r["n"]
    plan = Plan(counts, size)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = (p.withColumn("at", F.row_number().over(own))
              .join(start, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("before") + F.col("at") - 1).alias("rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(run, RESULT)
