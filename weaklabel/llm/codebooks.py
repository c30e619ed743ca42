"""Vector code compression: codebooks by k-means with norm-of-sum bounds.

A vector of integers is cut into ``PARTS`` equal parts, and each part position
has a codebook. A round assigns every part to its nearest entry and moves each
entry to the mean of its parts.

Between rounds a part keeps its entry, the squared distance to it (upper
bound), that of the second nearest entry (lower bound), and for each bound the
round of the codebook it was measured against. All codebooks so far are kept,
so a bound measured in round t is corrected by the true displacement of an
entry between the codebooks of round t and now, the norm of the summed moves,
which is never more than the sum of the moves' norms. Only a part whose
corrected bounds meet is measured against its own entry, and only if that
distance meets the lower bound too against all entries. Distances are exact
integers; bounds are compared with room for rounding, so codes equal those of
a full search.

Vectors and bounds are a table in the checkpoint folder between rounds; a
task sums the parts of each entry before anything is shuffled, and only these
sums (a row for each component and entry) and codebooks reach the driver.

Defined cases: rows whose vector is null or holds null or non-finite
components are dropped; vectors of each length have codebooks of their own; a
length that 16 does not divide is filled up with zeros (an empty vector has 16
empty parts, code 0 and error 0); equal or null ids are ordered by id, null
last, then components; components beyond 2 ** 27 in size are cut to it; a null
label is a label; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches

# Fixed values of the contract.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest component, and largest for which double precision holds all distances exactly.
MOST, FAST = 1 << 27, 1 << 20
#: Rows measured at a time.
BLOCK = 1_024
FAR = np.iinfo(np.int64).max

KEPT = "vec_id bigint, label string, dim int, x binary"
BOUNDS = "code binary, upper binary, lower binary, upper_round binary, lower_round binary"

#: Codebooks by vector length: the history, each of shape (parts, entries, part width).
History = dict[int, list[np.ndarray]]


def quantised(vectors: DataFrame) -> DataFrame:
    """``KEPT`` of the usable rows: x holds the components as 32-bit integers."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, xs = [], []
        for v in batch.column("embedding").to_pylist():
            x = None if v is None or None in v else np.array(v, np.float64)
            if x is None or not np.isfinite(x).all():
                dims.append(None), xs.append(None)
                continue
            with np.errstate(over="ignore"):
                y = np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int32)
            y = np.concatenate([y, np.zeros(-len(y) % PARTS, np.int32)])
            dims.append(len(y)), xs.append(y.tobytes())
        out = pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()),
                               pa.array(xs, pa.binary())], names=["vec_id", "label", "dim", "x"])
        return out.filter(out.column("dim").is_valid())
    v = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(v, run, KEPT)


def first_codebooks(kept: DataFrame, entries: int) -> History:
    """The parts of each length's smallest ids."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "x"))
    rows = kept.select("dim", "vec_id", "x").withColumn("place", place).where(F.col("place") <= entries).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by.setdefault(r["dim"], []).append(np.frombuffer(r["x"], np.int32).astype(np.int64))
    return {d: [np.stack(v).reshape(len(v), PARTS, d // PARTS).swapaxes(0, 1)] for d, v in by.items()}


def all_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of one position's parts, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= FAST and x.shape[1] <= 1 << 9:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return d.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in book], 1)


def displaced(history: list[np.ndarray]) -> np.ndarray:
    """(round, part, entry): how far each entry now is from where it was then."""
    now = history[-1]
    return np.stack([np.sqrt(((now - then).astype(np.float64) ** 2).sum(2)) for then in history])


class Assigner:
    """Assigns the parts of vectors of one length to the newest codebook."""

    def __init__(self, history: list[np.ndarray]):
        self.history, self.book, self.now = history, history[-1], len(history) - 1
        self.moved = displaced(history)
        top = np.argsort(-self.moved, axis=2, kind="stable")
        n = self.moved.shape[2]
        first = np.take_along_axis(self.moved, top[:, :, :1], 2)[:, :, 0]
        second = np.take_along_axis(self.moved, top[:, :, 1:2], 2)[:, :, 0] if n > 1 else np.zeros_like(first)
        # Largest displacement of any entry but the given one.
        self.others = np.where(np.arange(n) == top[:, :, :1], second[:, :, None], first[:, :, None])
        self.scanned = self.seen = 0

    def scan(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (ties: lower index), its distance and the second nearest's."""
        d = all_distances(x, self.book[p])
        code = d.argmin(1)
        rows = np.arange(len(x))
        best = d[rows, code]
        d[rows, code] = FAR
        return code, best, d.min(1)

    def __call__(self, x: np.ndarray, state: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        """The new state of vectors ``x`` (rows, parts, width): for each part
        code, bounds and the rounds of the bounds."""
        n = len(x)
        self.seen += n * PARTS
        if state is None:
            state = {"code": np.zeros((n, PARTS), np.uint8), "upper": np.zeros((n, PARTS), np.int64),
                     "lower": np.zeros((n, PARTS), np.int64), "upper_round": np.zeros((n, PARTS), np.uint8),
                     "lower_round": np.zeros((n, PARTS), np.uint8)}
            fresh = True
        else:
            state = {k: v.copy() for k, v in state.items()}
            fresh = False
        for p in range(PARTS):
            code, upper, lower = state["code"][:, p], state["upper"][:, p], state["lower"][:, p]
            rows = np.arange(n)
            if not fresh:
                u = np.sqrt(upper.astype(np.float64)) + self.moved[state["upper_round"][:, p], p, code]
                low = np.where(lower == FAR, np.inf, np.sqrt(lower.astype(np.float64)) - self.others[state["lower_round"][:, p], p, code])
                low -= 1e-9 * (1 + np.abs(low))
                rows = np.flatnonzero(~(u * (1 + 1e-9) < low))
                own = ((x[rows, p] - self.book[p][code[rows]]) ** 2).sum(1)
                upper[rows], state["upper_round"][rows, p] = own, self.now
                rows = rows[~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) < low[rows])]
            for a in range(0, len(rows), BLOCK):
                r = rows[a:a + BLOCK]
                code[r], upper[r], lower[r] = self.scan(x[r, p], p)
            state["upper_round"][rows, p] = state["lower_round"][rows, p] = self.now
            self.scanned += len(rows)
        return state

    def error(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over the parts."""
        own = self.book[np.arange(PARTS), code.astype(np.int64)]
        return ((x - own) ** 2).sum((1, 2))


TYPES = {"code": np.uint8, "upper": np.int64, "lower": np.int64, "upper_round": np.uint8, "lower_round": np.uint8}


def by_length(batch: pa.RecordBatch):
    """``(length, row numbers, parts)`` of a batch, a length at a time."""
    dims = batch.column("dim").to_numpy()
    xs = batch.column("x")
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        raw = b"".join(xs.take(pa.array(rows)).to_pylist())
        yield d, rows, np.frombuffer(raw, np.int32).reshape(len(rows), PARTS, d // PARTS).astype(np.int64)


def states(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, np.ndarray] | None:
    if "code" not in batch.schema.names:
        return None
    return {k: np.frombuffer(b"".join(batch.column(k).take(pa.array(rows)).to_pylist()), t).reshape(len(rows), PARTS)
            for k, t in TYPES.items()}


def assign(kept: DataFrame, history: History) -> DataFrame:
    """``kept`` with its parts' codes and bounds against the newest codebooks;
    bounds of earlier rounds, where it has them, spare most of the work."""
    shared = kept.sparkSession.sparkContext.broadcast(history)   # a few codebooks of at most 64 entries each

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [None] * batch.num_rows for k in TYPES}
        for d, rows, x in by_length(batch):
            got = Assigner(shared.value[d])(x, states(batch, rows))
            for k, values in got.items():
                for r, v in zip(rows.tolist(), values, strict=True):
                    cols[k][r] = v.tobytes()
        return pa.record_batch([*(batch.column(c) for c in ("vec_id", "label", "dim", "x")),
                                *(pa.array(v, pa.binary()) for v in cols.values())],
                               names=["vec_id", "label", "dim", "x", *cols])
    return map_batches(kept, run, f"{KEPT}, {BOUNDS}")


def moved_codebooks(assigned: DataFrame, history: History) -> History:
    """``history`` with the codebooks of the parts' means; unused entries stay.
    A task adds up its rows, so a partition sends a row for each component and
    entry at most."""
    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, rows, x in by_length(batch):
                code = np.frombuffer(b"".join(batch.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, PARTS)
                if d not in total:
                    total[d] = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, d // PARTS), np.int64)
                for p in range(PARTS):
                    total[d][0][p] += np.bincount(code[:, p], minlength=ENTRIES)
                    np.add.at(total[d][1][p], code[:, p], x[:, p])
        for d, (count, sums) in total.items():
            part, entry = np.nonzero(count)
            yield pa.record_batch([pa.array(np.full(len(part), d, np.int32)), pa.array(part.astype(np.int32)),
                                   pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                                   pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
                                  names=["dim", "part", "entry", "n", "sums"])
    sums = assigned.select("dim", "x", "code").mapInArrow(run, "dim int, part int, entry int, n bigint, sums array<bigint>")
    each = (sums.select("dim", "part", "entry", "n", F.posexplode_outer("sums").alias("k", "total"))
            .groupBy("dim", "part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    out = {d: [*books, books[-1].copy()] for d, books in history.items()}
    for r in each.collect():
        if r["k"] is not None:
            out[r["dim"]][-1][r["part"], r["entry"], r["k"]] = r["total"] // r["n"]
    return out


def codebooks_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, History]:
    """The vectors with the bounds of the last assignment, and all codebooks.
    ``entries`` is at most 64."""
    kept = quantised(vectors)
    history = first_codebooks(kept, min(entries, ENTRIES))
    for k in range(rounds):
        kept = cut_lineage(assign(kept, history), f"codes-{k}")
        history = moved_codebooks(kept, history)
    return kept, history


def encode(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable row."""
    kept, history = fit(vectors, entries, rounds)
    names = {d: codebooks_sha256(books[-1]) for d, books in history.items()}
    shared = kept.sparkSession.sparkContext.broadcast(history)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, error = [""] * batch.num_rows, [0] * batch.num_rows
        digest = [names[d] for d in batch.column("dim").to_pylist()]
        for d, rows, x in by_length(batch):
            now = Assigner(shared.value[d])
            got = now(x, states(batch, rows))["code"]
            for r, c, e in zip(rows.tolist(), got, now.error(x, got).tolist(), strict=True):
                code[r], error[r] = c.tobytes().hex(), e
        return pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64()),
                                pa.array(digest)], names=["vec_id", "label", "code", "error", "codebooks_sha256"])
    coded = cut_lineage(map_batches(kept, run, "vec_id bigint, label string, code string, error bigint, codebooks_sha256 string"), "codes")
    total = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-by-label")
    return (coded.join(total.withColumnRenamed("label", "label_"), F.col("label").eqNullSafe(F.col("label_")))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
