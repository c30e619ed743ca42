"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text that looks like the good samples compresses better with the good
dictionary: the size difference, divided by the sum of both sizes, is the
feature, and a logistic curve makes it a probability. A text is compressed in
pieces of ``SCORED`` bytes and the sizes are added up: a dictionary helps most
at the start of what it compresses, so in this way all of a long text counts
and its difference means the same as a short one's. The curve is fitted on
differences of labelled texts that the dictionaries had not seen: each third
of the sample is measured with dictionaries from the other two.

Defined cases: a null text counts as empty, an empty text gets the score of a
difference of zero, repeated rows get a row each, an empty table gives no
rows, other columns are never read by the score. Without labelled rows of both
classes every score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

#: Bounds of the labelled sample the model is fitted on: rows a class, and characters of each row (a window from any place).
TRAIN_ROWS = 4500
TRAIN_CHARS = 12_000
DICT_BYTES = 112_640
PIECE = 4_000
SCORED = 1_024
FOLDS = 3
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve ``a * difference + b``."""
    good: bytes
    bad: bytes
    a: float
    b: float

    def scorer(self):
        if not self.good:
            return lambda text: 0.5
        diff = difference(self.good, self.bad)
        a, b = self.a, self.b

        def score(text: str) -> float:
            return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a * diff(text) + b))))
        return score


def difference(good: bytes, bad: bytes):
    """(bytes with the bad dictionary - bytes with the good one) / their sum,
    over all pieces of the text."""
    def compressor(raw):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                        write_checksum=False, write_dict_id=False)
    g, b = compressor(good), compressor(bad)

    def diff(text: str) -> float:
        raw = text.encode("utf-8", "surrogatepass")
        x = y = 0
        for i in range(0, max(1, len(raw)), SCORED):
            piece = raw[i:i + SCORED]
            x += len(g.compress(piece))
            y += len(b.compress(piece))
        return (y - x) / (x + y)
    return diff


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the texts themselves when there are too few."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [r[i:i + PIECE] for r in raw for i in range(0, len(r), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICT_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature (Newton, slight ridge)."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    t = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        grad = z.T @ (w * (y - p)) - ridge @ t
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, grad)
        t = t + step
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0] / scale), float(t[1])


def fit(labelled: DataFrame, docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on ``labelled(doc_id, label)`` with the texts of ``docs``.

    The sample is bounded: the ``rows`` ids of each class that come first in
    hash order (chosen on the label table alone), ``chars`` characters of
    each, from a place chosen by hash. Only that sample is collected. The curve is weighted to the
    classes' true sizes."""
    labelled = labelled.where("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(b"", b"", 0.0, 0.0)
    chosen = None
    for y in (0, 1):
        part = labelled.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    text = F.coalesce("text", F.lit(""))
    spare = F.greatest(F.length(text) - chars, F.lit(0))
    start = (F.pmod(F.xxhash64("doc_id", F.lit("window")), spare + 1) + 1).cast("int")
    got = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")   # at most 2 * rows ids
           .select("doc_id", "label", text.substr(start, F.lit(chars)).alias("text")).collect())
    by: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text"])):
        by[r["label"]].setdefault(r["text"], r["doc_id"])      # copies count once
    parts = {y: list(by[y]) for y in (0, 1)}
    if not all(parts.values()):
        return Model(b"", b"", 0.0, 0.0)
    x, lab = [], []
    for k in range(FOLDS):
        rest = {y: [t for i, t in enumerate(p) if i % FOLDS != k] or p for y, p in parts.items()}
        diff = difference(dictionary(rest[1]), dictionary(rest[0]))
        for y, p in parts.items():
            x += [diff(t) for t in p[k::FOLDS]]
            lab += [y] * len(p[k::FOLDS])
    x, lab = np.array(x), np.array(lab, float)
    n = sum(sizes.values())
    w = np.where(lab == 1, sizes[1] / len(parts[1]), sizes[0] / len(parts[0])) / n * len(lab)
    a, b = logistic(x, lab, w)
    return Model(dictionary(parts[1]), dictionary(parts[0]), a, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; map-only, whole texts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = model.scorer()
        s = [f(t) for t in texts_of(batch)]
        return pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64()),
                                pa.array([int(x >= THRESHOLD) for x in s], pa.int32())],
                               names=["doc_id", "score", "predicted"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run,
                       "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) that the model does not reject."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = model.scorer()
        return batch.filter(pa.array([f(t) >= THRESHOLD for t in texts_of(batch)], pa.bool_()))
    return map_batches(docs, run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)`` of the rows that may be learned from."""
    return (labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
            .select("doc_id", F.col("quality").alias("label")))
