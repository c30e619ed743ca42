"""Toxicity: a convolutional text classifier, trained in numpy by shards.

A text's words (runs of letters and digits, lower-cased) are hashed into
``BUCKETS`` buckets; the buckets that training has seen in ``MIN_TEXTS`` texts
hold an embedding each, all others share one of zeros. Filters of several
widths slide over the embeddings, each filter's largest response over the
whole text is kept (max pooling), and a linear layer makes the logit.

Logits become probabilities by a logistic curve fitted on texts that a network
trained without them has scored, weighted to the classes' true sizes. Curve and
threshold are fitted for each language that has enough such rows, and for
all texts together; the score is moved so that a language's threshold stands
at ``THRESHOLD``. The language is read off the text by its function words, so
the table's other columns are never read by a score.

All labelled rows are learned from, with whole texts. They are dealt to shards;
a task trains on its shard from the same start, and what the shards learned is
averaged, one pass after the other. Word counts, curves and thresholds come from
sums over all labelled rows, so the driver holds the networks (a row for each of
at most ``MAX_WORDS`` buckets) and counts by language and logit, no rows.

Scoring is map-only and takes whole texts: long ones are cut between words and
their largest responses are merged.

Defined cases: a null text counts as empty; an empty text, or one without
words, gets the score of no response; repeated rows get a row each; an empty
table gives no rows; extra columns are not read. Without labelled rows of both
classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_by_place
from ..session import cut_lineage
from .common import map_batches, texts_of

#: Labelled rows below which one task learns alone, and rows of a shard beyond that.
ALONE_ROWS = 10_000
SHARD_ROWS = 5_000
#: Ids of labelled rows that are broadcast; more are joined.
MAX_IDS = 1_000_000
BUCKETS = 1 << 24
MIN_TEXTS = 3
#: Buckets with an embedding; of more, those whose share of texts of label 1 is furthest from that of all texts.
MAX_WORDS = 1 << 17
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Passes over few rows; with many, fewer, but two at least, as long as rows x passes exceed ``VISITS``.
EPOCHS = 6
VISITS = 60_000
BATCH = 64
RATE = 0.01
#: Pull of all parameters to zero; share of words left out of a text each time it is trained on.
DECAY = 1e-3
DROP = 0.25
FOLDS = 2
#: Rows of a class that a language needs for a curve and threshold of its own.
LANGUAGE_ROWS = 40
THRESHOLD = 0.7
#: Characters and words handled at a time.
PIECE = 1 << 20
BLOCK = 1 << 15
#: Logits are counted in steps of this size up to this distance from zero.
STEP, FAR = 1 / 256, 32

# Frequent function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for with was as on are be this by at from or an",
    "de": "der die das und ist nicht mit ein eine zu von den dem auf sich im des für als auch",
    "fr": "le la les et des une un que est dans pour qui sur pas par du au avec ce en",
    "es": "el los las y que en un una por con para del se no su al lo como es más",
    "it": "il di che e la per un non sono con si da come anche ma gli della nel una",
    "pt": "o a os que e do da em um para com não uma no na por mais dos como mas",
    "nl": "de het een en van ik te dat die in is niet op zijn met voor aan er om ook",
}
WORD_BREAK = r"[^\p{L}\p{N}]+"


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


def pieces(text: str, most: int) -> list[str]:
    """The text cut between words into pieces of about ``most`` characters."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end].isalnum():
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    """The buckets of each text's words, in order."""
    if not texts:
        return []
    col = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), WORD_BREAK, " ")
    words = pc.split_pattern(pc.utf8_trim(col, " "), " ")
    coded = words.flatten().dictionary_encode()
    table = np.array([bucket(w) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    flat = table[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    ends = np.asarray(words.offsets)
    return [(p := flat[a:b])[p >= 0] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def runs(texts: list[str]) -> Iterator[list[np.ndarray]]:
    """``hashed_words`` of texts of any length, in bounded memory: lists of
    each text's arrays, which follow each other."""
    got: list[list[np.ndarray]] = [[] for _ in texts]
    parts, owner, size = [], [], 0

    def flush():
        for i, w in zip(owner, hashed_words(parts), strict=True):
            got[i].append(w.astype(np.int32))
    for i, t in enumerate(texts):
        for p in pieces(t, PIECE):
            parts.append(p)
            owner.append(i)
            size += len(p)
            if size > PIECE:
                flush()
                parts, owner, size = [], [], 0
    flush()
    yield from got


@dataclass
class Network:
    """Embeddings of ``buckets`` (sorted; row 0 is the zeros of all others),
    filters by width, and the linear layer."""
    buckets: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]                       # (width * SIZE, FILTERS) each
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Embedding rows of hashed words."""
        if not len(self.buckets):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.buckets, words), len(self.buckets) - 1)
        return np.where(self.buckets[at] == words, at + 1, 0)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response of every filter over a text's embedding rows. The
        text is followed by zeros, so every filter has a place that hears
        nothing and answers with its bias; only the others are computed."""
        pad = max(WIDTHS) - 1
        rows = np.concatenate([rows, np.zeros(pad + 1, rows.dtype)])
        best = np.concatenate(self.bias)
        for a in range(0, len(rows) - pad, BLOCK):
            part = rows[a:a + BLOCK + pad]
            n = len(part) - pad
            heard = np.flatnonzero(np.any([part[k:k + n] != 0 for k in range(pad + 1)], axis=0))
            if len(heard):
                x = self.embedding[part[heard[:, None] + np.arange(pad + 1)]]
                best = np.maximum(best, np.concatenate([
                    (x[:, :w].reshape(len(heard), -1) @ f + b).max(0)
                    for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True)]))
        return np.maximum(best, 0)

    def logit(self, words: list[np.ndarray]) -> float:
        rows = np.concatenate([self.rows(w) for w in words] or [np.empty(0, np.int64)])
        return float(self.pooled(rows) @ self.out + self.out_bias)


def blank(buckets: np.ndarray, seed: int = 0) -> Network:
    """A network before training, with a row for each of the sorted ``buckets``."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (len(buckets) + 1, SIZE)).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(0, (2 / (w * SIZE)) ** 0.5, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Network(buckets, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32))


class Adam:
    """Adam with decay on one array, in place, or on some of its rows: the
    others keep their averages."""

    def __init__(self, x: np.ndarray):
        self.x, self.m, self.v, self.t = x, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, grad: np.ndarray, at=slice(None)) -> None:
        self.t += 1
        self.m[at] += 0.1 * (grad - self.m[at])
        self.v[at] += 0.001 * (grad * grad - self.v[at])
        rate = RATE * (1 - 0.999 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        self.x[at] -= rate * self.m[at] / (np.sqrt(self.v[at]) + 1e-8) + RATE * DECAY * self.x[at]


class Trainer:
    """Stochastic gradients of the weighted log loss on a copy of a network,
    each through the one place where a filter responds most. All filters lie
    side by side in one array as wide as the widest."""

    def __init__(self, net: Network, seed: int = 0):
        self.net, self.rng = net, np.random.default_rng(seed)
        wide = max(WIDTHS) * SIZE
        self.embedding, self.out, self.out_bias = net.embedding.copy(), net.out.copy(), np.array([net.out_bias], np.float32)
        self.filters = np.concatenate([np.pad(f, ((0, wide - len(f)), (0, 0))) for f in net.filters], 1)
        self.used = np.concatenate([np.repeat(np.arange(wide) < w * SIZE, FILTERS).reshape(wide, -1) for w in WIDTHS], 1)
        self.bias = np.concatenate(net.bias)
        self.steps = [Adam(x) for x in (self.embedding, self.filters, self.bias, self.out, self.out_bias)]
        self.touched = np.zeros(len(self.embedding), bool)

    def loudest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's largest response over a text's embedding rows, and
        the rows it hears there, (filters, widest)."""
        pad, lanes = max(WIDTHS), np.arange(len(self.bias))
        rows = np.concatenate([rows, np.zeros(pad, np.int64)])
        best, where = np.full(len(lanes), -np.inf, np.float32), np.zeros(len(lanes), np.int64)
        for a in range(0, len(rows) - pad + 1, BLOCK):
            x = self.embedding[rows[a:a + BLOCK + pad - 1]]
            y = np.concatenate([x[k:len(x) - pad + 1 + k] for k in range(pad)], 1) @ self.filters
            top = y.argmax(0)
            better = y[top, lanes] > best
            best[better], where[better] = y[top, lanes][better], top[better] + a
        return best + self.bias, rows[where[:, None] + np.arange(pad)]

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One step on embedding rows of texts; a share of the words is left out."""
        heard = [self.loudest(np.where(self.rng.random(len(r)) < DROP, 0, r)) for r in texts]
        z, at = np.stack([h[0] for h in heard]), np.stack([h[1] for h in heard])       # (texts, filters), (.., widest)
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -30, 30)))
        d = (weights * (p - labels) / len(texts)).astype(np.float32)
        dz = d[:, None] * self.out * (z > 0)
        x = self.embedding[at].reshape(*z.shape, -1)
        g_filters = np.einsum("tfs,tf->sf", x, dz) * self.used
        g_words = (dz[:, :, None] * self.filters.T).reshape(-1, SIZE)
        rows, inverse = np.unique(at.ravel(), return_inverse=True)
        g_rows = np.zeros((len(rows), SIZE), np.float32)
        np.add.at(g_rows, inverse, g_words)
        some = rows > 0                                                                # row 0 stays zero
        self.touched[rows[some]] = True
        self.steps[0].step(g_rows[some], rows[some])
        for s, g in zip(self.steps[1:], (g_filters, dz.sum(0), h.T @ d, np.array([d.sum()], np.float32)), strict=True):
            s.step(g)

    def parameters(self) -> np.ndarray:
        """All but the embeddings, as rows of ``SIZE`` numbers."""
        flat = np.concatenate([self.filters.ravel(), self.bias, self.out, self.out_bias])
        return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)


def with_parameters(net: Network, rows: np.ndarray, embeddings: np.ndarray, dense: np.ndarray) -> Network:
    """``net`` with new embeddings in some rows and what ``parameters`` gave."""
    out = Network(net.buckets, net.embedding.copy(), [], [], net.out)
    out.embedding[rows] = embeddings
    wide, n = max(WIDTHS) * SIZE, FILTERS * len(WIDTHS)
    filters, bias, out.out, rest = np.split(dense.ravel().astype(np.float32), np.cumsum([wide * n, n, n]))
    filters = filters.reshape(wide, n)
    for i, w in enumerate(WIDTHS):
        out.filters.append(np.ascontiguousarray(filters[:w * SIZE, i * FILTERS:(i + 1) * FILTERS]))
        out.bias.append(bias[i * FILTERS:(i + 1) * FILTERS])
    out.out_bias = float(rest[0])
    return out


#: The function words' buckets, and for each the languages that have it.
LANGUAGES = list(FUNCTION_WORDS)
MARKERS = np.unique([bucket(w) for v in FUNCTION_WORDS.values() for w in v.split()])
MARKED = np.stack([np.isin(MARKERS, [bucket(w) for w in v.split()]) for v in FUNCTION_WORDS.values()], 1)


def language(words: list[np.ndarray]) -> str:
    """The language with the most function words in the text, at least one in
    twenty words; else the empty name."""
    found = np.zeros(len(LANGUAGES), np.int64)
    for w in words:
        at = np.minimum(np.searchsorted(MARKERS, w), len(MARKERS) - 1)
        found += MARKED[at[MARKERS[at] == w]].sum(0)
    n = sum(len(w) for w in words)
    return LANGUAGES[int(found.argmax())] if n and found.max() * 20 >= n else ""


@dataclass
class Model:
    """The network, and by language (empty: all) the curve ``a * logit + b``,
    moved so that the threshold stands at ``THRESHOLD``."""
    network: Network | None = None
    curves: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> list[float]:
        if self.network is None:
            return [0.5] * len(texts)
        out = []
        for words in runs(texts):
            a, b = self.curves.get(language(words), self.curves[""])
            out.append(1 / (1 + float(np.exp(-np.clip(a * self.network.logit(words) + b, -60, 60)))))
        return out


def curve(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature, rising (Newton, slight ridge)."""
    mean = float(np.average(logit, weights=weight))
    scale = float(np.average((logit - mean) ** 2, weights=weight)) ** 0.5 or 1.0
    z = np.stack([(logit - mean) / scale, np.ones_like(logit)], 1)
    ridge = np.diag([1e-2, 1e-6]) * weight.sum()
    t = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge,
                               z.T @ (weight * (label - p)) - ridge @ t)
        t = t + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    a = max(float(t[0]), 1e-3) / scale
    return a, float(t[1]) - a * mean


def threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best weighted F1; of a row of equally good cuts, the
    middle of the widest gap."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum((weight * label)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * label).sum())
    low = np.append(s[1:], s[-1] - 1)
    f1[s == low] = -1                                # no cut between equal scores
    best = np.flatnonzero(f1 >= f1.max() - 1e-3)
    k = best[np.argmax((s - low)[best])]
    return float((s[k] + low[k]) / 2)


def calibrated(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The curve, moved so that the threshold stands at ``THRESHOLD``."""
    a, _ = curve(logit, label, weight)
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD))) - a * threshold(logit, label, weight)


def hashed_rows(labelled: DataFrame, docs: DataFrame) -> DataFrame:
    """``(label, fold, lang, words)`` of every labelled row, its whole text's
    words hashed; written, since every pass reads it. Copies count once."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.md5("text"))
    once = (texts.select("doc_id", "digest").join(labelled, "doc_id").groupBy("label", "digest")
            .agg(F.min("doc_id").alias("doc_id")))
    once = cut_lineage(once, "labelled")
    if once.count() <= MAX_IDS:
        once = F.broadcast(once)
    mine = texts.join(once, ["doc_id", "digest"]).select(
        "label", F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int").alias("fold"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, lang = [], []
        for words in runs(texts_of(batch)):
            lang.append(language(words))
            raw.append(np.concatenate(words).astype(np.int32).tobytes())
        return pa.record_batch([batch.column("label"), batch.column("fold"), pa.array(lang, pa.string()), pa.array(raw, pa.binary())],
                               names=["label", "fold", "lang", "words"])
    return cut_lineage(map_batches(mine, run, "label int, fold int, lang string, words binary"), "hashed")


def vocabulary(rows: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """The sorted buckets that ``MIN_TEXTS`` of all texts have, at most ``MAX_WORDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for y, w in zip(b.column("label").to_pylist(), b.column("words").to_pylist(), strict=True):
                count[y, np.unique(np.frombuffer(w, np.int32))] += 1
        some = np.flatnonzero(count.any(0))
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(count[0, some], pa.int64()), pa.array(count[1, some], pa.int64())],
                              names=["bucket", "n0", "n1"])
    n = F.col("n0") + F.col("n1")
    share = sizes[1] / (sizes[0] + sizes[1])
    found = (rows.select("label", "words").mapInArrow(run, "bucket bigint, n0 bigint, n1 bigint")
             .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(n >= MIN_TEXTS)
             .orderBy(F.desc((F.col("n1") - n * share) ** 2 / n), "bucket").limit(MAX_WORDS))
    return np.sort(found.select("bucket").toArrow().column("bucket").to_numpy())


def trained(rows: DataFrame, nets: list[Network], weights: dict[int, float], shards: int, epochs: int, seed: int) -> list[Network]:
    """The networks after a pass over all rows: network k of the first
    ``FOLDS`` learns from the rows of the other folds, a further one from all.
    Each shard starts from the same networks; parameters are averaged over
    shards, an embedding over those that learned it. With one shard its rows
    are read ``epochs`` times."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        trainers = [Trainer(n, seed + k) for k, n in enumerate(start)]
        waiting: list[list] = [[] for _ in start]

        def flush(k: int) -> None:
            if waiting[k]:
                texts, labels = zip(*waiting[k], strict=True)
                y = np.array(labels)
                trainers[k].learn(list(texts), y, np.array([weights[v] for v in labels]))
                waiting[k] = []

        def take(fold: int, label: int, row: np.ndarray) -> None:
            for k in range(len(start)):
                if k != fold:
                    waiting[k].append((row, label))
                    if len(waiting[k]) == BATCH:
                        flush(k)

        def given() -> Iterator[tuple]:
            for b in batches:
                for y, f, w in zip(b.column("label").to_pylist(), b.column("fold").to_pylist(), b.column("words").to_pylist(), strict=True):
                    yield f, y, start[0].rows(np.frombuffer(w, np.int32))
        if epochs > 1:                                                                # few rows, at most ALONE_ROWS
            own, order = list(given()), np.random.default_rng(seed)
            for _ in range(epochs):
                for i in order.permutation(len(own)):
                    take(*own[i])
                for k in range(len(start)):
                    flush(k)
        else:
            for one in given():
                take(*one)
            for k in range(len(start)):
                flush(k)
        for k, t in enumerate(trainers):
            at, dense = np.flatnonzero(t.touched), t.parameters()
            every = np.concatenate([at, -1 - np.arange(len(dense))])
            x = np.concatenate([t.embedding[at], dense])
            for a in range(0, len(every), BLOCK):
                part = x[a:a + BLOCK]
                yield pa.record_batch([pa.array(np.full(len(part), k), pa.int32()), pa.array(every[a:a + BLOCK], pa.int64()),
                                       pa.FixedSizeListArray.from_arrays(pa.array(part.ravel(), pa.float32()), SIZE).cast(pa.list_(pa.float32()))],
                                      names=["net", "row", "vector"])
    learned = rows.select("label", "fold", "words").coalesce(shards).mapInArrow(run, "net int, row bigint, vector array<float>")
    mean = mean_by_place(learned, ["net", "row"], SIZE).select("net", "row", F.col("vector").cast("array<float>").alias("vector")).toArrow()
    shared.destroy()                                 # else each pass leaves its networks on the disks
    net, row = mean.column("net").to_numpy(), mean.column("row").to_numpy()
    vector = mean.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    out = []
    for k, n in enumerate(nets):
        words, dense = (net == k) & (row >= 0), (net == k) & (row < 0)
        out.append(with_parameters(n, row[words], vector[words], vector[dense][np.argsort(-row[dense])]))
    return out


def crossed(rows: DataFrame, nets: list[Network]) -> list:
    """``(lang, label, step, n)``: logits of all rows, each by the network that
    did not learn from it, counted by language and label in steps of ``STEP``."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value[f].logit([np.frombuffer(w, np.int32)]) for f, w in
               zip(batch.column("fold").to_pylist(), batch.column("words").to_pylist(), strict=True)]
        step = np.rint(np.clip(got, -FAR, FAR) / STEP)
        return pa.record_batch([batch.column("lang"), batch.column("label"), pa.array(step, pa.int32())], names=["lang", "label", "step"])
    counts = (map_batches(rows, run, "lang string, label int, step int").groupBy("lang", "label", "step")
              .agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "label", "step").collect())
    shared.destroy()
    return counts


def fit(labelled: DataFrame, docs: DataFrame) -> Model:
    """Fit on all of ``labelled(doc_id, label)`` with the whole texts of ``docs``."""
    labelled = (labelled.where("doc_id is not null and label in (0, 1)")
                .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")))
    rows = hashed_rows(labelled, docs)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < FOLDS:
        return Model()
    n = sum(sizes.values())
    weights = {y: n / (2 * sizes[y]) for y in sizes}
    buckets = vocabulary(rows, sizes)
    nets = [blank(buckets, k) for k in range(FOLDS + 1)]
    passes = min(EPOCHS, max(2, -(-VISITS // n)))
    if n <= ALONE_ROWS:
        nets = trained(rows, nets, weights, 1, passes, 0)
    else:
        shards = min(rows.sparkSession.sparkContext.defaultParallelism, n // SHARD_ROWS)
        for i in range(passes):
            nets = trained(rows, nets, weights, shards, 1, i * len(nets))
    counts = crossed(rows, nets[:FOLDS])
    lang = np.array([r["lang"] for r in counts])
    logit, label, weight = np.array([(r["step"] * STEP, r["label"], r["n"]) for r in counts], float).T
    curves = {"": calibrated(logit, label, weight)}
    for name in sorted(set(lang.tolist()) - {""}):
        m = lang == name
        if min(weight[m & (label == 0)].sum(), weight[m & (label == 1)].sum()) >= LANGUAGE_ROWS:
            curves[name] = calibrated(logit[m], label[m], weight[m])
    return Model(nets[FOLDS], curves)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; map-only, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # at most MAX_WORDS rows of SIZE numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.scores(texts_of(batch))
        return pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64()),
                                pa.array([int(x >= THRESHOLD) for x in s], pa.int32())],
                               names=["doc_id", "score", "predicted"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run,
                       "doc_id bigint, score double, predicted int")


def learnable(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)`` of the rows that may be learned from."""
    return (labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
            .select("doc_id", F.col("toxic").alias("label")))
