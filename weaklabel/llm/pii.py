"""Personal data: base patterns, and a skip-chain conditional random field.

The base patterns give e-mail and IP addresses, payment cards and phone
numbers. The field labels every token that holds a digit or an at sign (other
tokens cannot be personal data here and are fixed to "none"). Its potentials
are features of the token and its surroundings, of neighbouring tokens' labels
(the chain), and of the labels of distant tokens that repeat the same or
similar content, the same address, digits or last seven digits (the skip edges:
each to the previous such token, so there are never more edges than tokens).
Loopy message passing gives marginals; tokens the field is sure of that no base
match touches become further spans. So a number that is spelt like none of the
patterns is found where the same digits stand elsewhere as a phone number.

The weights are fitted by pseudo-likelihood on a bounded sample of texts,
labelled by the base patterns. So that a repeat has something to tell, each
token that can have one is also learned with its own features hidden, from the
label of its repeat; a token without a repeat stands for its own. Repeats that
the patterns label differently weaken the skip weights.

Texts are taken in runs of about ``RUN_CHARS`` characters; tokens and features
of a run are flat arrays and messages are sent in blocks, so memory is linear in
the longest text, about 100 bytes a character where it is all numbers.

Every pattern starts at most once in a run of its characters, so the time for
a text is linear in its length, also where it has no white space at all.

Defined cases: a null text counts as empty and has no spans; repeated rows get
a row each; an empty table gives no rows; extra columns are not read. Without
sample texts the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, map_batches, texts_of

# The kinds in listing order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")               # nothing follows: possessive, so long runs need no stack
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Parts of the e-mail pattern: matches are found from the at signs.
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ANY = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: Documents (about), and characters of each, among which the field's training texts are looked for.
TRAIN_DOCS = 12_000
TRAIN_CHARS = 8_000
FEATURES = 1 << 14
SURE = 0.95
ROUNDS = 12
#: Characters of the texts labelled together, tokens or messages handled at a time, last digits that make tokens similar.
RUN_CHARS = 1 << 20
BLOCK = 1 << 16
LAST = 7
N = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of ``EMAIL``. Only the run of local characters before each
    at sign is looked at, so a long run without one costs nothing."""
    out = []
    free = 0                                             # no match starts before this place
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        m = DOMAIN.match(text, free) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if ANY.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = digits_of(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


SHAPES = ((re.compile(r"[0-9]+"), lambda m: "9" * min(len(m.group()), 5) if len(m.group()) < 9 else
           ("N" if len(m.group()) < 12 else "C" if len(m.group()) < 20 else "L")),
          (re.compile(r"[^\W\d_]+"), lambda m: "a"))
EDGE = "\"'.,;:!?<>[]{}|*#&%$"


def shape(token: str) -> str:
    """The token's signs, with letters and digit runs summed up."""
    token = token[:64]
    for pattern, to in reversed(SHAPES):
        token = pattern.sub(to, token)
    return token


CODES: dict[str, int] = {}


def code(name: str) -> int:
    found = CODES.get(name)
    if found is None:
        if len(CODES) > 100_000:                             # names of rare words
            CODES.clear()
        found = CODES[name] = zlib.crc32(name.encode()) % FEATURES
    return found


BIAS = zlib.crc32(b"bias") % FEATURES


@dataclass
class Graph:
    """Tokens of a run of texts as flat arrays: text, span, number of features
    and all features in a row; chain and skip edges as pairs of tokens, and the
    tokens that can have skip edges."""
    doc: array = field(default_factory=lambda: array("i"))
    start: array = field(default_factory=lambda: array("q"))
    end: array = field(default_factory=lambda: array("q"))
    size: array = field(default_factory=lambda: array("i"))
    features: array = field(default_factory=lambda: array("i"))
    chain: array = field(default_factory=lambda: array("i"))
    skip: array = field(default_factory=lambda: array("i"))
    keyed: array = field(default_factory=lambda: array("i"))

    def edges(self, which: array) -> np.ndarray:
        return np.asarray(which, np.int32).reshape(-1, 2)

    def add(self, d: int, text: str) -> None:
        """The tokens of text number ``d``."""
        found = TOKEN.finditer(text)
        after = next(found, None)
        shaped = shape(after.group().strip(EDGE)) if after else ""
        before_end, before_shape = -9, ""
        last: dict[int, int] = {}                            # by the key's hash
        while after:
            m, my_shape = after, shaped
            a, b, raw = m.start(), m.end(), m.group()
            after = next(found, None)
            shaped = shape(after.group().strip(EDGE)) if after else ""
            core = raw.strip(EDGE)
            digits = digits_of(core)
            words = text[max(0, a - 24):a].split()
            left = before_shape if a - before_end <= 2 else ""
            linked = a - before_end <= 2
            right = shaped if after and after.start() - b <= 2 else ""
            names = ["bias", "s:" + my_shape, "n:" + str(min(len(digits), 20)), "<:" + left, ">:" + right,
                     "<s:" + left + " " + my_shape, "w:" + (words[-1].lower()[:16] if words else "")]
            if "@" in core:
                names.append("@full" if EMAIL.fullmatch(core) else "@part")
            if 12 <= len(digits) <= 19:
                names.append("luhn" if luhn(digits) else "noluhn")
            if core.count(".") == 3 and IP.fullmatch(core):
                names.append("ip" if small_parts(core) else "noip")
            if core.startswith("+"):
                names.append("plus")
            me = len(self.doc)
            begin = a + (len(raw) - len(raw.lstrip(EDGE)) if core else 0)
            self.doc.append(d)
            self.start.append(begin)
            self.end.append(begin + len(core))
            self.size.append(len(names))
            self.features.extend([code(n) for n in names])
            if linked:
                self.chain.extend((me - 1, me))
            key = core.lower() if "@" in core else digits[-LAST:] if len(digits) >= 5 else ""
            if key:
                self.keyed.append(me)
                h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
                there = last.get(h)
                if there is not None and (me - 1 != there or not linked):
                    self.skip.extend((there, me))
                last[h] = me
            before_end, before_shape = b, my_shape


def graph_of(texts: list[str]) -> Graph:
    g = Graph()
    for d, text in enumerate(texts):
        if ANY.search(text):
            g.add(d, text)
    return g


@dataclass
class Field:
    """Weights: of features by label, of neighbouring labels, and of equal
    labels at the ends of a skip edge."""
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, g: Graph) -> np.ndarray:
        size, features = np.asarray(g.size, np.int32), np.asarray(g.features, np.int32)
        ends = np.cumsum(size, dtype=np.int64)
        out = np.zeros((len(size), N))
        for a in range(0, len(size), BLOCK):
            b = min(len(size), a + BLOCK)
            first = ends[a] - size[a]
            out[a:b] = np.add.reduceat(self.unary[features[first:ends[b - 1]]], ends[a:b] - size[a:b] - first)
        return out

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product in logarithms, all messages at once a round,
        half of each old message kept."""
        u = self.potentials(g)
        chain, skip = g.edges(g.chain), g.edges(g.skip)
        edges = np.concatenate([chain, skip])
        if not len(u) or not len(edges):
            return soft(u)
        n = len(edges)
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        repeat = np.exp(np.diag(self.skip))
        tables = np.exp(np.stack([self.chain, np.log(repeat), self.chain.T, np.log(repeat)]))
        kind = np.repeat(np.arange(4, dtype=np.int8), [len(chain), len(skip), len(chain), len(skip)])
        msg = np.zeros((2 * n, N), np.float32)
        for _ in range(rounds):
            belief = received(u, dst, msg)
            fresh = np.empty_like(msg)
            moved = 0.0
            for a in range(0, 2 * n, BLOCK):
                part = np.arange(a, min(2 * n, a + BLOCK))
                x = belief[src[part]] - msg[np.where(part < n, part + n, part - n)]
                x = np.exp(x - x.max(1, keepdims=True))
                y = np.empty_like(x)
                for k in range(4):
                    mine = kind[part] == k
                    y[mine] = x[mine] @ tables[k]
                y = np.log(y)
                y -= y.max(1, keepdims=True)
                moved = max(moved, float(np.abs(y - msg[part]).max()))
                fresh[part] = 0.5 * msg[part] + 0.5 * y
            msg = fresh
            if moved < 1e-6:
                break
        return soft(received(u, dst, msg))


def received(u: np.ndarray, dst: np.ndarray, msg: np.ndarray) -> np.ndarray:
    """``u`` and the messages to each token."""
    return np.stack([u[:, k] + np.bincount(dst, msg[:, k], minlength=len(u)) for k in range(N)], 1)


def soft(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gold(texts: list[str], g: Graph) -> np.ndarray:
    """Labels of the tokens: the kind of the first base match that touches them."""
    out = np.zeros(len(g.doc), np.int64)
    doc, spans, at = -1, [], 0
    for i, (d, a, b) in enumerate(zip(g.doc, g.start, g.end, strict=True)):
        if d != doc:
            doc, spans, at = d, base_spans(texts[d]), 0
        while at < len(spans) and spans[at][2] <= a and all(s[2] <= a for s in spans[at:at + 4]):
            at += 1
        for start, kind, end in spans[at:]:
            if start >= b:
                break
            if a < end:
                out[i] = kind + 1
                break
    return out


def train(texts: list[str], epochs: int = 60) -> Field:
    """Pseudo-likelihood: each token's label given the features and the labels
    at the other ends of its edges, and that of each token with a key given the
    label of its repeat alone (AdaGrad, slight decay)."""
    found = Field(np.zeros((FEATURES, N)), np.zeros((N, N)), np.zeros(N))
    g = graph_of(texts)
    if not g.doc:
        found.unary[:, 0] = 1.0
        return found
    y = gold(texts, g)
    own = np.eye(N)[y]
    flat = np.array(g.features, np.int64)
    row = np.repeat(np.arange(len(y)), np.array(g.size))
    chain, skip = g.edges(g.chain), g.edges(g.skip)
    hidden = np.array(g.keyed, np.int64)                     # with the label of a repeat, else their own
    partner = np.arange(len(y))
    partner[skip[:, 1]], partner[skip[:, 0]] = skip[:, 0], skip[:, 1]
    told, mine = own[partner[hidden]], own[hidden]
    sums = [np.zeros_like(found.unary) + 1e-8, np.zeros_like(found.chain) + 1e-8, np.zeros_like(found.skip) + 1e-8]
    used = np.unique(np.append(flat, BIAS))
    for _ in range(epochs):
        x = np.zeros((len(y), N))
        np.add.at(x, row, found.unary[flat])
        np.add.at(x, chain[:, 1], found.chain[y[chain[:, 0]]])
        np.add.at(x, chain[:, 0], found.chain[:, y[chain[:, 1]]].T)
        np.add.at(x, skip[:, 1], own[skip[:, 0]] * found.skip)
        np.add.at(x, skip[:, 0], own[skip[:, 1]] * found.skip)
        r = (own - soft(x)) / len(y)
        h = (mine - soft(found.unary[BIAS] + told * found.skip)) / len(y)
        du = np.zeros_like(found.unary)
        np.add.at(du, flat, r[row])
        du[BIAS] += h.sum(0)
        dc = own[chain[:, 0]].T @ r[chain[:, 1]] + r[chain[:, 0]].T @ own[chain[:, 1]]
        ds = (own[skip[:, 0]] * r[skip[:, 1]]).sum(0) + (own[skip[:, 1]] * r[skip[:, 0]]).sum(0) + (told * h).sum(0)
        for w, d, s, at in ((found.unary, du, sums[0], used), (found.chain, dc, sums[1], slice(None)), (found.skip, ds, sums[2], slice(None))):
            d = d[at] - 1e-5 * w[at]
            s[at] += d * d
            w[at] += 0.5 * d / np.sqrt(s[at])
    found.skip = np.maximum(found.skip, 0.0)                 # equal ends never repel
    return found


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of the spans that the field is sure of, by text:
    neighbouring tokens of a kind are one span."""
    out: list[list[tuple[int, int, int]]] = []
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= RUN_CHARS:
            out += run_spans(run, field)
            run, size = [], 0
    return out + run_spans(run, field)


def run_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    g = graph_of(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.doc:
        return out
    p = field.marginals(g)
    best = p.argmax(1)
    sure = (best > 0) & (p.max(1) >= SURE)
    joined = np.zeros(len(best), bool)
    joined[g.edges(g.chain)[:, 1]] = True
    for i in np.flatnonzero(sure).tolist():
        spans = out[g.doc[i]]
        a, b = g.start[i], g.end[i]
        if joined[i] and sure[i - 1] and best[i - 1] == best[i] and spans and spans[-1][1] == best[i] - 1:
            spans[-1] = (spans[-1][0], spans[-1][1], b)
        elif b > a:
            spans.append((a, int(best[i]) - 1, b))
    return out


def apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``more`` that touch none of ``base``, both by start."""
    out, at, reach = [], 0, 0                                # reach: largest end of the base spans up to here
    for s in more:
        while at < len(base) and base[at][0] < s[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s[0]:
            out.append(s)
    return out


def fit(docs: DataFrame, rows: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """Fit on the distinct texts with a digit or at sign in a share of about
    ``rows`` documents, ``chars`` characters of each from a place chosen by
    hash; only these are collected."""
    share = hashed_share(docs.select("doc_id", "text"), rows, "doc_id", "text")
    spare = F.greatest(F.length("text") - chars, F.lit(0))
    start = F.pmod(F.xxhash64("text", F.lit("window")), spare + 1) + 1
    texts = (share.select(F.col("text").substr(start.cast("int"), F.lit(chars)).alias("text")).where(F.col("text").rlike("[0-9@]"))
             .distinct().collect())
    return train(sorted(r["text"] for r in texts))


RESULT = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Rows of ``RESULT``, one a document; map-only, whole texts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        base = [base_spans(t) for t in texts]
        rows = []
        for b, more in zip(base, field_spans(texts, field), strict=True):
            count = Counter(x[1] for x in b)
            rows.append((*(count[k] for k in range(len(KINDS))),
                         hashlib.sha256(listed(b).encode()).hexdigest(), listed(b + apart(more, b))))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (*[pa.int64()] * 4, pa.string(), pa.string())
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                               names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, RESULT)
