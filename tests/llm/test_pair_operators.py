"""Operators that compare documents, against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from weaklabel.llm import anchors, common, pivots, queries, simhash

SCHEMA = "doc_id bigint, text string, source string"


def closure(n, near):
    """Smallest index reached from each, by the matrix ``near``."""
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], n).min(1, initial=n))
        if (new == root).all():
            return root
        root = new


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = np.eye(600, dtype=bool)
    for u, v in edges:
        if u is not None:
            near[u, v] = near[v, u] = True
    want = closure(600, near)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert common.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    n = [0] * 64
    for s in grams:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(grams))


def test_keep_first_loses_no_text_of_shared_or_missing_ids(spark):
    a, b = "copied words of a text that many rows hold", "quite another text that stands alone here"
    schema = "doc_id bigint, text string, fp int, ROOT string, gone_id int"

    def kept(rows):
        df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
        out = simhash.keep_first(df)
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert kept([(1, a), (2, a), (2, b), (None, a)]) == [(1, a), (2, b)]
    assert kept([(3, a), (3, a), (4, b), (4, b), (5, b)]) == [(3, a), (4, b)]
    assert kept([(None, a), (None, a), (None, b), (7, b), (None, None), (None, "")]) == sorted([(7, b), (None, a), (None, None)], key=repr) \
        or kept([(None, a), (None, a), (None, b), (7, b), (None, None), (None, "")]) == sorted([(7, b), (None, a), (None, "")], key=repr)
    assert kept([(1, a), (2, b)]) == [(1, a), (2, b)]
    assert kept([]) == []


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"v{i}é" for i in range(500)]
    texts = [None, "", " \n", "one", "One two", "a " * 5000]
    for _ in range(60):
        w = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(w))
        for _ in range(3):
            v = w[:]
            v[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "s") for i, t in zip(ids, texts, strict=True)] + [(ids[3], "one", "t")], SCHEMA)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 20)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    order = np.argsort(ids)
    fps = np.array([plain_fingerprint(texts[i]) for i in order], np.uint64)
    want = closure(len(fps), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert got == {(d, f"{int(f):016x}"): int(want[d]) for d, f in enumerate(fps)}
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(kept) == sorted({int(x) for x in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_vantage_points_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 800, dtype=np.uint64)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(2)]
    x = np.unique(np.r_[base, np.array(near, np.uint64)])
    i, j = simhash.near_pairs(x, 2)
    root, full = np.arange(len(x)), np.arange(len(x))
    simhash.forest(root, i, j)
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    simhash.forest(full, a, b)
    assert (root == full).all()
    tree, out = simhash.tree(x, 16), []
    simhash.route(tree, x, np.arange(len(x)), 2, out)
    shards = [set(r.tolist()) for _, r in out]
    assert len(shards) > 8 and all(any(p in s and q in s for s in shards) for p, q in zip(a, b, strict=True))


def test_pivot_index_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(120):
        center = rng.normal(size=64)
        for _ in range(6):
            rows.append((c % 3, center + rng.normal(size=64) * rng.uniform(0.02, 0.16)))
    rows += [(0, rows[0][1] * 1.0)] * 4
    data = [(i, y, [float(np.float32(v)) for v in x]) for i, (y, x) in enumerate(rows)]
    odd = [(9000, 0, None), (9001, 0, []), (9002, 0, [0.0] * 64), (9003, 0, [float("nan")] + [1.0] * 63), (9004, None, data[0][2]),
           (9005, 0, [None] + [1.0] * 63), (9006, 0, [1.0, 2.0]), (None, 1, [1.0] * 64)]
    df = spark.createDataFrame(data + odd, "vec_id bigint, label int, embedding array<float>")
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(data) + len(odd)
    x = np.array([v for _, _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([y for _, y, _ in data])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(data))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum() > 500
    want = closure(len(data), near)
    assert sum(got[i].component_id == want[i] for i in range(len(data))) >= 0.98 * len(data)
    for o in odd:
        assert got[o[0]].n_links == 0 and got[o[0]].component_id == o[0] and got[o[0]].kept
    assert pivots.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n_pivots", [128, 512])
def test_pivot_index_in_a_hot_group(spark, monkeypatch, n_pivots):
    rng = np.random.default_rng(n_pivots)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.12 * x[::3]                          # a third: distinct vectors about one
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(pivots, "MIN_PIVOTS", n_pivots)
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x.tolist())], "vec_id bigint, label int, embedding array<float>")
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert near.sum() > 500_000 and (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()


def test_pivot_index_in_a_narrow_cone(spark):
    rng = np.random.default_rng(3)

    def directions(n):
        g = rng.normal(size=(n, 64))
        return g / np.linalg.norm(g, axis=1, keepdims=True)
    x = directions(1) + 0.25 * directions(1200)              # any two have a cosine of about 0.94
    x = np.concatenate([x, x + 0.18 * directions(1200)]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x.tolist())], "vec_id bigint, label int, embedding array<float>")
    coded = pivots.usable(df)
    chosen = pivots.choose_pivots(coded, 128)[64]
    assert len(chosen) >= 64
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert near.sum() > 2000 and (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()


def test_spaced_pivots():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(16_384, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.12 * x[::3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = pivots.spaced(np.empty((0, 64)), x, 4096)
    cosines = got @ got.T
    np.fill_diagonal(cosines, 0)
    assert len(got) == 4096 and cosines.max() < pivots.SPACING and (got @ x[0] > 0.95).sum() == 1
    code = pivots.nearest(x[:6000:3], got, pivots.DEPTH)
    bits = np.zeros((len(code), 4096), np.float32)
    bits[np.arange(len(code))[:, None], code] = 1
    near = x[:6000:3] @ x[:6000:3].T >= 0.98
    assert (bits @ bits.T >= pivots.SHARED)[near].mean() >= 0.95


def removed(docs):
    """Word masks by the contract's own words."""
    words = [(d, (t or "").split()) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        out.append((d, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("chunk", [1, 100_000])
def test_anchors_against_brute_force(spark, chunk):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(w))
            w[at:at] = p
        if i % 7 == 0:
            w = w + w[:40]
        docs.append((i * 3 % 61, " ".join(w)))
    docs += [(100, docs[4][1]), (101, docs[4][1]), (102, ""), (103, None), (104, "a " * 3000)]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], SCHEMA)
    got = {r.doc_id: r.kept for r in anchors.deduplicate(df, with_text=True, chunk_bytes=(chunk * 2000, 1 << 26)).collect()}
    assert got == dict(removed(docs))
    assert anchors.deduplicate(df.limit(0)).count() == 0


def test_anchors_take_rows_without_id(spark):
    text = " ".join(f"z{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (5, text, 3), (5, text, 3)], "doc_id bigint, text string, chunk int")
    got = sorted((r.doc_id or -1, r.n_removed) for r in anchors.deduplicate(df).collect())
    assert got == [(-1, 30), (-1, 30), (5, 0), (5, 0)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
