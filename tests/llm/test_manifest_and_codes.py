"""The manifest and the vector codes against plain restatements."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weaklabel.llm import codebooks, merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, KEY int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes):
    """(last node, for each leaf its siblings as (left?, digest)) of a plain tree."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            if k ^ 1 < len(nodes):
                paths[leaf].append((k % 2 == 1, nodes[k ^ 1]))
            else:
                paths[leaf].append(None)
        at = [k // 2 for k in at]
        nodes = [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    out, subs, trees = [], [], []
    for lang in langs:
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = climb([leaf_of(r) for r in mine])
        subs.append(sub)
        trees.append((mine, paths))
    root, upper = climb(subs)
    for (mine, paths), sub, beyond in zip(trees, subs, upper, strict=True):
        for r, path in zip(mine, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            acc = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for s in path + beyond:
                acc = sha(acc if s is None else s[1] + acc if s[0] else acc + s[1])
            proof = sha("".join(s[1] for s in path + beyond if s))
            out.append((r[0], leaf_of(r), sub, root, proof, acc, acc == root))
    return out


def some_docs():
    rng = random.Random(5)
    rows = [(i, rng.choice(["s1", "", None]), rng.choice(["en"] * 9 + ["de", "é", "", None]),
             rng.choice([None, i, 2 ** 63 - 1, -1]), rng.choice([None, "", "text é中 " * rng.randint(1, 9)]), "clash", 1)
            for i in range(400)]
    rows += [(7, "s", "alone", 1, "x", None, None), (None, "s", "en", 4, "no id", None, None), (None, "s", None, 4, "no id", None, None),
             (11, "s", "en", 5, "other text, same id", None, None), (12, "s", "en", 5, "z" * 300_000, None, None)]
    rows += [(13, "s", "en", 5, "copy", None, None)] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("step", [1, 2, 6])
def test_manifest_against_plain_trees(spark, step):
    rows = some_docs()
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(5), step)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 1, "x", None, None)], DOCS)
    r = merkle.manifest(one).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified
    assert merkle.manifest(one.limit(0)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, x int"


def plain_codes(rows, entries, rounds):
    """{length: (code and error of each row, codebooks)} by full searches."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    by = defaultdict(list)
    for r in kept:
        x = [min(max(int(np.floor(256 * float(v))), -(1 << 27)), 1 << 27) for v in np.array(r[1], np.float32)]
        by[len(x) + -len(x) % 16].append((r, x + [0] * (-len(x) % 16)))
    out = []
    for d, mine in by.items():
        mine.sort(key=lambda m: (m[0][0] is None, m[0][0] or 0, np.array(m[1], np.int32).tobytes()))
        w = d // 16
        x = np.array([m[1] for m in mine], object).reshape(len(mine), 16, w)
        books = [[list(x[i, p]) for i in range(min(entries, len(mine)))] for p in range(16)]

        def nearest(books, x=x, w=w):
            return [[min(range(len(b)), key=lambda e: (sum((int(x[i, p][k]) - b[e][k]) ** 2 for k in range(w)), e))
                     for p, b in enumerate(books)] for i in range(len(x))]
        for _ in range(rounds):
            code = nearest(books)
            for p, b in enumerate(books):
                for e in range(len(b)):
                    own = [x[i, p] for i in range(len(x)) if code[i][p] == e]
                    if own:
                        b[e] = [int(sum(int(o[k]) for o in own)) // len(own) for k in range(w)]
        code = nearest(books)
        name = sha(",".join(str(v) for b in books for c in b for v in c))
        for i, (r, _) in enumerate(mine):
            error = sum((int(x[i, p][k]) - books[p][code[i][p]][k]) ** 2 for p in range(16) for k in range(w))
            out.append((r[0], r[2], "".join(f"{c:02x}" for c in code[i]), error, name))
    total = defaultdict(int)
    for r in out:
        total[r[1]] += r[3]
    return [(r[0], r[2], r[3], total[r[1]], r[4]) for r in out]


@pytest.mark.parametrize("entries, rounds", [(64, 2), (5, 4)])
def test_codes_against_full_search(spark, entries, rounds):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=32).astype(np.float32) * 0.3 + i % 4], i % 5 or None, "c", 1) for i in range(150)]
    rows += [(200 + i, [0.0] * 32, 1, "c", 1) for i in range(30)] + [(200, [0.0] * 32, 1, "c", 1), (None, [1.0] * 32, None, None, None)]
    rows += [(300, None, 1, "c", 1), (301, [float("nan")] * 32, 1, "c", 1), (302, [None] + [0.0] * 31, 1, "c", 1),
             (303, [float("inf")] * 32, 1, "c", 1), (304, [], 2, "c", 1), (305, [0.5] * 5, 2, "c", 1), (306, [0.25, -3.0, 7.0], 2, "c", 1),
             (307, [1e30, -1e30] * 16, 3, "c", 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = codebooks.encode(df, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_codes(rows, entries, rounds), key=repr)
    assert codebooks.encode(df.limit(0)).count() == 0


def test_bounds_spare_scans_and_use_net_displacement():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (8, 16, 4))
    x = np.repeat(centres, 100, 0) + rng.integers(-20, 20, (800, 16, 4))
    history = [np.swapaxes(x[::100], 0, 1).copy()]
    first = codebooks.Assigner(history)
    state = first(x, None)
    assert first.scanned == first.seen
    there = history[0].copy()
    there[:, :, 0] += 300
    back = history[0].copy()
    back[:, 1, 1] += 2
    history += [there, back]                         # away and back: the net move is 2, the moves' sum over 600
    third = codebooks.Assigner(history)
    got = third(x, state)
    full = codebooks.Assigner(history)(x, None)
    assert (got["code"] == full["code"]).all() and third.scanned == 0
    assert (got["lower_round"] == 0).all()
    assert codebooks.displaced(history)[0].max() == 2
