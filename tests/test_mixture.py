"""k-means, Gaussian mixtures and self-similarity against plain restatements."""

import numpy as np

from weaklabel.operators import clusters as cl
from weaklabel.operators import mixture as mx
from weaklabel.operators import similarity as sim

SCHEMA = "vec_id bigint, vector array<double>, cluster_name string"


def blobs(n=240, dim=6, k=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 8, (k, dim))
    own = rng.integers(0, k, n)
    return centres[own] + rng.normal(0, 1, (n, dim)), own


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_kmeans_restarts_find_the_clusters(spark):
    x, own = blobs()
    out = cl.kmeans(frame(spark, x, [(999, None, "n")]), 4, restarts=6, seed=3).collect()
    got = {r.vec_id: r for r in out}
    assert got[999].cluster is None and len(out) == 241
    pairs = {(got[i].cluster, int(c)) for i, c in enumerate(own)}
    assert len(pairs) == 4 and all(got[i].prob[got[i].cluster] == 1.0 for i in range(240))


def test_lloyd_equals_a_plain_loop_for_all_restarts_at_once(spark):
    x, _ = blobs(seed=2)
    rows = mx.numbered(frame(spark, x))
    starts = np.stack([x[:4], x[10:14], np.repeat(x[:1], 4, 0)])
    centres, cost = mx.lloyd(rows, starts, max_iter=5, tol=0.0)
    for r in range(3):
        c = starts[r].copy()
        for _ in range(5):
            a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[a == j].mean(0) if (a == j).any() else c[j] for j in range(4)])
        assert np.allclose(centres[r], c)
        assert np.isclose(cost[r], ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())


def test_starts_are_spread_and_repeatable(spark):
    x, own = blobs()
    rows = mx.numbered(frame(spark, x))
    starts = mx.spread_starts(rows, 4, 5, seed=9)
    assert starts.shape == (5, 4, 6) and (starts == mx.spread_starts(rows, 4, 5, seed=9)).all()
    hit = [{int(own[((x - c) ** 2).sum(1).argmin()]) for c in s} for s in starts]
    assert sum(len(h) == 4 for h in hit) >= 3                      # far apart blobs get a centre each
    u = mx.uniforms(np.arange(100_000), 1, 2, 3)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01


def plain_em(x, p, rounds, floor):
    for _ in range(rounds):
        n = p.sum(0)
        mean = (p.T @ x) / n[:, None]
        cov = [((x - m) * p[:, [c]]).T @ (x - m) / n[c] + floor * np.eye(x.shape[1]) for c, m in enumerate(mean)]
        log = np.stack([np.log(n[c] / len(x)) - 0.5 * (np.linalg.slogdet(2 * np.pi * s)[1]
                        + np.einsum("ij,jk,ik->i", x - mean[c], np.linalg.inv(s), x - mean[c])) for c, s in enumerate(cov)], 1)
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return p


def test_mixture_rounds_equal_plain_em_in_all_dimensions(spark):
    x, own = blobs(n=300, dim=5, k=3, seed=4)
    x[:, 1] = x[:, 0] * 0.5 + x[:, 1] + 100                        # correlated and off centre
    df = frame(spark, x)
    rows = mx.numbered(df)
    shift = mx.mean_vector(rows)
    start = mx.hard_start(rows, x[None, :3], shift, 1e-6)
    mixtures, value = mx.fit_mixtures(rows, start, shift, max_iter=3, tol=0.0)
    got = {r.vec_id: r.prob for r in mx.with_memberships(df, mixtures[0], shift).collect()}
    hard = np.eye(3)[((x[:, None] - x[None, :3]) ** 2).sum(2).argmin(1)]
    assert np.allclose([got[i] for i in range(300)], plain_em(x, hard, 4, 1e-6), atol=1e-6) and np.isfinite(value).all()


def test_gmm_keeps_rows_without_a_vector_and_separates(spark):
    x, own = blobs(n=200, dim=4, k=3, seed=7)
    out = {r.vec_id: r for r in cl.gmm(frame(spark, x, [(500, None, "n")]), 3, restarts=4).collect()}
    assert out[500].cluster is None and out[500].prob is None
    assert len({(out[i].cluster, int(c)) for i, c in enumerate(own)}) == 3
    assert all(abs(sum(out[i].prob) - 1) < 1e-9 for i in range(200))
    empty = frame(spark, x).where("false")
    assert cl.gmm(empty, 3).count() == 0 and cl.kmeans(empty, 3).count() == 0
    same = frame(spark, np.ones((30, 4)))                         # no variance at all
    assert cl.gmm(same, 2, restarts=2).where("cluster is null").count() == 0


def test_self_topk_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 7))
    x[5], x[6] = x[4], 2 * x[4]                                    # ties
    x[7] = 0
    df = frame(spark, x, [(200, None, "n")])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for block_bytes in (64 << 20, 7 * 8 * 20):
        got = {}
        for r in sim.self_topk(df, 4, block_bytes=block_bytes).collect():
            got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour, r.sim)
        assert sorted(got) == list(range(90))
        for i, found in got.items():
            s = u @ u[i]
            assert sorted(found) == [1, 2, 3, 4]
            assert np.allclose([found[r][1] for r in (1, 2, 3, 4)], np.sort(s)[::-1][:4], atol=1e-12)
            assert all(abs(s[n] - v) < 1e-12 for n, v in found.values())
    assert sim.self_topk(df.where("false")).count() == 0
    assert {r.neighbour for r in sim.self_topk(df.limit(2), 8).collect()} <= set(range(90))
