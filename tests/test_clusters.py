from weaklabel.operators import clusters as cl


def test_cluster_samples_fixture(spark):
    rows = [(1, 0, 0.9), (2, 0, 0.8), (3, 0, 0.7), (4, 1, 1.0), (5, 1, 1.0), (6, 1, 1.0), (7, 2, 0.4)]
    p = spark.createDataFrame(rows, "doc_id bigint, cluster int, prob double")
    got = {}
    for r in cl.cluster_samples(p, k=2).collect():
        got.setdefault(r.cluster, set()).add(r.doc_id)
    assert got[0] == {1, 2} and len(got[1]) == 2 and got[1] <= {4, 5, 6} and got[2] == {7}


def test_gmm_single_cluster(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, None)], "doc_id bigint, vector array<double>")
    out = {r.doc_id: (r.cluster, r.prob) for r in cl.gmm(v, 1).collect()}
    assert out == {1: (0, [1.0]), 2: (0, [1.0]), 3: (None, None)}


def test_pca_is_centred(spark):
    rows = [(i, [5.0 + i, 5.0 - 0.5 * i, 5.0 + (i % 3)]) for i in range(30)]
    v = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    model, proj = cl.pca_fit_transform(v, 2)
    vals = [r.vector for r in proj.collect()]
    for d in range(2):
        assert abs(sum(x[d] for x in vals) / len(vals)) < 1e-9


def test_subspace_pca_equals_the_exact_one(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 60)) * np.geomspace(5, 0.1, 60) @ np.linalg.qr(rng.normal(size=(60, 60)))[0] + 3
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "doc_id bigint, vector array<double>").repartition(3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    fit = cl.subspace_pca(v, 8)
    assert np.abs(fit.variance - values[::-1][:8]).max() < 1e-6 * values[-1]
    assert np.allclose(np.abs((fit.components * vectors[:, ::-1][:, :8]).sum(0)), 1, atol=1e-4)
    full = cl.subspace_pca(v, 60)
    assert np.allclose(full.variance, values[::-1])
    monkeypatch.setattr(cl, "MAX_COVARIANCE", 10)
    model, proj = cl.pca_fit_transform(v, 8)
    got = {r.doc_id: r.vector for r in proj.collect()}
    assert isinstance(model, cl.Projection) and got[999] is None
    assert np.allclose([got[i] for i in range(400)], (x - x.mean(0)) @ model.components)
