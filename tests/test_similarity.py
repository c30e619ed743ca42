import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import similarity as sim


def test_histogram_fixture(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.10, 0.15, 0.20, 0.55, 0.60, 1.10])],
                               "doc_id bigint, max_sim double")
    h = sim.similarity_histogram(df).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 1, 0, 0, 1, 1, 0, 0, 0, 1]
    assert [r.cum_pct for r in h] == [33.3, 50.0, 50.0, 50.0, 66.7, 83.3, 83.3, 83.3, 83.3, 100.0]


def test_histogram_equal_values(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5)], "doc_id bigint, max_sim double")
    h = sim.similarity_histogram(df).orderBy("bin").collect()
    assert [round(r.lo, 6) for r in h] == [round(0.1 * i, 6) for i in range(10)]
    assert sum(r["count"] for r in h) == 2


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, 0.10), (2, 0.15), (3, 0.20), (4, None)], "doc_id bigint, max_sim double")
    got = dict(sim.confidence_split(df, 0.20).select("doc_id", "is_confident").collect())
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_classify_ties_zero_and_null(spark):
    classes = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [1.0, 0.0]), ("z", 2, [0.0, 1.0])],
                                    "label string, class_idx int, vector array<double>")
    docs = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 3.0])],
                                 "doc_id bigint, vector array<double>")
    out = {r.doc_id: (r.class_idx, r.best_label, r.max_sim) for r in sim.classify(docs, classes).collect()}
    assert out[1] == (0, "x", pytest.approx(1.0))
    assert out[2][2] == 0.0
    assert out[3] == (None, None, None)
    assert out[4][:2] == (2, "z")


def test_classify_blocks_equal_single(spark):
    classes = spark.createDataFrame([(f"c{i}", i, [float(i), 1.0, float(i % 3)]) for i in range(7)],
                                    "label string, class_idx int, vector array<double>")
    docs = spark.createDataFrame([(j, [1.0, float(j), 2.0]) for j in range(20)], "doc_id bigint, vector array<double>")
    one = {r.doc_id: r.class_idx for r in sim.classify(docs, classes).collect()}
    blocked = {r.doc_id: r.class_idx for r in sim.classify(docs, classes, max_broadcast_bytes=48).collect()}
    assert one == blocked
    t1 = sim.cosine_topk(docs, classes, k=3).collect()
    t2 = sim.cosine_topk(docs, classes, k=3, max_broadcast_bytes=48).collect()
    key = lambda rows: sorted((r.doc_id, r["rank"], r.class_idx) for r in rows)
    assert key(t1) == key(t2)
    assert all(-1.0 - 1e-9 <= r.sim <= 1.0 + 1e-9 for r in t1)


def test_tops_keep_the_order_of_a_stable_sort():
    rng = np.random.default_rng(4)
    for n, k in ((5, 8), (9, 8), (5000, 8), (5000, 1), (5000, 3)):
        x, m = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (n, 3)).astype(float)
        best, where = sim._tops(x, m, k)
        order = np.argsort(-(x @ m.T), axis=1, kind="stable")[:, :k]
        assert (where == order).all() and (best == np.take_along_axis(x @ m.T, order, axis=1)).all()


def test_a_table_of_one_block_of_bytes_is_many_tasks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vector array<double>")
    out = sim.self_topk(df, 2)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :2]
    got = {(r.vec_id, r.rank): r.neighbour for r in out.collect()}
    assert len(got) == 6000 and all(got[i, k + 1] == want[i, k] for i in range(3000) for k in range(2))
