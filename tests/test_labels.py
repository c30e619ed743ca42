from pyspark.sql import functions as F

from weaklabel.operators import labels as lb
from weaklabel.plans.common import LANG_SPLIT, lang_prepared

SF = "/root/testdata/sf0.001"


def test_half_even_sample_size(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], "doc_id bigint, label string")
    assert lb.stratified_sample(df, 0.5).where("is_sampled").count() == 2  # round(2.5) = 2


def test_sample_sizes_per_label(spark):
    rows = [(i, "big") for i in range(301)] + [(1000 + i, "small") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string")
    got = dict(lb.stratified_sample(df, 0.3, bits=4).where("is_sampled").groupBy("label").count().collect())
    assert got == {"big": round(0.3 * 301), "small": round(0.3 * 7)}


def test_split_disjoint_cover_and_stable(spark):
    p = lang_prepared(spark, SF)
    s = lb.label_split(p, **LANG_SPLIT)
    a = {(r.doc_id, r.split) for r in s.select("doc_id", "split").collect()}
    assert len(a) == p.count() == len({d for d, _ in a})
    b = {(r.doc_id, r.split) for r in lb.label_split(p.repartition(1), **LANG_SPLIT).select("doc_id", "split").collect()}
    assert a == b


def test_removed_labels_are_rare(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 3), ("c", 5), ("d", 1)], "label string, n bigint")
    rare = lb.rare_labels(counts, 0.5)
    assert {r.label for r in rare.collect()} == {"d", "b"}
    removed = {r.label for r in lb.sample_rare_labels(rare, 3, 42).collect()}
    assert removed and removed <= {"d", "b"}


def test_label_sets_index(spark):
    df = spark.createDataFrame([(1, "b", "labeled"), (2, "a", "labeled"), (3, "z", "unlabeled"), (4, "a", "unlabeled")],
                               "doc_id bigint, label string, split string")
    rows = {r.label: (r.status, r.class_idx) for r in lb.label_sets(df).collect()}
    assert rows == {"a": ("existing", 0), "b": ("existing", 1), "z": ("unseen", None)}
