"""Steps of the baseline run: tokens made once and split plainly, all mixtures
in one multiplication."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.functions import text as tx
from weaklabel.operators import embeddings as em
from weaklabel.operators import mixture as mx
from weaklabel.plans.runner import run_model


def corpus(spark):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} word{i % 11}, and more", f"l{i % 6}") for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label string")


def test_supplied_vectors_may_be_made_of_the_split(spark):
    def supplied(split):
        assert "tokens" in split.columns and "MapInArrow" not in split._jdf.queryExecution().executedPlan().toString()
        return em.min_count_vocab(split, 1).select("term", F.array(F.length("term") * 1.0, F.lit(1.0)).alias("vector"), "n_occ")
    out = run_model(corpus(spark), "baseline", word_vectors=supplied, n_clusters=1, keep_p=0.5)
    given = em.min_count_vocab(out["split"], 1).count()
    assert out["predictions"].count() == out["split"].where("split = 'unlabeled'").count() and given > 7


def test_all_mixtures_at_once():
    rng = np.random.default_rng(1)
    mixtures = []
    for _ in range(3):
        f = rng.normal(size=(2, 4, 4))
        f[:, np.arange(4), np.arange(4)] = np.abs(f[:, np.arange(4), np.arange(4)]) + 1
        mixtures.append(mx.Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 4)), np.triu(f)))
    x = rng.normal(size=(50, 4))
    p, ll = mx.expected_of_all(x, *mx.stacked_mixtures(mixtures))
    for r, m in enumerate(mixtures):
        q, one = m.expected(x)
        assert p[r].T == pytest.approx(q) and ll[r] == pytest.approx(one)


def test_texts_are_split_at_a_plain_blank(spark):
    df = spark.createDataFrame([(" a\t\nb  c d ",), (None,)], "s string").select(tx.tokenize(F.col("s")).alias("t"))
    assert tx.BLANKS_PATTERN not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in df.collect()] == [["a", "b", "c", "d"], []]
