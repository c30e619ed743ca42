import math

import pytest
from pyspark.sql import functions as F

from weaklabel.operators import terms as tm
from weaklabel.operators.preprocess import prepare_corpus


@pytest.fixture(scope="module")
def docs_terms(mini_corpus):
    return tm.with_terms(prepare_corpus(mini_corpus, remove_stopwords=False))


def _scores(df):
    return {(r.label, r.term): r.score for r in df.collect()}


def test_class_tfidf_values(docs_terms):
    s = _scores(tm.class_tfidf(docs_terms))
    expect = {("a", "apple"): 0.949519, ("a", "cherry"): 0.249701, ("a", "banana"): 0.189904,
              ("b", "dog"): 0.922383, ("b", "eel"): 0.307461, ("b", "banana"): 0.233832,
              ("c", "fig"): 0.795961, ("c", "apple"): 0.605349}
    assert set(s) == set(expect)
    for k, v in expect.items():
        assert s[k] == pytest.approx(v, abs=1e-6)


def test_seed_words_strict_k2(docs_terms):
    seeds = tm.seed_words(tm.top_terms(tm.class_tfidf(docs_terms), 2, strict=True), 2)
    got = {}
    for r in seeds.orderBy("label", "rank").collect():
        got.setdefault(r.label, []).append(r.term)
    assert got == {"a": ["cherry"], "b": ["dog", "eel"], "c": ["fig"]}


def test_li_ctfidf_values_and_nan(docs_terms):
    rows = {(r.label, r.term): r for r in tm.li_ctfidf(docs_terms, nan_first=True).collect()}
    assert math.isnan(rows[("a", "apple")].score) and math.isnan(rows[("c", "apple")].score)
    assert rows[("a", "apple")].idf == pytest.approx(-0.182322, abs=1e-6)
    assert rows[("a", "banana")].score == pytest.approx(0.596008, abs=1e-6)
    assert rows[("b", "dog")].ctf == pytest.approx(0.905148, abs=1e-6)
    assert rows[("c", "fig")].score == pytest.approx(1.070202, abs=1e-6)
    dropped = {(r.label, r.term) for r in tm.li_ctfidf(docs_terms).collect()}
    assert ("a", "apple") not in dropped and ("a", "cherry") in dropped


@pytest.mark.parametrize("nan_first", [False, True])
def test_cluster_names_both_modes(spark, mini_corpus, nan_first):
    d = prepare_corpus(mini_corpus, remove_stopwords=False).withColumnRenamed("label", "cluster")
    names = dict(tm.cluster_names(d, "cluster", 8, nan_first=nan_first).collect())
    assert names == {"a": "cherry", "b": "dog", "c": "fig"}


def test_empty_cluster_list_named_by_id(spark):
    d = spark.createDataFrame([(1, ["a"], 7)], "doc_id bigint, tokens array<string>, cluster int")
    assert tm.cluster_names(d, "cluster").first().name == "cluster_7"


def test_doc_term_counts_sort_without_a_comparing_function(spark):
    docs = spark.createDataFrame([(1, "x", ["b", "a", "b"]), (2, "y", []), (3, "y", None)], "doc_id bigint, label string, terms array<string>")
    out = tm.doc_term_counts(docs)
    assert {(r.doc_id, r.term, r.n) for r in out.collect()} == {(1, "a", 1), (1, "b", 2)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "sort_array" in plan and "array_sort" not in plan
