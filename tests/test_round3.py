"""Steps shared by the checks: tokens are made, written and counted once."""

import pyarrow as pa
from pyspark.sql import functions as F

from weaklabel import session
from weaklabel.functions import text as tx
from weaklabel.operators import metrics as mt
from weaklabel.operators import terms as tm
from weaklabel.operators.preprocess import lemmatize_tokens, looked_up_terms
from weaklabel.plans import checks_ml
from weaklabel.plans.common import lang_chain

SF = "/root/testdata/sf0.001"


def cuts(spark):
    return [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._CUTS.get(spark.sparkContext.applicationId, [])]


def test_chain_writes_and_counts_tokens_once(spark):
    before = len(cuts(spark))
    lang_chain(spark, SF)["lookup_vectors"].count()
    names = cuts(spark)[before:]
    assert "prepared" not in names and names.count("split") == names.count("token-counts") == 1


def test_supplied_vectors_need_no_split(spark):
    before = len(cuts(spark))
    got = checks_ml._word_vectors(spark, SF)
    assert cuts(spark)[before:] == ["word-vectors"]
    want = lang_chain(spark, SF)["word_vectors"]
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_analyzer_runs_once(spark):
    rows = spark.createDataFrame([("a", 1, ["ab", "cd", "ab"]), ("a", 2, []), ("b", 3, None)], "label string, doc_id long, tokens array<string>")
    for df in (mt.label_term_frequencies(rows, "x"), tm.class_tfidf(tm.with_terms(rows))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        scans = plan.count("LogicalRDD")
        assert plan.count(tx.NON_WORD_PATTERN) <= scans
    got = {(r.label, r.term): r.n for r in mt.label_term_frequencies(rows, "x").collect()}
    assert got == {("a", "ab"): 2, ("a", "cd"): 1}


def test_li_counts(spark):
    rows = spark.createDataFrame([("a", 1, ["ab", "cd", "ab"]), ("a", 2, ["ab"]), ("a", 3, []), ("a", 4, None)],
                                 "label string, doc_id long, tokens array<string>")
    got = {r.term: round(r.li, 6) for r in tm.li_ctfidf(tm.with_terms(rows), nan_first=True).collect()}
    assert got == {"ab": 0.5, "cd": 0.25}


def test_contractions_and_blanks(spark):
    df = spark.createDataFrame([(1, " I  cannot　stay "), (2, "plain words"), (3, None), (4, " ")], "i int, s string")
    got = {r.i: r.t for r in df.select("i", tx.tokenize(F.col("s")).alias("t")).collect()}
    assert got == {1: ["i", "can", "not", "stay"], 2: ["plain", "words"], 3: [], 4: []}


def test_lemmas_stay_in_arrow(spark):
    lists = pa.array([["a", "b", None], None, [], ["c", "a"]], pa.list_(pa.string())).slice(0)
    got = looked_up_terms(lists.slice(1), pa.array(["a", "c"]), pa.array(["x", "c"]))
    assert got.to_pylist() == [[], [], ["c", "x"]]
    assert looked_up_terms(lists, pa.array(["a"]), pa.array(["x"])).to_pylist()[0] == ["x", "b", None]
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 3 else None) for i in range(3_000)], "doc_id long, tokens array<string>").repartition(1)
    table = spark.createDataFrame([("a", "x")], "token string, lemma string")
    out = {r.doc_id: r.tokens for r in lemmatize_tokens(docs, table).collect()}
    assert out == {i: ["x", "b"] if i % 3 else [] for i in range(3_000)}
    none = spark.createDataFrame([], "token string, lemma string")
    assert {tuple(r.tokens) for r in lemmatize_tokens(docs, none).collect()} == {(), ("a", "b")}
