import pytest
from pyspark.sql import functions as F

from weaklabel.functions.vectors import hash_vector
from weaklabel.operators import embeddings as em


def test_hash_vector_matches_fixture(spark):
    v = spark.range(1).select(hash_vector(F.lit("apple"), 3)).first()[0]
    assert v == pytest.approx([-0.48038652492687106, -0.03780683106742799, 0.24151870841160417], abs=1e-15)


def test_chunk_closed_form_matches_fold(spark):
    pos = spark.range(1).select(em.chunk_positions(F.lit(1000))).first()[0]
    fold, chunks = em.prepare_sentence([f"w{i}" for i in range(1000)], lambda w: [7])
    assert [(p.chunk, p.start, p.end) for p in pos] == fold
    assert [len(c) - 2 for c in chunks] == [510, 510, 490]
    assert fold[509] == (0, 509, 510) and fold[510] == (1, 255, 256) and fold[765] == (2, 255, 256)
    assert spark.range(1).select(em.n_chunks(F.lit(1000)), em.n_chunks(F.lit(0))).first() == (3, 1)


def test_lookup_compound_and_missing(spark):
    wv = spark.createDataFrame([("new", [1.0, 0.0], 1), ("york", [0.0, 1.0], 1)],
                               "term string, vector array<double>, n_occ bigint")
    terms = spark.createDataFrame([("new_york",), ("new",), ("zzz",)], "term string")
    got = dict(em.word_lookup(terms, wv).collect())
    assert got["new_york"] == [0.5, 0.5] and got["new"] == [1.0, 0.0] and got["zzz"] is None


def test_doc_vectors_modes(spark):
    wv = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 2.0], 1)],
                               "term string, vector array<double>, n_occ bigint")
    docs = spark.createDataFrame([(1, ["a", "a", "b", "q"]), (2, ["q"]), (3, [])], "doc_id bigint, tokens array<string>")
    skip = dict(em.doc_vectors(docs, wv).collect())
    zero = dict(em.doc_vectors(docs, wv, oov="zero").collect())
    assert skip[1] == pytest.approx([2 / 3, 2 / 3]) and skip[2] is None and skip[3] is None
    assert zero[1] == pytest.approx([0.5, 0.5]) and zero[2] == [0.0, 0.0] and zero[3] is None


def test_class_vectors_skip_missing(spark):
    wv = spark.createDataFrame([("a", [1.0, 0.0], 1)], "term string, vector array<double>, n_occ bigint")
    seeds = spark.createDataFrame([("x", "a"), ("y", "zzz")], "label string, term string")
    classes = spark.createDataFrame([("x", 0), ("y", 1)], "label string, class_idx int")
    cv = em.class_vectors(seeds, wv, classes)
    assert [r.label for r in cv.collect()] == ["x"]
    assert [r.label for r in em.missing_classes(classes, cv).collect()] == ["y"]


def test_static_vectors_min_occurrence(spark):
    occ = spark.createDataFrame([(1, i, "a", [float(i), 1.0]) for i in range(5)] + [(2, 0, "b", [1.0, 1.0])],
                                "doc_id bigint, pos int, term string, vector array<double>")
    st = {r.term: (r.vector, r.n_occ) for r in em.static_vectors(occ, 5).collect()}
    assert st == {"a": ([2.0, 1.0], 5)}


def test_word2vec_takes_whole_documents(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    from weaklabel.operators import embeddings
    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: (seen.append(self.getMaxSentenceLength()), fit(self, df))[1])
    docs = spark.createDataFrame([(["a", "b"] * 600,), (["a"],), (None,)], "tokens array<string>").where("tokens is not null")
    assert embeddings.train_word_vectors(docs, vector_size=2, epochs=1, num_partitions=1).count() == 2
    assert embeddings.train_word_vectors(docs, vector_size=2, epochs=1, num_partitions=1, max_sentence=50).count() == 2
    assert seen == [1200, 50]


def test_static_vectors_of_known_length_are_hashed_not_sorted(spark):
    rows = [(f"w{i % 300}", [float(i), i / 7]) for i in range(3000)] + [("none", None)]
    occ = spark.createDataFrame(rows, "term string, vector array<double>")
    by_place, plain = em.static_vectors(occ, 5, 2), em.static_vectors(occ, 5)
    assert "ObjectHashAggregate" not in by_place._jdf.queryExecution().executedPlan().toString()
    want = {r.term: r for r in plain.collect()}
    got = by_place.collect()
    assert len(got) == 300 == len(want)
    assert all(r.n_occ == want[r.term].n_occ and r.vector == pytest.approx(want[r.term].vector) for r in got)
    with pytest.raises(Exception, match="has not 3 numbers"):
        em.static_vectors(occ, 5, 3).collect()


def test_doc_vectors_look_terms_up_without_an_object_a_term(spark, monkeypatch):
    kept = []
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: kept.append(x) or real(x))
    wv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "term string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", None, "b", "x", "a"]), (2, []), (3, None), (4, ["x"])], "doc_id bigint, tokens array<string>")
    got = dict(em.doc_vectors(docs, wv).collect())
    assert got[1] == pytest.approx([2 / 3, 1.0]) and got[2] is got[3] is got[4] is None
    assert not any(isinstance(part, dict) for value in kept if isinstance(value, tuple) for part in value)
