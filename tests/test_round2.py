"""Cases that earlier versions got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import clusters as cl
from weaklabel.operators import embeddings as em
from weaklabel.operators import similarity as sim
from weaklabel.plans.runner import run_model, word_vectors_for
from weaklabel.sources.corpus import read_text_vectors


def test_blocks_with_gapped_indices_and_ties(spark):
    rng = np.random.default_rng(0)
    idx = [1, 2, 5, 9, 40, 41, 70]
    mat = rng.normal(size=(7, 4))
    mat[5] = mat[2] * 2                                   # a tie across blocks: the lower index wins
    classes = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in zip(idx, mat)], "class_idx int, label string, vector array<double>")
    docs = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(40)] + [(99, None), (100, mat[2].tolist())], "doc_id bigint, vector array<double>")
    whole = sorted(map(tuple, sim.classify(docs, classes).select("doc_id", "class_idx", "best_label").collect()))
    top = sorted(map(tuple, sim.cosine_topk(docs, classes, 5).select("doc_id", "rank", "class_idx").collect()))
    assert (100, 5, "c5") in whole and len(top) == 41 * 5
    for limit in (32, 64, 96):
        assert sorted(map(tuple, sim.classify(docs, classes, max_broadcast_bytes=limit).select("doc_id", "class_idx", "best_label").collect())) == whole
        assert sorted(map(tuple, sim.cosine_topk(docs, classes, 5, max_broadcast_bytes=limit).select("doc_id", "rank", "class_idx").collect())) == top
    assert sim.cosine_topk(docs, classes.limit(0), 5).count() == 0


def test_tiles_equal_one_product(monkeypatch):
    rng = np.random.default_rng(1)
    x, m = rng.normal(size=(23, 5)), rng.normal(size=(17, 5))
    m[11] = m[3]
    order = np.argsort(-(x @ m.T), axis=1, kind="stable")
    monkeypatch.setattr(sim, "TILE", 4)
    for k in (1, 3, 30):
        assert (sim._tops(x, m, k)[1] == order[:, :k]).all()


def test_text_vectors_header_blanks_and_one_dimension(spark, tmp_path):
    def read(text):
        f = tmp_path / f"v{abs(hash(text))}.txt"
        f.write_text(text)
        return {r.term: r.vector for r in read_text_vectors(spark, str(f)).collect()}
    assert read("a 1.5\nb 2\n") == {"a": [1.5], "b": [2.0]}
    assert read("2 3\nnew york 1 2 3\na 4 5 6\n") == {"new york": [1.0, 2.0, 3.0], "a": [4.0, 5.0, 6.0]}
    assert read("a 4 5 6\nnew york 1 2 3\n") == {"new york": [1.0, 2.0, 3.0], "a": [4.0, 5.0, 6.0]}
    assert read("") == {}
    with pytest.raises(Exception, match="fewer than 3 numbers"):
        read("1 3\na 4 5\n")


def test_stripped_occurrences_count_once(spark):
    words = ["new_york"] * 6 + ["abc"] * 3 + ["abc_"] * 2 + ["_"] * 9
    docs = spark.createDataFrame([(1, words)], "doc_id bigint, tokens array<string>")
    got = word_vectors_for(docs, {"vectors": "contextual", "min_occurrence": 5}, pieces_of=lambda w: [3],
                           encode=lambda chunks: [np.ones((len(c), 2)) for c in chunks], dim=2)
    assert {r.term: r.n_occ for r in got.collect()} == {"newyork": 6, "abc": 5}


def test_lookup_falls_back_to_stem_and_pieces(spark):
    wv = spark.createDataFrame([("run", [1.0, 0.0], 3), ("fast", [0.0, 1.0], 3)], "term string, vector array<double>, n_occ bigint")
    docs = spark.createDataFrame([(1, ["running"]), (2, ["run_fast"]), (3, ["walks"])], "doc_id bigint, tokens array<string>")
    found = em.resolved_vectors([docs.select(F.explode("tokens").alias("term"))], wv)
    got = {r.doc_id: r.vector for r in em.doc_vectors(docs, found).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.5, 0.5], 3: None}


def test_mixture_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, vector array<double>")
    assert cl.gmm(empty, 3).count() == 0


def test_prepare_sentence_carries_over():
    pos, chunks = em.prepare_sentence(["a", "b", "c", "d"], lambda w: [ord(w)] * 2, max_pieces=5, carry=1)
    assert chunks == [[0, 97, 97, 98, 98, 1], [0, 98, 99, 99, 100, 100, 1]]
    assert pos == [(0, 0, 2), (0, 2, 4), (1, 1, 3), (1, 3, 5)]
    assert em.prepare_sentence([], lambda w: [1]) == ([], [[0, 1]])


def test_run_refuses_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "c d", "y")], "doc_id bigint, sentence string, label string")
    with pytest.raises(ValueError, match="duplicate doc_id"):
        run_model(df, "test")
