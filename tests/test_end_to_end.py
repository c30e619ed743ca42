"""Steps of the final run: words cut once, vectors added up and written once."""

import numpy as np
import pytest

from weaklabel import session
from weaklabel.operators import embeddings as em
from weaklabel.plans.runner import run_model


def cuts(spark):
    return [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._CUTS.get(spark.sparkContext.applicationId, [])]


def encoder():
    """Place and id of every position; shipped to workers by value."""
    def by_id(chunks):
        return [np.stack([np.arange(len(c)), c], axis=1).astype(float) for c in chunks]
    return by_id


def test_a_batch_cuts_a_word_once(spark):
    by_id = encoder()

    def counting():
        calls = []

        def pieces(word):
            calls.append(word)
            return [len(calls)]
        return pieces
    docs = spark.createDataFrame([(1, ["a", "a", "b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>").coalesce(1)
    got = {(r.doc_id, r.pos): r.vector[1] for r in em.contextual_vectors(docs, counting(), by_id, 2).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 2.0, (1, 3): 1.0, (2, 0): 2.0}


def test_contextual_vectors_of_words_of_any_pieces(spark):
    by_id = encoder()

    def pieces(word):
        return [int(c) for c in word.strip("x")]
    texts = {1: ["12", "3", "x", "456", "7", "89"], 2: [], 3: None, 4: ["x"], 5: ["1"] * 7, 6: ["123", "", "45"] * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>").coalesce(1)
    want = {}
    for doc, words in texts.items():
        positions, chunks = em.prepare_sentence(words or [], pieces, 5, 2)
        for pos, (word, (c, a, b)) in enumerate(zip(words or [], positions, strict=True)):
            want[doc, pos] = word, np.mean(by_id(chunks)[c][1:-1][a:b], axis=0) if b > a else np.zeros(2)
    got = em.contextual_vectors(docs, pieces, by_id, 2, max_pieces=5, carry=2, batch_chunks=3, frame_rows=4).collect()
    assert {(r.doc_id, r.pos) for r in got} == set(want) and len(got) == len(want)
    assert all(r.term == want[r.doc_id, r.pos][0] and r.vector == pytest.approx(want[r.doc_id, r.pos][1]) for r in got)


def test_sums_of_words_give_the_static_vectors(spark):
    occ = spark.createDataFrame([(w, [float(i), 1.0 / (i + 1)]) for i, w in enumerate(["a", "a.", "b", "!", "a", "b-", "c", None])],
                                "term string, vector array<double>")
    want = {r.term: r for r in em.static_vectors(em.strip_terms(occ), 2, 2).collect()}
    got = em.static_vectors(em.strip_terms(em.collect_vocab(occ, 2)), 2, 2).collect()
    assert {r.term for r in got} == set(want) == {"a", "b"}
    assert all(r.n_occ == want[r.term].n_occ and r.vector == pytest.approx(want[r.term].vector) for r in got)


def corpus(spark):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} word{i % 11}, and more", f"l{i % 6}") for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label string")


def test_vectors_are_written_before_the_projection(spark):
    before = len(cuts(spark))
    run_model(corpus(spark), "final", pieces_of=lambda w: [2 + ord(w[-1])], encode=encoder(), dim=2, pca_dim=2, n_clusters=1, keep_p=0.5)
    assert cuts(spark)[before:].count("plain-doc-vectors") == 1
