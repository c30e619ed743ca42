import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import embeddings as em
from weaklabel.operators import naming as nm
from weaklabel.plans.common import lang_chain
from weaklabel.plans.runner import run_model
from weaklabel.sources import corpus as src
from weaklabel.sources.fixtures import corpus_lang

SF = "/root/testdata/sf0.001"
STUB_DIM = 16


def stubs():
    """Stand-ins for a caller's models, shipped to workers by value."""
    def stub_pieces(word):
        """Four-character pieces, ids from CRC32."""
        return [2 + zlib.crc32(word[i:i + 4].encode()) % 5000 for i in range(0, max(len(word), 1), 4)]

    def stub_encode(chunks):
        """A fixed random row per id, mixed with the running mean of the chunk."""
        out = []
        for ids in chunks:
            rows = np.stack([np.random.default_rng(i).standard_normal(STUB_DIM) for i in ids])
            out.append(0.7 * rows + 0.3 * np.cumsum(rows, axis=0) / np.arange(1, len(ids) + 1)[:, None])
        return out

    def stub_generate(prompts):
        """The longest word of the prompt's last line, quoted and with a mark."""
        lasts = [(p.strip().splitlines() or ["none"])[-1].split() for p in prompts]
        return [f"\"{max(words, key=len).capitalize()}\"!" for words in lasts]
    return stub_pieces, stub_encode, stub_generate


def test_final_preset_with_callables(spark):
    stub_pieces, stub_encode, stub_generate = stubs()
    out = run_model(corpus_lang(spark, SF), "final", threshold=0.2, pieces_of=stub_pieces,
                    encode=stub_encode, dim=STUB_DIM, pca_dim=4, n_clusters=2, generate=stub_generate,
                    sample_k=3)
    preds = out["predictions"]
    n_unl = out["split"].where("split = 'unlabeled'").count()
    assert preds.count() == n_unl
    assert out["f1_existing"].count() == 1 and out["new_label_metrics"].count() == 1
    names = [r.name for r in out["names"].collect()]
    assert names and all(n and n.isalnum() for n in names)


def test_baseline_preset_with_five_components(spark):
    """A supplied vector table, five components; then a threshold that leaves
    no document unconfident."""
    wv = lang_chain(spark, SF)["word_vectors"]
    out = run_model(corpus_lang(spark, SF), "baseline", threshold=2.0, word_vectors=wv, pca_dim=4)
    preds = out["predictions"].collect()
    assert len(preds) == out["split"].where("split = 'unlabeled'").count()
    assert not any(r.is_confident for r in preds) and all(r.text is not None for r in preds)
    assert {r.cluster for r in out["clusters"].collect()} <= {0, 1, 2, 3, 4, None}
    sure = run_model(corpus_lang(spark, SF).where("length(sentence) > 200"), "baseline", threshold=-1.0, word_vectors=wv)
    assert sure["clusters"].where("cluster is not null").count() == 0
    assert sure["predictions"].where("not is_confident and text <> ''").count() == 0


def test_vectors_alike_with_and_without_broadcast(spark):
    wv = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -4.0])], "term string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, []), (3, ["zz"]), (4, None), (5, [None, "b"])],
                                 "doc_id bigint, tokens array<string>")
    for oov, want in (("skip", {1: [5 / 3, 0.0], 2: None, 3: None, 4: None, 5: [3.0, -4.0]}),
                      ("zero", {1: [1.25, 0.0], 2: None, 3: [0.0, 0.0], 4: None, 5: [1.5, -2.0]})):
        for limit in (1 << 20, 1):
            got = {r.doc_id: r.vector for r in em.doc_vectors(docs, wv, oov, max_broadcast_bytes=limit).collect()}
            assert got.keys() == want.keys()
            assert all(g is w is None or g == pytest.approx(w) for g, w in ((got[k], want[k]) for k in want)), (oov, limit, got)
    plan = em.doc_vectors(docs, wv)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    none = em.doc_vectors(docs, wv.limit(0))
    assert none.where("vector is null").count() == 5


def test_vectors_in_blocks_shuffle_no_document(spark, monkeypatch):
    """Word vectors of many blocks: rows, repeated ids included, as from one
    broadcast, and no exchange over documents and words."""
    wv = spark.createDataFrame([(f"w{i}", [float(i), 1.0 / (i + 1), -1.0]) for i in range(50)], "term string, vector array<double>")
    docs = spark.createDataFrame([(i % 17 if i else None, [f"w{(i * j) % 60}" for j in range(i)]) for i in range(40)],
                                 "doc_id bigint, tokens array<string>")
    monkeypatch.setattr(em, "TOKENS_AT_ONCE", 100)

    def rows(df):
        return sorted(((r.doc_id, r.vector) for r in df.collect()), key=str)
    for oov in ("skip", "zero"):
        one, many = em.doc_vectors(docs, wv, oov), em.doc_vectors(docs, wv, oov, max_broadcast_bytes=1_000)
        assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
        got, want = rows(many.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9)))), rows(
            one.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9))))
        assert got == want and len(got) == 40


def test_completions_must_match_prompts(spark):
    prompts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, prompt string")
    with pytest.raises(Exception, match="answers for"):
        nm.complete(prompts, lambda p: [], ["id"]).collect()


def test_lemmas_alike_with_and_without_broadcast(spark):
    from weaklabel.operators.preprocess import lemmatize_tokens
    docs = spark.createDataFrame([(1, "x", ["cats", "run"]), (2, "y", []), (3, "z", ["dogs", "cats", "cats"])],
                                 "doc_id bigint, label string, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    want = {1: ["cat", "run"], 2: [], 3: ["dog", "cat", "cat"]}
    for limit in (1 << 20, 0):
        assert {r.doc_id: r.tokens for r in lemmatize_tokens(docs, lemmas, limit).collect()} == want


def test_word_vector_files(spark, tmp_path):
    wv = spark.createDataFrame([("a", [0.5, 1.0], 3)], "term string, vector array<double>, n_occ bigint")
    path = str(tmp_path / "wv")
    src.save_word_vectors(wv, path, {"dim": 2})
    back = src.load_word_vectors(spark, path).first()
    assert (back.term, back.vector, back.n_occ) == ("a", [0.5, 1.0], 3)
