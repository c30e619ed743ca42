"""End-to-end run (P1-P4): corpus in, predictions and scores out.

One function, ``run_model``, with presets for the reference's three runs.
Each stage's table is written once, to the shared checkpoint folder or to a
store that later runs read, because every later step reads it and the fits make
many passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters as cl
from ..operators import embeddings as em
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import naming as nm
from ..operators import similarity as sim
from ..operators import terms as tm
from ..operators.cbow import train_cbow
from ..operators.preprocess import prepare_corpus
from ..session import cut_lineage
from ..sources.corpus import Stages, assert_unique_ids, corpus_statistics

PRESETS = {
    # the reference's run on its test data
    "test": dict(remove_punctuation=True, remove_stopwords=False, bottom_p=0.5, full_k=1, keep_p=0.6,
                 seed=42, seed_k=3, strict=True, vectors="word2vec", n_clusters=1, pca_dim=None,
                 w2v=dict(vector_size=16, epochs=2, window=3, min_count=1)),
    # baseline model on a full dataset
    "baseline": dict(remove_punctuation=True, remove_stopwords=True, bottom_p=0.5, full_k=5, keep_p=0.1,
                     seed=42, seed_k=10, strict=False, vectors="word2vec", n_clusters=5, pca_dim=None,
                     w2v=dict(vector_size=64, alpha=0.01, window=10, min_count=10, seed=42, epochs=2)),
    # final model: contextual vectors from a caller's encoder, PCA to 128
    "final": dict(remove_punctuation=True, remove_stopwords=True, bottom_p=0.5, full_k=5, keep_p=0.1,
                  seed=42, seed_k=10, strict=False, vectors="contextual", n_clusters=5, pca_dim=128,
                  min_occurrence=5),
}


def prepare(corpus: DataFrame, cfg: dict) -> DataFrame:
    """Preprocessing and the missing-label split."""
    prepared = prepare_corpus(corpus, cfg.get("remove_punctuation", True), cfg.get("remove_stopwords", True),
                              cfg.get("stem", False), cfg.get("lemmatize", False),
                              stopwords=cfg.get("stopwords"), stemmer=cfg.get("stemmer"),
                              lemmas=cfg.get("lemmas"), dictionary=cfg.get("dictionary"), exceptions=cfg.get("exceptions"))
    return lb.label_split(prepared, cfg["bottom_p"], cfg["full_k"], cfg["keep_p"], cfg["seed"])


def word_vectors_for(split: DataFrame, cfg: dict, word_vectors=None,
                     pieces_of=None, encode=None, dim: int | None = None) -> DataFrame:
    if word_vectors is not None:
        return word_vectors(split) if callable(word_vectors) else word_vectors
    if cfg["vectors"] == "word2vec":
        train = em.train_word_vectors if cfg.get("skip_gram") else train_cbow
        return train(split, **cfg.get("w2v", {}))
    if cfg["vectors"] == "contextual":
        if encode is None or pieces_of is None or dim is None:
            raise ValueError("contextual vectors need pieces_of, encode and dim")
        occ = em.contextual_vectors(split, pieces_of, encode, dim)
        # words are added up as they stand, so that a word is stripped once and not at every occurrence
        return em.static_vectors(em.strip_terms(em.collect_vocab(occ, dim)), cfg.get("min_occurrence", 5), dim)
    raise ValueError(f"unknown vectors {cfg['vectors']!r}")


def run_model(corpus: DataFrame, preset: str | dict = "baseline", threshold: float = 0.1,
              word_vectors=None, pieces_of=None, encode=None, dim: int | None = None,
              generate=None, store: str | None = None, **overrides) -> dict[str, DataFrame]:
    """P1-P3. ``corpus(doc_id, sentence, label)``. Returns the intermediate
    and final tables: split, seeds, vectors, scored, clusters, names,
    predictions, and the two score tables. ``word_vectors`` is a table or a
    function that makes one of the split corpus, whose tokens are written.

    With ``store``, a shared folder, every stage is kept there and a later run
    on the same input with the same settings reads it back (S4); ``written``
    in the result lists the stages that this run computed."""
    cfg = dict(PRESETS[preset] if isinstance(preset, str) else preset)
    cfg.update(overrides)
    stage = Stages(corpus.sparkSession, store, corpus)
    text = ("remove_punctuation", "remove_stopwords", "stem", "lemmatize", "stopwords", "stemmer", "lemmas", "dictionary", "exceptions",
            "bottom_p", "full_k", "keep_p", "seed")
    split = stage("split", ["source"], {k: cfg.get(k) for k in text}, lambda: prepare(assert_unique_ids(corpus), cfg))
    existing = stage("existing", ["split"], {}, lambda: lb.existing_labels(split))
    seeds = stage("seeds", ["split"], {k: cfg.get(k) for k in ("seed_k", "strict", "stopwords")},
                  lambda: tm.get_seed_words(split, cfg["seed_k"], cfg["strict"], cfg.get("stopwords")))
    train = {k: cfg.get(k) for k in ("vectors", "w2v", "skip_gram", "min_occurrence")}
    wv = stage("word_vectors", ["split"], dict(train, given=word_vectors, pieces_of=pieces_of, encode=encode, dim=dim),
               lambda: word_vectors_for(split, cfg, word_vectors, pieces_of, encode, dim))

    if cfg["vectors"] == "word2vec" and cfg.get("lookup", "word") == "word":
        trained = wv
        wv = stage("lookup", ["split", "seeds", "word_vectors"], {"stemmer": cfg.get("stemmer")},
                   lambda: em.resolved_vectors([split.select(F.explode_outer("tokens").alias("term")), seeds.select("term")],
                                               trained, cfg.get("stemmer")))
    found = "lookup" if "lookup" in stage.ids else "word_vectors"
    made: list[DataFrame] = []

    def vectors() -> list[DataFrame]:
        """Documents and classes, projected alike; made once, if at all."""
        if not made:
            pair = em.doc_vectors(split, wv, oov=cfg.get("oov", "skip")), em.class_vectors(seeds, wv, existing)
            if cfg.get("pca_dim"):
                pair = cut_lineage(pair[0], "plain-doc-vectors"), pair[1]      # read by the fit and the projection
                model = cl.pca_fit(pair[0], cfg["pca_dim"])      # fitted on labelled + unlabelled documents
                pair = [cl.pca_project(model, t) for t in pair]
            made.extend(pair)
        return made
    reduced = {k: cfg.get(k) for k in ("oov", "pca_dim")}
    docs = stage("doc_vectors", ["split", "seeds", found], reduced, lambda: vectors()[0])
    classes = stage("class_vectors", ["split", "seeds", found], reduced, lambda: vectors()[1])
    missing = existing.join(classes.select("label"), "label", "left_anti")

    unl = split.where(F.col("split") == "unlabeled").select("doc_id", "label", "tokens")
    scored = stage("scored", ["doc_vectors", "class_vectors", "existing"], {"threshold": threshold}, lambda: sim.confidence_split(
        sim.classify(docs.join(unl.select("doc_id"), "doc_id"), classes), threshold))
    # texts are shuffled as strings, which take a part of the disk that lists of words take
    judged = tx.packed_join(unl, scored.select("doc_id", "vector", "max_sim", "class_idx", "best_label", "is_confident"),
                            "left").fillna(False, ["is_confident"])
    unconf = judged.where(~F.col("is_confident"))
    with_vectors = unconf.select("doc_id", "vector")
    clustered = stage("clusters", ["scored"], {"n_clusters": cfg["n_clusters"]}, lambda: cl.gmm(with_vectors, cfg["n_clusters"]))
    unconf = unconf.drop("vector").join(clustered.select("doc_id", "cluster", "prob"), "doc_id", "left")

    def named():
        if generate is None:
            return tm.cluster_names(unconf.select("doc_id", "tokens", "cluster"), "cluster", 8,
                                    stopwords=cfg.get("stopwords"))
        samples = cl.cluster_samples(unconf.where(F.col("cluster").isNotNull()), k=cfg.get("sample_k", 25))
        return nm.generate_cluster_labels(samples, unconf, existing, generate, answers=f"{store.rstrip('/')}/answers" if store else None)
    names = stage("names", ["split", "existing", "clusters"], {"generate": generate, "sample_k": cfg.get("sample_k"),
                                                               "stopwords": cfg.get("stopwords")}, named)
    new = nm.new_class_predictions(unconf, names)
    preds = stage("predictions", ["split", "scored", "names"], {}, lambda: nm.full_predictions(judged.where("is_confident"), new))
    scored_preds = mt.attach_truth(preds.select("doc_id", "prediction", "is_confident"), unl, check=True)
    return dict(
        split=split, existing=existing, seeds=seeds, word_vectors=wv, doc_vectors=docs,
        class_vectors=classes, missing_classes=missing, scored=scored,
        histogram=sim.similarity_histogram(scored), clusters=clustered, names=names,
        new_classes=new, predictions=preds,
        new_label_metrics=mt.new_label_metrics(scored_preds, existing),
        f1_existing=mt.f1_existing(scored_preds, existing),
        statistics=_stats(split), written=stage.written,
    )


def _stats(split: DataFrame) -> DataFrame:
    return corpus_statistics(split)
