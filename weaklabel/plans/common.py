"""Shared fixed settings and the corpus chain used by the registered checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import labels as lb
from ..operators.preprocess import prepare_corpus
from ..session import cut_lineage
from ..sources import fixtures as fx

# Settings of the reference's test run (stopwords kept, one class removed,
# 60 % of each other class labelled).
LANG_SPLIT = dict(bottom_p=0.5, full_k=1, keep_p=0.6, seed=42)
SEED_K = 10
VEC_DIM = 16
MIN_COUNT = 5
THRESHOLD = 0.35


def drop_final_s(word: str) -> str:
    """The checks' stemmer (matches ``sqlparts.stem``)."""
    return word[:-1] if word.endswith("s") else word


def e6(c) -> F.Column:
    """Scaled score column (matches ``sqlparts.e6``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1e6)).cast("bigint")


def e6_nan(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(e6(c))


def lang_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized language corpus, written once: every later step explodes or
    re-reads the tokens, and reading them back is cheaper than re-deriving
    them inside each generator."""
    return cut_lineage(prepare_corpus(fx.corpus_lang(spark, sf_dir), remove_stopwords=False), "prepared")


def lang_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_split(lang_prepared(spark, sf_dir), **LANG_SPLIT)


class _Chain:
    """The classification chain on the language corpus, built on demand:
    a check that needs only the vocabulary never runs the classifier. Each
    step that later steps reuse is written once (lineage cut)."""

    def __init__(self, spark: SparkSession, sf_dir: str, threshold: float | None):
        self.spark, self.sf_dir = spark, sf_dir
        self.threshold = THRESHOLD if threshold is None else threshold
        self._memo: dict = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = getattr(self, "_" + name)()
        return self._memo[name]

    def _split(self):
        # the plan reads ids and labels only, so tokens are made once, by the write
        corpus = prepare_corpus(fx.corpus_lang(self.spark, self.sf_dir), remove_stopwords=False)
        return cut_lineage(lb.label_split(corpus, **LANG_SPLIT), "split")

    def _existing(self):
        return cut_lineage(lb.existing_labels(self["split"]), "existing")

    def _seeds(self):
        from ..operators import terms as tm
        return cut_lineage(tm.get_seed_words(self["split"], SEED_K, False), "seeds")

    def _vocab(self):
        from ..operators import embeddings as em
        return em.vocab_of_counts(self["token_counts"], MIN_COUNT)

    def _token_counts(self):
        from ..operators import embeddings as em
        return cut_lineage(em.token_counts(self["split"]), "token-counts")

    def _word_vectors(self):
        return cut_lineage(fx.hash_word_vectors(self["vocab"], VEC_DIM), "word-vectors")

    def _lookup_vectors(self):
        from ..operators import embeddings as em
        terms = [self["token_counts"].select(F.col("token").alias("term")), self["seeds"].select("term")]
        return cut_lineage(em.resolved_vectors(terms, self["word_vectors"], drop_final_s), "lookup-vectors")

    def _unlabeled(self):
        return self["split"].where("split = 'unlabeled'")

    def _doc_vectors(self):
        from ..operators import embeddings as em
        return cut_lineage(em.doc_vectors(self["unlabeled"], self["lookup_vectors"]), "doc-vectors")

    def _class_vectors(self):
        from ..operators import embeddings as em
        return em.class_vectors(self["seeds"], self["lookup_vectors"], self["existing"])

    def _scored(self):
        from ..operators import similarity as sim
        scored = sim.classify(self["doc_vectors"], self["class_vectors"])
        return cut_lineage(sim.confidence_split(scored, self.threshold), "scored")

    def _judged(self):
        docs = self["unlabeled"].select("doc_id", "label", "tokens")
        s = self["scored"].select("doc_id", "max_sim", "class_idx", "best_label", "is_confident")
        return cut_lineage(tx.packed_join(docs, s), "judged")

    def _unconfident(self):
        return self["judged"].where(~F.col("is_confident")).withColumn("cluster", F.col("class_idx"))

    def _names(self):
        from ..operators import terms as tm
        return cut_lineage(tm.cluster_names(self["unconfident"].select("doc_id", "tokens", "cluster"),
                                            "cluster", 8), "names")

    def _new_classes(self):
        from ..operators import naming as nm
        return nm.new_class_predictions(self["unconfident"], self["names"])

    def _predictions(self):
        from ..operators import naming as nm
        return nm.full_predictions(self["judged"].where("is_confident"), self["new_classes"])


def lang_chain(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> _Chain:
    """The whole classification chain on the language corpus with word
    vectors SQL can repeat (hash vectors over the >= MIN_COUNT vocabulary).
    Unconfident documents are grouped by their nearest class, a grouping
    SQL can repeat, in place of the mixture model (which the ML checks run).
    Steps are computed when first asked for."""
    return _Chain(spark, sf_dir, threshold)
