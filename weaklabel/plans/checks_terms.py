"""Checks for term weighting and seed words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms as tm
from . import sqlparts as S
from .common import SEED_K, e6, e6_nan, lang_prepared, lang_split
from .registry import register

P = S.LANG
SPLIT = S.corpus_ctes("lang") + S.split_ctes(P["bottom_p"], P["full_k"], P["keep_p"], P["seed"])
TFIDF = SPLIT + S.class_tfidf_ctes()


def _labeled_terms(spark, sf_dir):
    return tm.with_terms(lang_split(spark, sf_dir).where("split = 'labeled'"))


@register("doc_term_counts", S.with_(S.corpus_ctes("lang") + S.li_ctes("prepared"),
                                     "SELECT doc_id, label, term, n FROM li_dt"))
def doc_term_counts(spark, sf_dir):
    return tm.doc_term_counts(tm.with_terms(lang_prepared(spark, sf_dir)))


@register("concat_by_label", S.with_(SPLIT, """SELECT label, count(*) AS n_docs, sum(len(tokens)) AS n_tokens,
    length(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY doc_id)) AS n_chars
    FROM split WHERE split = 'labeled' GROUP BY label"""))
def concat_by_label(spark, sf_dir):
    return tm.class_documents(lang_split(spark, sf_dir).where("split = 'labeled'"))


@register("class_tfidf", S.with_(TFIDF, f"SELECT label, term, tf, df, {S.e6('score')} AS score_e6 FROM tfidf"))
def class_tfidf(spark, sf_dir):
    s = tm.class_tfidf(_labeled_terms(spark, sf_dir))
    return s.select("label", "term", "tf", "df", e6("score").alias("score_e6"))


@register("class_top_terms", S.with_(TFIDF + S.top_ctes("tfidf", SEED_K, False),
                                     f"SELECT label, term, CAST(rank AS INTEGER) AS rank, {S.e6('score')} AS score_e6 FROM top"))
def class_top_terms(spark, sf_dir):
    t = tm.top_terms(tm.class_tfidf(_labeled_terms(spark, sf_dir)), SEED_K, False)
    return t.select("label", "term", F.col("rank").cast("int"), e6("score").alias("score_e6"))


@register("seed_words", S.with_(TFIDF + S.top_ctes("tfidf", SEED_K, False) + S.seed_ctes("top", SEED_K),
                                f"SELECT label, term, CAST(rank AS INTEGER) AS rank, {S.e6('score')} AS score_e6 FROM seeds"))
def seed_words(spark, sf_dir):
    s = tm.get_seed_words(lang_split(spark, sf_dir), SEED_K, False)
    return s.select("label", "term", F.col("rank").cast("int"), e6("score").alias("score_e6"))


_WITH_LABEL = S.with_(TFIDF + S.top_ctes("tfidf", SEED_K, False) + [
    ("lists", """SELECT label, lower(label) AS term, 0 AS rank FROM (SELECT DISTINCT label FROM top)
                 UNION ALL SELECT label, term, rank FROM top WHERE term <> lower(label)"""),
    ("counted", "SELECT *, count(*) OVER (PARTITION BY term) AS n_lists FROM lists"),
    ("others", f"""SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY rank) AS rank FROM counted
                   WHERE rank > 0 AND n_lists = 1 AND NOT list_contains({S.STOP}, term)
                     AND term NOT IN (SELECT DISTINCT label FROM top)"""),
], f"""SELECT label, term, 0 AS rank FROM lists WHERE rank = 0
       UNION ALL SELECT label, term, CAST(rank AS INTEGER) FROM others WHERE rank <= {SEED_K - 1}""")


@register("seed_words_with_label", _WITH_LABEL)
def seed_words_with_label(spark, sf_dir):
    top = tm.top_terms(tm.class_tfidf(_labeled_terms(spark, sf_dir)), SEED_K, False)
    s = tm.seed_words_with_label(top, SEED_K)
    return s.select("label", "term", F.col("rank").cast("int"))


@register("li_ctfidf", S.with_(S.corpus_ctes("lang") + S.li_ctes("prepared", nan_first=True),
                               f"""SELECT label, term, {S.e6('li')} AS li_e6, {S.e6('ctf')} AS ctf_e6,
                                   {S.e6('idf')} AS idf_e6, {S.e6_nan('score')} AS score_e6,
                                   isnan(score) AS is_nan FROM li"""))
def li_ctfidf(spark, sf_dir):
    s = tm.li_ctfidf(tm.with_terms(lang_prepared(spark, sf_dir)), nan_first=True)
    return s.select("label", "term", e6("li").alias("li_e6"), e6("ctf").alias("ctf_e6"),
                    e6("idf").alias("idf_e6"), e6_nan("score").alias("score_e6"),
                    F.isnan("score").alias("is_nan"))


@register("li_ctfidf_top", S.with_(S.corpus_ctes("lang") + S.li_ctes("prepared", nan_first=True)
                                   + S.top_ctes("li", 8, False) + S.seed_ctes("top", 8),
                                   "SELECT label, term, CAST(rank AS INTEGER) AS rank FROM seeds"))
def li_ctfidf_top(spark, sf_dir):
    """Reference order: NaN scores first (Q5, ``nan_first=True``)."""
    s = tm.li_ctfidf(tm.with_terms(lang_prepared(spark, sf_dir)), nan_first=True)
    return tm.seed_words(tm.top_terms(s, 8, False), 8).select("label", "term", F.col("rank").cast("int"))


@register("cluster_labels", S.with_(S.corpus_ctes("lang") + S.li_ctes("prepared")
                                    + S.top_ctes("li", 8, False) + S.seed_ctes("top", 8),
                                    """SELECT l.label AS cluster, coalesce(s.term, 'cluster_' || l.label) AS name
                                       FROM (SELECT DISTINCT label FROM prepared) l
                                       LEFT JOIN (SELECT * FROM seeds WHERE rank = 1) s USING (label)"""))
def cluster_labels(spark, sf_dir):
    """F13 on a grouping SQL can repeat: each language as one cluster."""
    d = lang_prepared(spark, sf_dir).withColumnRenamed("label", "cluster")
    return tm.cluster_names(d, "cluster", 8)
