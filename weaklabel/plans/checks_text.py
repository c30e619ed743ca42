"""Checks for sources, text functions and the missing-label setting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stopwords import DEFAULT_STOPWORDS
from ..operators import labels as lb
from ..operators.preprocess import lemmatize_rules, lemmatize_tokens, plural_lemmas, prepare_corpus
from ..sources import corpus as src
from ..sources import fixtures as fx
from . import sqlparts as S
from .common import LANG_SPLIT, lang_prepared, lang_split
from .registry import register

P = S.LANG
CORPUS = S.corpus_ctes("lang")
SPLIT = CORPUS + S.split_ctes(P["bottom_p"], P["full_k"], P["keep_p"], P["seed"])


@register("load_corpus", S.with_(CORPUS, "SELECT doc_id, sentence, label FROM corpus"))
def load_corpus(spark, sf_dir):
    return src.load_corpus(spark, f"{sf_dir}/documents.parquet", text_col="text", label_col="lang")


@register("clean_text", "SELECT doc_id, " + S.clean("text") + " AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@register("tokenize", "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
          "(SELECT doc_id, " + S.tokenize(S.clean("text")) + " AS t FROM documents)")
def tokenize(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    t = tx.tokenize(tx.clean_text(F.col("text")))
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens"))


@register("tokenize_keep_punct", "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
          "(SELECT doc_id, " + S.tokenize_keep_punct("text") + " AS t FROM documents)")
def tokenize_keep_punct(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    t = tx.tokenize_keep_punct(F.col("text"))
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens"))


@register("tokenize_treebank", "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
          "(SELECT doc_id, " + S.tokenize_treebank("text") + " AS t FROM documents)")
def tokenize_treebank(spark, sf_dir):
    """The preprocessing with punctuation kept."""
    d = prepare_corpus(fx.corpus_lang(spark, sf_dir), remove_punctuation=False, remove_stopwords=False)
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def _noun_forms(w: str) -> str:
    """What the published noun rules make of a word, in order."""
    rules = "s: ses:s ves:f xes:x zes:z ches:ch shes:sh men:man ies:y".split()
    cases = [f"CASE WHEN ends_with({w}, '{a}') THEN left({w}, length({w}) - {len(a)}) || '{b}' END" for a, b in (r.split(":") for r in rules)]
    return f"list_filter([{', '.join(cases)}], lambda z: z IS NOT NULL)"


# The check's dictionary: tokens of even length; its exceptions: tokens of seven letters are lemmatized to their first four.
@register("lemmatize_rules", S.with_(CORPUS + [
    ("voc", "SELECT DISTINCT token FROM (SELECT unnest(tokens) AS token FROM prepared)"),
    ("dict", "SELECT token AS form FROM voc WHERE length(token) % 2 = 0"),
    ("f1", f"SELECT token, {_noun_forms('token')} AS f FROM voc WHERE length(token) <> 7"),
    ("f2", f"SELECT token, f, flatten(list_transform(f, lambda y: {_noun_forms('y')})) AS g FROM f1"),
    ("cand", """SELECT token, 0 AS step, -1 AS place, token AS form FROM voc
        UNION ALL SELECT token, 0, generate_subscripts(f, 1) - 1, unnest(f) FROM f2
        UNION ALL SELECT token, 1, generate_subscripts(g, 1) - 1, unnest(g) FROM f2
        UNION ALL SELECT token, 0, 0, left(token, 4) FROM voc WHERE length(token) = 7"""),
    ("lem", """SELECT token, form FROM cand JOIN dict USING (form)
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY step, length(form), place) = 1"""),
    ("w", "SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM prepared"),
], """SELECT p.doc_id, coalesce(string_agg(coalesce(form, token), ' ' ORDER BY pos), '') AS tokens
      FROM prepared p LEFT JOIN w USING (doc_id) LEFT JOIN lem USING (token) GROUP BY p.doc_id"""))
def lemmatize_by_rules(spark, sf_dir):
    """T5 by detachment rules, exceptions and a given dictionary."""
    docs = lang_prepared(spark, sf_dir)
    voc = docs.select(F.explode("tokens").alias("token")).distinct()
    known = voc.where(F.length("token") % 2 == 0).select(F.col("token").alias("lemma"))
    odd = voc.where(F.length("token") == 7).select("token", F.left("token", F.lit(4)).alias("lemma"))
    out = lemmatize_rules(docs, known, odd, rounds=2)
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register("remove_stopwords", "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
          "(SELECT doc_id, " + S.drop_stop(S.tokenize(S.clean("text"))) + " AS t FROM documents)")
def remove_stopwords(spark, sf_dir):
    d = prepare_corpus(fx.corpus_lang(spark, sf_dir), remove_stopwords=True)
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


@register("analyzer_terms", S.with_(CORPUS, "SELECT doc_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms "
                                    "FROM (SELECT doc_id, " + S.analyzer_terms("tokens") + " AS t FROM prepared)"))
def analyzer_terms(spark, sf_dir):
    d = lang_prepared(spark, sf_dir)
    t = tx.analyzer_terms(F.col("tokens"), DEFAULT_STOPWORDS)
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_terms"), F.array_join(t, " ").alias("terms"))


_LEMMA_SQL = S.with_(CORPUS + [
    ("vocab", "SELECT DISTINCT unnest(tokens) AS token FROM prepared"),
    ("lemmas", """SELECT v.token, substr(v.token, 1, length(v.token) - 1) AS lemma FROM vocab v
                  WHERE suffix(v.token, 's') AND length(v.token) > 3
                    AND substr(v.token, 1, length(v.token) - 1) IN (SELECT token FROM vocab)"""),
    ("ex", "SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM prepared"),
    ("lem", """SELECT doc_id, array_to_string(list(coalesce(l.lemma, e.tok) ORDER BY pos), ' ') AS t,
                      count(*) AS n FROM ex e LEFT JOIN lemmas l ON e.tok = l.token GROUP BY doc_id"""),
], """SELECT p.doc_id, coalesce(lem.n, 0) AS n_tokens, coalesce(lem.t, '') AS tokens
      FROM prepared p LEFT JOIN lem USING (doc_id)""")


@register("lemmatize", _LEMMA_SQL)
def lemmatize(spark, sf_dir):
    d = lang_prepared(spark, sf_dir)
    out = lemmatize_tokens(d, plural_lemmas(d))
    return out.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"))


@register("clean_label", "SELECT item_id, " + S.strip_punct("regexp_replace(text, '[\"'']', '', 'g')")
          + " AS label FROM benchmark")
def clean_label(spark, sf_dir):
    b = fx.short_text(spark, sf_dir)
    return b.select("item_id", tx.clean_label(F.col("text")).alias("label"))


# ---------------------------------------------------------- label setting

@register("label_counts", S.with_(SPLIT, "SELECT label, n FROM counts"))
def label_counts(spark, sf_dir):
    return lb.label_counts(lang_prepared(spark, sf_dir))


@register("rare_labels", S.with_(SPLIT, "SELECT label, n, CAST(rank AS INTEGER) AS rank FROM rare"))
def rare_labels(spark, sf_dir):
    r = lb.rare_labels(lb.label_counts(lang_prepared(spark, sf_dir)), LANG_SPLIT["bottom_p"])
    return r.select("label", "n", F.col("rank").cast("int"))


_RARE3 = S.split_ctes(0.5, 3, 0.6, 42)


@register("sample_rare_labels", S.with_(CORPUS + _RARE3, "SELECT label FROM removed"))
def sample_rare_labels(spark, sf_dir):
    # full_k = 3 draws over the rare half, so the range lookup is exercised
    rare = lb.rare_labels(lb.label_counts(lang_prepared(spark, sf_dir)), 0.5)
    return lb.sample_rare_labels(rare, 3, 42)


@register("drop_labels", S.with_(SPLIT, "SELECT doc_id, label FROM kept"))
def drop_labels(spark, sf_dir):
    d = lang_prepared(spark, sf_dir)
    rare = lb.rare_labels(lb.label_counts(d), LANG_SPLIT["bottom_p"])
    removed = lb.sample_rare_labels(rare, LANG_SPLIT["full_k"], LANG_SPLIT["seed"])
    return lb.drop_labels(d, removed).select("doc_id", "label")


@register("stratified_sample", S.with_(SPLIT, "SELECT doc_id FROM sampled"))
def stratified_sample(spark, sf_dir):
    d = lang_prepared(spark, sf_dir).select("doc_id", "label")
    rare = lb.rare_labels(lb.label_counts(d), LANG_SPLIT["bottom_p"])
    removed = lb.sample_rare_labels(rare, LANG_SPLIT["full_k"], LANG_SPLIT["seed"])
    kept = lb.drop_labels(d, removed)
    return (lb.stratified_sample(kept, LANG_SPLIT["keep_p"], LANG_SPLIT["seed"])
            .where("is_sampled").select("doc_id"))


@register("label_split", S.with_(SPLIT, "SELECT doc_id, label, split FROM split"))
def label_split(spark, sf_dir):
    return lang_split(spark, sf_dir).select("doc_id", "label", "split")


@register("label_sets", S.with_(SPLIT, """SELECT label, in_labeled, in_unlabeled,
    CASE WHEN in_labeled THEN 'existing' ELSE 'unseen' END AS status FROM label_sets"""))
def label_sets(spark, sf_dir):
    return lb.label_sets(lang_split(spark, sf_dir)).select("label", "in_labeled", "in_unlabeled", "status")


@register("label_index", S.with_(SPLIT, "SELECT label, class_idx FROM existing"))
def label_index(spark, sf_dir):
    return lb.existing_labels(lang_split(spark, sf_dir))


@register("unseen_labels", S.with_(SPLIT, """SELECT label FROM split WHERE split = 'unlabeled'
    EXCEPT SELECT label FROM split WHERE split = 'labeled'"""))
def unseen_labels(spark, sf_dir):
    return lb.unseen_labels(lang_split(spark, sf_dir))


@register("corpus_statistics", S.with_(SPLIT, """SELECT split, count(*) AS size, avg(len(tokens)) AS avg_length,
    count(DISTINCT label) AS n_classes FROM split GROUP BY split"""))
def corpus_statistics(spark, sf_dir):
    return src.corpus_statistics(lang_split(spark, sf_dir))


@register("full_corpus", S.with_(SPLIT, "SELECT doc_id, split, label, array_to_string(tokens, ' ') AS text FROM split"))
def full_corpus(spark, sf_dir):
    return src.full_corpus(lang_split(spark, sf_dir))
