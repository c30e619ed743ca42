"""Checks for naming, assembly and evaluation (G, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import naming as nm
from ..sources import fixtures as fx
from . import sqlparts as S
from .common import MIN_COUNT, SEED_K, THRESHOLD, VEC_DIM, e6, lang_chain
from .registry import register

P = S.LANG
CHAIN = (S.corpus_ctes("lang") + S.split_ctes(P["bottom_p"], P["full_k"], P["keep_p"], P["seed"])
         + S.vector_ctes(VEC_DIM, MIN_COUNT, SEED_K, THRESHOLD) + S.naming_ctes())


def _preds(c):
    return c["predictions"].select("doc_id", F.col("label").alias("truth"), "prediction", "is_confident")


@register("cluster_names", S.with_(CHAIN, "SELECT cluster, name FROM names"))
def cluster_names(spark, sf_dir):
    """F13 on the unconfident documents, grouped by nearest class."""
    return lang_chain(spark, sf_dir)["names"]


@register("new_class_predictions", S.with_(CHAIN, "SELECT doc_id, cluster, prediction FROM new_classes"))
def new_class_predictions(spark, sf_dir):
    return lang_chain(spark, sf_dir)["new_classes"].select("doc_id", "cluster", "prediction")


@register("full_predictions", S.with_(CHAIN, "SELECT doc_id, truth, prediction, is_confident FROM preds"))
def full_predictions(spark, sf_dir):
    return _preds(lang_chain(spark, sf_dir))


@register("existing_rows", S.with_(CHAIN, """SELECT doc_id, truth, prediction FROM preds
    WHERE truth IN (SELECT label FROM existing)"""))
def existing_rows(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    return mt.existing_rows(_preds(c), c["existing"]).select("doc_id", "truth", "prediction")


@register("removed_rows", S.with_(CHAIN, """SELECT p.doc_id, p.truth, array_to_string(u.tokens, ' ') AS text
    FROM preds p JOIN unl u USING (doc_id) WHERE p.truth NOT IN (SELECT label FROM existing)"""))
def removed_rows(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    rows = mt.removed_rows(_preds(c), c["existing"])
    docs = c["split"].select("doc_id", F.array_join("tokens", " ").alias("text"))
    return rows.join(docs, "doc_id").select("doc_id", "truth", "text")


F1_CTES = [
    ("ex", "SELECT * FROM preds WHERE truth IN (SELECT label FROM existing)"),
    ("per", """SELECT e.label,
          (SELECT count(*) FROM ex WHERE truth = e.label AND prediction = e.label) AS tp,
          (SELECT count(*) FROM ex WHERE prediction = e.label AND truth <> e.label) AS fp,
          (SELECT count(*) FROM ex WHERE truth = e.label AND prediction IS DISTINCT FROM e.label) AS fn
        FROM existing e"""),
]
F1_BODY = """SELECT round_even(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0
                             ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 3) AS micro_f1,
             round_even(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 3) AS macro_f1
      FROM per"""


@register("f1_existing", S.with_(CHAIN + F1_CTES, F1_BODY))
def f1_existing(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    return mt.f1_existing(_preds(c), c["existing"])


NEW_CTES = [
    ("b", """SELECT truth NOT IN (SELECT label FROM existing) AS t_new,
                    coalesce(prediction NOT IN (SELECT label FROM existing), true) AS p_new FROM preds"""),
]
NEW_BODY = """SELECT round_even(CASE WHEN sum(p_new::INT) = 0 THEN 0.0 ELSE sum((t_new AND p_new)::INT) / sum(p_new::INT) END, 3) AS precision,
             round_even(CASE WHEN sum(t_new::INT) = 0 THEN 0.0 ELSE sum((t_new AND p_new)::INT) / sum(t_new::INT) END, 3) AS recall
      FROM b"""


@register("new_label_metrics", S.with_(CHAIN + NEW_CTES, NEW_BODY))
def new_label_metrics(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    return mt.new_label_metrics(_preds(c), c["existing"])


@register("compare_labels", S.with_(CHAIN, """SELECT coalesce(r.label, g.label) AS label,
    r.label IS NOT NULL AS is_removed, g.label IS NOT NULL AS is_generated
    FROM (SELECT DISTINCT label FROM split WHERE label NOT IN (SELECT label FROM existing)) r
    FULL OUTER JOIN (SELECT DISTINCT name AS label FROM names) g USING (label)"""))
def compare_labels(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    removed = c["split"].select("label").distinct().join(c["existing"], "label", "left_anti")
    return mt.compare_labels(removed, c["names"]).select("label", "is_removed", "is_generated")


_TERMS_SQL = S.with_(CHAIN + [
    ("rows_g", "SELECT 'generated' AS side, prediction AS label, tokens FROM new_classes WHERE prediction IS NOT NULL"),
    ("rows_r", """SELECT 'removed' AS side, u.label, u.tokens FROM unl u
                  WHERE u.label NOT IN (SELECT label FROM existing)"""),
    ("rows_all", "SELECT * FROM rows_g UNION ALL SELECT * FROM rows_r"),
    ("tc", f"""SELECT side, label, term, count(*) AS n FROM (
                 SELECT side, label, unnest({S.analyzer_terms('tokens')}) AS term FROM rows_all)
               GROUP BY side, label, term"""),
], """SELECT side, label, term, n, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY side, label ORDER BY n DESC, term) AS rank FROM tc)
      WHERE rank <= 200""")


@register("label_term_frequencies", _TERMS_SQL)
def label_term_frequencies(spark, sf_dir):
    """M7: word-cloud data for generated names and for removed labels."""
    c = lang_chain(spark, sf_dir)
    gen = (c["new_classes"].where(F.col("prediction").isNotNull())
           .select(F.col("prediction").alias("label"), "tokens"))
    unl = c["split"].where("split = 'unlabeled'")
    rem = unl.join(c["existing"], "label", "left_anti").select("label", "tokens")
    out = mt.label_term_frequencies(gen, "generated").unionByName(mt.label_term_frequencies(rem, "removed"))
    return out.select("side", "label", "term", "n", F.col("rank").cast("int"))


_ACC_SQL = S.with_([
    ("p", "SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS prediction FROM labels"),
    ("lab", "SELECT truth AS label FROM p UNION SELECT prediction FROM p"),
    ("per", """SELECT l.label,
          (SELECT count(*) FROM p WHERE truth = l.label AND prediction = l.label) AS tp,
          (SELECT count(*) FROM p WHERE prediction = l.label AND truth <> l.label) AS fp,
          (SELECT count(*) FROM p WHERE truth = l.label AND prediction <> l.label) AS fn FROM lab l"""),
], f"""SELECT {S.e6('(SELECT avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) FROM p)')} AS accuracy_e6,
              {S.e6('2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1_e6,
              {S.e6('avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END)')} AS macro_f1_e6
       FROM per""")


@register("accuracy_f1", _ACC_SQL)
def accuracy_f1(spark, sf_dir):
    """M8 on the two label columns of ``labels``."""
    t = fx.binary_truth(spark, sf_dir)
    p = t.select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("prediction"))
    a = mt.accuracy_f1(p)
    return a.select(e6("accuracy").alias("accuracy_e6"), e6("micro_f1").alias("micro_f1_e6"),
                    e6("macro_f1").alias("macro_f1_e6"))


# ---------------------------------------------------------------- prompts

@register("doc_prompts", f"SELECT item_id, {S.q(nm.DOC_PROMPT)} || text AS prompt FROM benchmark")
def doc_prompts(spark, sf_dir):
    """G1 over the benchmark texts."""
    return nm.doc_prompts(fx.short_text(spark, sf_dir)).select("item_id", "prompt")


_HEAD = (f"{S.q(nm.LABEL_PROMPT_1)} || 'Example labels: ' || (SELECT string_agg(label, ', ' ORDER BY label) FROM existing)"
         f" || '.' || {S.q(nm.LABEL_PROMPT_3)} || {S.q(nm.LABEL_PROMPT_4)}")


@register("label_prompts", S.with_(CHAIN, f"""SELECT label AS cluster,
    {_HEAD} || string_agg(CAST(rank AS VARCHAR) || '. ' || term, chr(10) ORDER BY rank) AS prompt
    FROM seeds GROUP BY label"""))
def label_prompts(spark, sf_dir):
    """One prompt per class, its seed words as the numbered topics."""
    c = lang_chain(spark, sf_dir)
    topics = c["seeds"].select(F.col("label").alias("cluster"), "rank", F.col("term").alias("topic"))
    return nm.cluster_prompts(topics, c["existing"])


@register("collapse_labels", S.with_(CHAIN, """SELECT doc_id,
    CASE WHEN label IN (SELECT label FROM split EXCEPT SELECT label FROM existing) THEN label ELSE 'Others' END AS label
    FROM unl"""))
def collapse_labels(spark, sf_dir):
    """Hidden truth of the unlabelled part, removed labels kept, the
    rest 'Others'."""
    from ..operators.similarity import collapse_truth
    c = lang_chain(spark, sf_dir)
    unseen = c["split"].select("label").distinct().join(c["existing"], "label", "left_anti")
    return collapse_truth(c["unlabeled"].select("doc_id", "label"), unseen)
