"""Evaluation (M1-M8). Predictions are first reduced to a
``(truth, prediction, count)`` confusion table (at most labels² rows,
partially aggregated per task); all scores are arithmetic on that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage


def attach_truth(predictions: DataFrame, truth: DataFrame, check: bool = False) -> DataFrame:
    """M1: ``predictions(doc_id, prediction)`` + ``truth(doc_id, label)``.
    ``check=True`` runs one counting job and fails on a length mismatch."""
    out = predictions.join(truth.select("doc_id", F.col("label").alias("truth")), "doc_id")
    if check:
        a, b = predictions.count(), truth.count()
        if a != b:
            raise ValueError(f"{a} predictions for {b} documents")
    return out


def existing_rows(pred: DataFrame, existing: DataFrame) -> DataFrame:
    """M2: rows whose truth is an existing label."""
    return pred.join(existing.select(F.col("label").alias("truth")), "truth", "left_semi")


def removed_rows(pred: DataFrame, existing: DataFrame) -> DataFrame:
    """M3: rows whose truth is not an existing label."""
    return pred.join(existing.select(F.col("label").alias("truth")), "truth", "left_anti")


def confusion(pred: DataFrame) -> DataFrame:
    """``(truth, prediction, n)``: at most labels² rows, cached, since every
    score reads it several times."""
    return cut_lineage(pred.groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("n")), "confusion")


def per_label_counts(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """TP/FP/FN per label of ``labels(label)`` from a confusion table.
    Predictions outside the label set are misses only, never false positives
    of a listed label."""
    tp = conf.where(F.col("truth") == F.col("prediction")).select(F.col("truth").alias("label"),
                                                                    F.col("n").alias("tp"))
    pred_tot = conf.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("pred_n"))
    true_tot = conf.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("true_n"))
    out = (labels.select("label").distinct()
           .join(tp, "label", "left").join(pred_tot, "label", "left").join(true_tot, "label", "left")
           .fillna(0, ["tp", "pred_n", "true_n"]))
    return out.select("label", "tp", (F.col("pred_n") - F.col("tp")).alias("fp"),
                      (F.col("true_n") - F.col("tp")).alias("fn"))


def _f1(tp, fp, fn):
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * tp / den)


def f1_scores(pred: DataFrame, labels: DataFrame, decimals: int | None = 3,
              conf: DataFrame | None = None) -> DataFrame:
    """Micro and macro F1 over the listed labels (0 where undefined),
    half-even rounded. One row ``(micro_f1, macro_f1)``."""
    c = per_label_counts(confusion(pred) if conf is None else conf, labels)
    agg = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro"))
    micro = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    r = (lambda x: F.bround(x, decimals)) if decimals is not None else (lambda x: x)
    return agg.select(r(micro).alias("micro_f1"), r(F.coalesce("macro", F.lit(0.0))).alias("macro_f1"))


def f1_existing(pred: DataFrame, existing: DataFrame) -> DataFrame:
    """M4: F1 over existing labels on the rows whose truth is existing."""
    return f1_scores(existing_rows(pred, existing), existing)


def new_label_metrics(pred: DataFrame, existing: DataFrame) -> DataFrame:
    """M5: precision and recall of "is new" (not an existing label); a
    missing prediction counts as new. 0.0 when undefined (Q15)."""
    ex = existing.select(F.col("label").alias("_e"), F.lit(True).alias("_x"))
    t = (pred.join(ex.withColumnRenamed("_x", "_truth_ex"), pred["truth"] == ex["_e"], "left").drop("_e")
         .join(ex.withColumnRenamed("_x", "_pred_ex").withColumnRenamed("_e", "_pe"),
               F.col("prediction") == F.col("_pe"), "left").drop("_pe"))
    t_new = F.col("_truth_ex").isNull()
    p_new = F.col("_pred_ex").isNull()
    agg = t.agg(F.sum((t_new & p_new).cast("long")).alias("tp"),
                F.sum(p_new.cast("long")).alias("pred_new"),
                F.sum(t_new.cast("long")).alias("true_new"))
    def ratio(a, b):
        return F.bround(F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b)), 3)
    return agg.select(ratio("tp", "pred_new").alias("precision"), ratio("tp", "true_new").alias("recall"))


def compare_labels(removed: DataFrame, generated: DataFrame) -> DataFrame:
    """M6: removed against generated label names, with side flags."""
    r = removed.select("label").distinct().withColumn("is_removed", F.lit(True))
    g = generated.select(F.col("name").alias("label")).distinct().withColumn("is_generated", F.lit(True))
    return (r.join(g, "label", "full").fillna(False, ["is_removed", "is_generated"]))


def label_term_frequencies(rows: DataFrame, side: str, top: int = 200, stopwords=None) -> DataFrame:
    """M7 (data for word clouds): per label the ``top`` most frequent terms.
    ``rows(label, tokens)``; terms by the TF-IDF analyzer."""
    from ..functions.stopwords import DEFAULT_STOPWORDS
    from pyspark.sql import Window
    stop = DEFAULT_STOPWORDS if stopwords is None else stopwords
    terms = rows.select("label", F.explode_outer(tx.analyzer_terms(F.col("tokens"), stop)).alias("term")).where(F.col("term").isNotNull())
    counts = terms.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("term"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .withColumn("side", F.lit(side)).select("side", "label", "term", "n", "rank"))


def accuracy_f1(pred: DataFrame, decimals: int | None = None) -> DataFrame:
    """M8: accuracy, macro F1 and micro F1 over every label seen in truth or
    prediction. ``pred(truth, prediction)``; everything is read from the
    confusion table."""
    conf = confusion(pred)
    labels = (conf.select(F.col("truth").alias("label"))
              .union(conf.select(F.col("prediction").alias("label"))).where(F.col("label").isNotNull()))
    f1 = f1_scores(pred, labels, decimals, conf=conf)
    acc = conf.agg((F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
                    / F.sum("n")).alias("accuracy"))
    return acc.select(
        "accuracy", f1.select("micro_f1").scalar().alias("micro_f1"),
        f1.select("macro_f1").scalar().alias("macro_f1"))
