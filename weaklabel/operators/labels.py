"""The missing-label setting (L1-L9): drop some rare classes, keep a seeded
share of each other class as labelled.

Per-class work runs on aggregates (one row per label, or per label and
hash bucket), never as one sort over a whole class: a class may hold a
third of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hash32, uniform01
from ..session import cut_lineage, keep

DEFAULT_SEED = 42


def label_counts(corpus: DataFrame) -> DataFrame:
    """L1: ``(label, n)``; ascending order is (n, label) — see ``rare_labels``."""
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def rare_labels(counts: DataFrame, bottom_p: float) -> DataFrame:
    """L2: the ``floor(n_labels * bottom_p)`` rarest labels, ties by label.
    ``counts`` has one row per label, so the un-partitioned windows here
    run over the label set only."""
    everything = Window.partitionBy()
    order = Window.orderBy("n", "label")
    return (counts
            .withColumn("rank", F.row_number().over(order))
            .withColumn("_n_labels", F.count(F.lit(1)).over(everything))
            .where(F.col("rank") <= F.floor(F.col("_n_labels") * F.lit(float(bottom_p))))
            .drop("_n_labels"))


def sample_rare_labels(rare: DataFrame, full_k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """L3: draw ``full_k`` labels with replacement, weight 1/count; return the
    distinct drawn labels (Q17: possibly fewer than ``full_k``).

    Each label owns ``[lo, hi)`` of the cumulative normalised weights; draw
    i is ``uniform(seed, 'draw-i')``. The range lookup is an as-of match:
    label starts and draws are merged in one ordered list (label set plus
    ``full_k`` rows) and each draw takes the last label start before it."""
    if full_k <= 0:
        return rare.select("label").limit(0)
    order = Window.orderBy("n", "label")
    spark = rare.sparkSession
    w = rare.select("label", "n", (F.lit(1.0) / F.col("n")).alias("_w"))
    total = w.select(F.sum("_w")).scalar()
    starts = (w.withColumn("_cum", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .select("label", ((F.col("_cum") - F.col("_w")) / total).alias("pos"),
                      F.lit(0).alias("kind")))
    draws = spark.range(full_k).select(
        F.lit(None).cast("string").alias("label"),
        uniform01(seed, F.concat(F.lit("draw-"), F.col("id").cast("string"))).alias("pos"),
        F.lit(1).alias("kind"))
    merged = starts.unionByName(draws)
    asof = Window.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    picked = merged.withColumn("_pick", F.last("label", ignorenulls=True).over(asof))
    return picked.where("kind = 1").select(F.col("_pick").alias("label")).distinct()


def drop_labels(corpus: DataFrame, removed: DataFrame) -> DataFrame:
    """L4: documents whose label was not removed."""
    return corpus.join(removed.select("label"), "label", "left_anti")


def _kth_key_per_group(keys: DataFrame, by: str, target: DataFrame, bits: int = 16) -> DataFrame:
    """Per group, the ``target``-th smallest ``(_h, doc_id)`` (1-based).

    ``keys(by, doc_id, _h)`` with ``_h`` in [0, 2^32). A histogram over the
    top ``bits`` of ``_h`` finds the bucket holding the target; only that
    bucket's rows are ranked exactly. No task sorts a whole group, so a hot
    group costs no more than a cold one."""
    shift = 32 - bits
    b = keys.withColumn("_b", F.shiftright("_h", shift))
    hist = b.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    run = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.join(target, by)
            .withColumn("_cum", F.sum("_nb").over(run))
            .where((F.col("_cum") - F.col("_nb") < F.col("_target")) & (F.col("_cum") >= F.col("_target")))
            .select(by, "_b", (F.col("_target") - F.col("_cum") + F.col("_nb")).alias("_need")))
    boundary = b.join(hist, [by, "_b"])
    exact = Window.partitionBy(by, "_b").orderBy("_h", "doc_id")
    return (boundary.withColumn("_rn", F.row_number().over(exact))
            .where(F.col("_rn") == F.col("_need"))
            .select(by, F.col("_h").alias("_kh"), F.col("doc_id").alias("_kid")))


def _selected(kth_joined: DataFrame) -> Column:
    """A row is sampled iff its ``(_h, doc_id)`` is at most its label's k-th key."""
    return F.coalesce(
        (F.col("_h") < F.col("_kh")) | ((F.col("_h") == F.col("_kh")) & (F.col("doc_id") <= F.col("_kid"))),
        F.lit(False))


def stratified_sample(corpus: DataFrame, keep_p: float, seed: int = DEFAULT_SEED,
                      by: str = "label", bits: int = 16) -> DataFrame:
    """Exactly ``round_half_even(keep_p * n)`` documents per label, the
    ones with the smallest ``md5(seed-doc_id)`` (ties by ``doc_id``).
    Returns the corpus rows with ``is_sampled``; no document is dropped."""
    keyed = corpus.select(by, "doc_id").withColumn("_h", hash32(seed, F.col("doc_id")))
    sizes = (keyed.groupBy(by).agg(F.count(F.lit(1)).alias("_tot"))
             .select(by, F.bround(F.lit(float(keep_p)) * F.col("_tot"), 0).cast("bigint").alias("_target"))
             .where("_target > 0"))
    kth = cut_lineage(_kth_key_per_group(keyed, by, sizes, bits), "sample-keys")
    return (corpus.withColumn("_h", hash32(seed, F.col("doc_id"))).join(kth, by, "left")
            .withColumn("is_sampled", _selected(kth)).drop("_h", "_kh", "_kid"))


def split_plan(corpus: DataFrame, bottom_p: float = 0.5, full_k: int = 5, keep_p: float = 0.1,
               seed: int = DEFAULT_SEED, bits: int = 16) -> DataFrame:
    """L1-L5 as one small table, one row per label: ``(label, n, removed,
    _kh, _kid)`` — whether the label was removed, and the k-th key of its
    sample. It is computed from ``(doc_id, label)`` only and cached, so the
    corpus itself is read once more, by the final join."""
    ids = corpus.select("doc_id", "label")
    counts = keep(label_counts(ids))
    removed = sample_rare_labels(rare_labels(counts, bottom_p), full_k, seed)
    info = (counts.join(removed.withColumn("removed", F.lit(True)), "label", "left")
            .withColumn("removed", F.coalesce("removed", F.lit(False)))
            .withColumn("_target", F.when(F.col("removed"), F.lit(0)).otherwise(
                F.bround(F.lit(float(keep_p)) * F.col("n"), 0)).cast("bigint")))
    info = keep(info)
    keyed = ids.withColumn("_h", hash32(seed, F.col("doc_id")))
    kth = _kth_key_per_group(keyed, "label", info.where("_target > 0").select("label", "_target"), bits)
    return cut_lineage(info.join(kth, "label", "left").select("label", "n", "removed", "_kh", "_kid"),
                       "split-plan")


def label_split(corpus: DataFrame, bottom_p: float = 0.5, full_k: int = 5, keep_p: float = 0.1,
                seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``split`` in ('labeled', 'unlabeled'). Documents of removed
    labels and unsampled documents are unlabelled. Every row is kept; the
    per-label plan is a broadcast-size table (one row per label)."""
    plan = split_plan(corpus, bottom_p, full_k, keep_p, seed)
    joined = (corpus.withColumn("_h", hash32(seed, F.col("doc_id")))
              .join(plan.select("label", "removed", "_kh", "_kid"), "label", "left"))
    labeled = ~F.coalesce(F.col("removed"), F.lit(False)) & _selected(joined)
    return (joined.withColumn("split", F.when(labeled, "labeled").otherwise("unlabeled"))
            .drop("_h", "removed", "_kh", "_kid"))


def label_sets(split_corpus: DataFrame) -> DataFrame:
    """One row per label with its status and 0-based index among the
    existing (labelled) labels in sorted order; unseen labels get NULL.
    ``labels`` in the reference are the unlabelled part's labels;
    ``in_unlabeled`` keeps that distinction."""
    per = (split_corpus.groupBy("label")
           .agg(F.max(F.col("split") == "labeled").alias("in_labeled"),
                F.max(F.col("split") == "unlabeled").alias("in_unlabeled")))
    existing = Window.partitionBy("in_labeled").orderBy("label")
    return (per.withColumn("status", F.when(F.col("in_labeled"), "existing").otherwise("unseen"))
            .withColumn("class_idx", F.when(F.col("in_labeled"),
                                            (F.row_number().over(existing) - 1).cast("int"))))


def existing_labels(split_corpus_or_sets: DataFrame) -> DataFrame:
    """``(label, class_idx)`` of the labelled part."""
    s = split_corpus_or_sets
    if "status" not in s.columns:
        s = label_sets(s)
    return s.where("status = 'existing'").select("label", "class_idx")


def unseen_labels(split_corpus: DataFrame) -> DataFrame:
    """Labels of the unlabelled part minus labels of the labelled part."""
    lab = split_corpus.where("split = 'labeled'").select("label")
    unl = split_corpus.where("split = 'unlabeled'").select("label")
    return unl.subtract(lab)
