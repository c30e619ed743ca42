"""Term weighting (F1-F13): class-level TF-IDF, LI-cTF-IDF, top terms per
class, seed words and cluster names.

Everything is a long ``(label, term, ...)`` table. A document's terms are
counted inside its row; per-class totals are aggregates joined
back (one row per class), never windows over a whole class; top-k per
class is ``row_number() <= k``, which Spark runs as a partial group limit
before the shuffle, so a class with a third of the corpus ships only its
local top-k from each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stopwords import DEFAULT_STOPWORDS

SCORE_DECIMALS = 9  # rank on rounded scores so summation order cannot swap ties


def with_terms(docs: DataFrame, stopwords=None) -> DataFrame:
    """T7 over prepared tokens: ``(doc_id, label, terms)``."""
    stop = DEFAULT_STOPWORDS if stopwords is None else stopwords
    return docs.select("doc_id", "label", tx.analyzer_terms(F.col("tokens"), stop).alias("terms"))


def doc_term_counts(docs_terms: DataFrame) -> DataFrame:
    """``(doc_id, label, term, n)``. A document's terms lie in one row:
    they are sorted there and each run is counted, so nothing is shuffled."""
    def let(value, body):                                # ``body`` of a value computed once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def starts(t):
        places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))

    def runs(z):
        return F.transform(z["at"], lambda a, k: F.struct(
            F.get(z["t"], a).alias("term"),
            (F.coalesce(F.get(z["at"], k + 1), F.size(z["t"])) - a).cast("bigint").alias("n")))
    counts = let(F.sort_array("terms"), lambda t: let(F.struct(t.alias("t"), starts(t).alias("at")), runs))
    return docs_terms.select("doc_id", "label", F.inline(counts))


def class_documents(docs: DataFrame, col: str = "tokens") -> DataFrame:
    """each class's documents joined into one "document". The joined
    string is never built (it would put a whole class in one row); the
    scores count terms per class instead, and this table gives the joined
    document's size: ``(label, n_docs, n_tokens, n_chars)``, where
    ``n_chars`` is the length of the documents joined by single spaces."""
    return (docs.groupBy("label")
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.sum(F.size(col)).cast("bigint").alias("n_tokens"),
                 (F.sum(F.length(F.array_join(col, " "))) + F.count(F.lit(1)) - 1).cast("bigint").alias("n_chars")))


def class_tfidf(docs_terms: DataFrame) -> DataFrame:
    """TF-IDF where each class's joined documents form one document.

    tf = count of the term in the class; idf = ln((1+C)/(1+df)) + 1 with C
    the number of classes and df the classes holding the term; each class
    row is L2-normalised. Returns ``(label, term, tf, df, score)``."""
    classes = docs_terms.select("label").distinct()
    n_classes = classes.select(F.count(F.lit(1))).scalar()
    tf = (docs_terms.select("label", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
          .groupBy("label", "term").agg(F.count(F.lit(1)).alias("tf")))
    by_term = Window.partitionBy("term")
    w = (tf.withColumn("df", F.count(F.lit(1)).over(by_term))
         .withColumn("_w", F.col("tf") * (F.log((F.lit(1.0) + n_classes) / (F.col("df") + F.lit(1.0))) + 1.0)))
    norms = w.groupBy("label").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return (w.join(norms, "label")
            .select("label", "term", "tf", "df", (F.col("_w") / F.col("_norm")).alias("score")))


def li_ctfidf(docs_terms: DataFrame, nan_first: bool = False) -> DataFrame:
    """LI-cTF-IDF per ``(label, term)``.

    LI = share of the class's documents holding the term; c-TF =
    tanh(occurrences in class / class size); IDF = ln(D / occurrences
    overall); score = cube root of the product. IDF counts occurrences, so
    frequent terms get IDF <= 0 and a NaN or 0 score (Q5). By default those
    terms are dropped; ``nan_first=True`` keeps them (NaN sorts first)."""
    sizes = docs_terms.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    n_docs = docs_terms.select(F.count(F.lit(1))).scalar()
    # Occurrences and documents are marked inside the row (all terms, then the
    # distinct ones) and summed by (label, term) at once: no shuffle by document.
    marks = F.concat("terms", F.array_distinct("terms"))
    is_occ = F.col("_at") < F.col("_n")
    pair = (docs_terms.select("label", F.size("terms").alias("_n"), F.posexplode_outer(marks).alias("_at", "term"))
            .where(F.col("term").isNotNull()).groupBy("label", "term")
            .agg(F.sum(F.when(is_occ, 0).otherwise(1)).alias("n_docs_with"), F.sum(F.when(is_occ, 1).otherwise(0)).alias("occ")))
    pair = pair.withColumn("total_occ", F.sum("occ").over(Window.partitionBy("term")))
    s = (pair.join(sizes, "label")
         .withColumn("li", F.col("n_docs_with") / F.col("class_size"))
         .withColumn("ctf", F.tanh(F.col("occ") / F.col("class_size")))
         .withColumn("idf", F.log(n_docs / F.col("total_occ")))
         .withColumn("score", F.pow(F.col("li") * F.col("ctf") * F.col("idf"), F.lit(1.0 / 3.0))))
    if not nan_first:
        s = s.where(F.col("idf") > 0)
    return s.select("label", "term", "li", "ctf", "idf", "score")


def top_terms(scores: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
    """the first ``top_take`` terms per class by score (desc), ties by
    term; ``top_take = k`` if strict else ``max(10, 3k)``. Only terms that
    occur in the class are candidates (Q4). NaN ranks first (Q5)."""
    top_take = k if strict else max(10, 3 * k)
    order = Window.partitionBy("label").orderBy(
        F.desc(F.round("score", SCORE_DECIMALS)), F.asc("term"))
    return (scores.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top_take)
            .select("label", "term", "rank", "score"))


def seed_words(top: DataFrame, k: int = 10, stopwords=None) -> DataFrame:
    """drop terms listed for more than one class and stopwords, keep the
    first ``k`` per class. Duplicates are counted over the cut lists."""
    stop = sorted(set(DEFAULT_STOPWORDS if stopwords is None else stopwords))
    dup = Window.partitionBy("term")
    kept = (top.withColumn("_lists", F.count(F.lit(1)).over(dup))
            .where((F.col("_lists") == 1) & ~F.col("term").isin(stop)))
    order = Window.partitionBy("label").orderBy("rank")
    return (kept.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("label", "term", "rank", "score"))


def seed_words_with_label(top: DataFrame, k: int = 10, stopwords=None) -> DataFrame:
    """the lower-cased class name is the first seed (rank 0); other
    terms equal to it are removed from its list; duplicates across lists,
    stopwords and terms equal to any raw class name are dropped; k-1 others
    follow."""
    stop = sorted(set(DEFAULT_STOPWORDS if stopwords is None else stopwords))
    names = top.select("label").distinct()
    head = names.select("label", tx.lower_label(F.col("label")).alias("term"),
                        F.lit(0).alias("rank"), F.lit(None).cast("double").alias("score"))
    rest = top.where(F.col("term") != tx.lower_label(F.col("label")))
    lists = head.unionByName(rest)
    counted = lists.withColumn("_lists", F.count(F.lit(1)).over(Window.partitionBy("term")))
    raw_names = names.select(F.col("label").alias("term"))
    others = (counted.where((F.col("rank") > 0) & (F.col("_lists") == 1) & ~F.col("term").isin(stop))
              .join(raw_names, "term", "left_anti"))
    order = Window.partitionBy("label").orderBy("rank")
    others = (others.withColumn("rank", F.row_number().over(order))
              .where(F.col("rank") <= k - 1).select("label", "term", "rank", "score"))
    return head.unionByName(others)


def get_seed_words(split_corpus: DataFrame, k: int = 10, strict: bool = False,
                   stopwords=None) -> DataFrame:
    """seed words of the labelled part."""
    labeled = split_corpus.where(F.col("split") == "labeled")
    return seed_words(top_terms(class_tfidf(with_terms(labeled, stopwords)), k, strict),
                      k, stopwords)


def cluster_names(docs: DataFrame, cluster_col: str = "cluster", k: int = 8,
                  nan_first: bool = False, stopwords=None) -> DataFrame:
    """one name per cluster, the first LI-cTF-IDF seed (``k=8``,
    non-strict). ``docs(doc_id, tokens, cluster)``; clusters with an empty
    list are named ``cluster_<id>`` (Q9)."""
    d = docs.where(F.col(cluster_col).isNotNull()).select(
        "doc_id", F.col(cluster_col).cast("string").alias("label"), "tokens")
    seeds = seed_words(top_terms(li_ctfidf(with_terms(d, stopwords), nan_first), k, False),
                       k, stopwords)
    first = seeds.where("rank = 1").select("label", F.col("term").alias("name"))
    all_clusters = d.select("label").distinct()
    return (all_clusters.join(first, "label", "left")
            .select(F.col("label").cast(docs.schema[cluster_col].dataType).alias(cluster_col),
                    F.coalesce("name", F.concat(F.lit("cluster_"), F.col("label"))).alias("name")))
