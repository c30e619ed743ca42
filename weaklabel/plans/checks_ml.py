"""Checks for MLlib fits, the steps around a caller's model, and the
end-to-end run. Fits whose result depends on training have no SQL; the
caller's models are functions that SQL can repeat."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clusters as cl
from ..operators import embeddings as em
from ..operators import mixture as mx
from ..operators import naming as nm
from ..operators import similarity as sim
from ..operators.cbow import train_cbow
from ..session import checkpoint_dir, cut_lineage
from ..sources import fixtures as fx
from . import sqlparts as S
from .checks_eval import F1_BODY, F1_CTES, NEW_BODY, NEW_CTES
from .common import MIN_COUNT, SEED_K, THRESHOLD, VEC_DIM, drop_final_s, e6, lang_chain, lang_prepared
from .registry import register
from .stem_sql import STEM_BODY, stem_ctes

P = S.LANG
SPLIT = S.corpus_ctes("lang") + S.split_ctes(P["bottom_p"], P["full_k"], P["keep_p"], P["seed"])


def first_letter(word: str) -> list[int]:
    """One piece a word: its first code point, after the two markers."""
    return [2 + ord(word[0])]


def place_and_id(chunks: list[list[int]]) -> list[np.ndarray]:
    """Every position's vector is its place in the chunk and its piece."""
    return [np.stack([np.arange(len(c)), c], axis=1).astype(float) for c in chunks]


def last_word(prompts: list[str]) -> list[str]:
    """Answers a prompt with its last word, quoted and with a mark."""
    return [f"\"{p.split()[-1]}\"!" for p in prompts]


def refused(prompts: list[str]) -> list[str]:
    """A generator that must not be called."""
    raise AssertionError(f"{len(prompts)} prompts asked again")


@register("train_word_vectors", S.with_(S.corpus_ctes("lang"), """SELECT term, count(*) AS n_occ,
    CAST(16 AS INTEGER) AS n_dims FROM (SELECT unnest(tokens) AS term FROM prepared) GROUP BY term"""))
def train_word_vectors(spark, sf_dir):
    """MLlib Word2Vec over every token list of the corpus; the words it
    learned, their counts and the dimension of their vectors."""
    wv = em.train_word_vectors(lang_prepared(spark, sf_dir), vector_size=16, window=3, min_count=1,
                               epochs=2, alpha=0.025)
    return wv.select("term", "n_occ", F.size("vector").alias("n_dims"))


CBOW_SHARD, CBOW_RATE = 20_000, 0.001
SYMBOL = "CASE WHEN length(t) <= 2 THEN 'a' WHEN length(t) <= 4 THEN 'b' WHEN length(t) <= 7 THEN 'c' ELSE 'd' END"


def cbow_round(k: int) -> list[tuple[str, str]]:
    """Words ``v{k}(term, dim, x)`` and nodes ``y{k}(node, dim, x)`` to those of
    the next round: one batch a shard, then the mean over the shards."""
    return [
        (f"h{k}", f"""SELECT tri.*, d.dim, (coalesce(p.x, 0) + coalesce(q.x, 0)) / (CASE WHEN p.x IS NULL OR q.x IS NULL THEN 1 ELSE 2 END) AS h
            FROM tri CROSS JOIN (SELECT DISTINCT dim FROM v{k}) d LEFT JOIN v{k} p ON p.term = prev AND p.dim = d.dim
            LEFT JOIN v{k} q ON q.term = next AND q.dim = d.dim"""),
        (f"g{k}", f"""SELECT h.id, p.node, (1 - any_value(p.bit) - 1 / (1 + exp(-sum(h.h * y.x)))) * {CBOW_RATE} AS g
            FROM h{k} h JOIN paths p ON p.term = h.center JOIN y{k} y ON y.node = p.node AND y.dim = h.dim GROUP BY h.id, p.node"""),
        (f"ys{k}", f"SELECT h.shard, g.node, h.dim, sum(h.n * g.g * h.h) AS d FROM h{k} h JOIN g{k} g USING (id) GROUP BY ALL"),
        (f"y{k + 1}", f"SELECT y.node, y.dim, any_value(y.x) + avg(s.d) AS x FROM y{k} y JOIN ys{k} s ON s.node = y.node AND s.dim = y.dim GROUP BY y.node, y.dim"),
        (f"e{k}", f"SELECT g.id, y.dim, sum(g.g * y.x) AS e FROM g{k} g JOIN y{k} y USING (node) GROUP BY g.id, y.dim"),
        (f"vs{k}", f"""SELECT shard, term, dim, sum(n * e) AS d FROM (SELECT id, shard, n, prev AS term FROM tri UNION ALL
            SELECT id, shard, n, next FROM tri) JOIN e{k} USING (id) WHERE term IS NOT NULL GROUP BY ALL"""),
        (f"v{k + 1}", f"SELECT v.term, v.dim, any_value(v.x) + avg(s.d) AS x FROM v{k} v JOIN vs{k} s ON s.term = v.term AND s.dim = v.dim GROUP BY v.term, v.dim"),
    ]


_CBOW_SQL = S.with_(S.corpus_ctes("lang") + [
    ("tok", f"""SELECT doc_id, pos, pos // 10000 AS part, {SYMBOL} AS term FROM (
        SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared)"""),
    ("occ", "SELECT term, count(*) AS n_occ, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY term"),
    ("tree", """SELECT CASE WHEN sum(n_occ) FILTER (r > 2) < sum(n_occ) FILTER (r = 1) THEN 'deep' ELSE 'flat' END AS kind FROM occ"""),
    ("paths", """SELECT term, node, bit FROM occ JOIN (VALUES ('deep', 1, 1, 0), ('deep', 2, 1, 1), ('deep', 2, 3, 0), ('deep', 3, 1, 1),
        ('deep', 3, 3, 1), ('deep', 3, 7, 0), ('deep', 4, 1, 1), ('deep', 4, 3, 1), ('deep', 4, 7, 1), ('flat', 1, 1, 0), ('flat', 1, 2, 0),
        ('flat', 2, 1, 0), ('flat', 2, 2, 1), ('flat', 3, 1, 1), ('flat', 3, 3, 0), ('flat', 4, 1, 1), ('flat', 4, 3, 1)) AS b(kind, r, node, bit)
        USING (r) JOIN tree USING (kind)"""),
    ("near", """SELECT doc_id, part, term AS center, lag(term) OVER w AS prev, lead(term) OVER w AS next FROM tok
        WINDOW w AS (PARTITION BY doc_id, part ORDER BY pos)"""),
    ("tri", f"""SELECT row_number() OVER () AS id, * FROM (SELECT {S.hash32(42, "(CAST(doc_id AS VARCHAR) || '-' || CAST(part AS VARCHAR))")}
        % greatest(1, (SELECT (sum(n_occ) + {CBOW_SHARD - 1}) // {CBOW_SHARD} FROM occ)) AS shard, center, prev, next, count(*) AS n
        FROM near WHERE prev IS NOT NULL OR next IS NOT NULL GROUP BY ALL)"""),
    ("v0", f"SELECT term, unnest({S.hash_vector(chr(39) + '42-' + chr(39) + ' || term', 4)}) / 4 AS x, unnest(range(4)) AS dim FROM occ"),
    ("y0", "SELECT DISTINCT node, dim, 0.0 AS x FROM paths CROSS JOIN (SELECT DISTINCT dim FROM v0)"),
    *cbow_round(0), *cbow_round(1),
], f"SELECT term, n_occ, CAST(dim AS INTEGER) AS dim, {S.e6('x')} AS x_e6 FROM v2 JOIN occ USING (term)")


@register("cbow_steps", _CBOW_SQL)
def cbow_steps(spark, sf_dir):
    """Two rounds of the bag-of-words trainer over all texts, one batch a
    shard, on a vocabulary of four symbols (words by their length)."""
    def symbol(w):
        return (F.when(F.length(w) <= 2, "a").when(F.length(w) <= 4, "b").when(F.length(w) <= 7, "c").otherwise("d"))
    docs = lang_prepared(spark, sf_dir).select("doc_id", F.transform("tokens", symbol).alias("tokens"))
    v = train_cbow(docs, vector_size=4, window=1, min_count=1, alpha=CBOW_RATE, min_alpha=CBOW_RATE, epochs=2,
                   shard_tokens=CBOW_SHARD, batch=1 << 40)
    return v.select("term", "n_occ", F.posexplode("vector").alias("dim", "x")).select("term", "n_occ", "dim", e6("x").alias("x_e6"))


@register("cbow_vectors", S.with_(S.corpus_ctes("lang"), """SELECT term, count(*) AS n_occ, CAST(16 AS INTEGER) AS n_dims
    FROM (SELECT unnest(tokens) AS term FROM prepared) GROUP BY term HAVING count(*) >= 2"""))
def cbow_vectors(spark, sf_dir):
    """The bag-of-words trainer on the corpus; the words it learned, their
    counts and the dimension of their vectors."""
    v = train_cbow(lang_prepared(spark, sf_dir), vector_size=16, window=3, min_count=2, epochs=1)
    return v.select("term", "n_occ", F.size("vector").alias("n_dims"))


@register("contextual_vectors", S.with_(S.corpus_ctes("lang") + [
    ("w", "SELECT unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared"),
    ("c", "SELECT term, CASE WHEN pos < 510 THEN pos ELSE 255 + (pos - 510) % 255 END AS start FROM w"),
], f"""SELECT term, count(*) AS n_occ, {S.e6('avg(start + 1)')} AS place_e6, {S.e6('avg(2 + unicode(term))')} AS id_e6
       FROM c GROUP BY term HAVING count(*) >= 5"""))
def contextual_vectors(spark, sf_dir):
    """Every document cut into overlapping chunks and encoded,
    then the static vector per word (>= 5 uses)."""
    occ = em.contextual_vectors(lang_prepared(spark, sf_dir), first_letter, place_and_id, 2)
    return em.static_vectors(occ, 5, 2).select("term", "n_occ", e6(F.col("vector")[0]).alias("place_e6"),
                                            e6(F.col("vector")[1]).alias("id_e6"))


@register("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    """K-means, 10 restarts, on the embeddings."""
    v = fx.vectors(spark, sf_dir)
    return cl.kmeans(v.select("vec_id", "vector"), 10, restarts=10, seed=0).select("vec_id", "cluster", "prob")


EV = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
FIRST_IDS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x AS m FROM ev QUALIFY row_number() OVER (ORDER BY vec_id) <= "
SQ = "list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def first_vectors(v, k: int) -> np.ndarray:
    """The ``k`` vectors of the smallest ids."""
    return np.array([r["vector"] for r in v.orderBy("vec_id").limit(k).collect()])


def lloyd_ctes(rounds: int) -> list[tuple[str, str]]:
    """``m0(c, m)`` to assignments ``a{rounds}(vec_id, c)``, a round at a time."""
    out = []
    for i in range(rounds + 1):
        out.append((f"a{i}", f"""SELECT vec_id, any_value(x) AS x, arg_min(c, d) AS c, min(d) AS d
                    FROM (SELECT vec_id, x, c, {SQ} AS d FROM ev, m{i}) GROUP BY vec_id"""))
        if i < rounds:
            out += [(f"l{i}", f"SELECT c, k, avg(x[k]) AS v FROM a{i}, unnest(range(1, len(x) + 1)) AS r(k) GROUP BY c, k"),
                    (f"n{i}", f"SELECT c, list(v ORDER BY k) AS m FROM l{i} GROUP BY c"),
                    (f"m{i + 1}", f"SELECT c, coalesce(n{i}.m, m{i}.m) AS m FROM m{i} LEFT JOIN n{i} USING (c)")]
    return out


@register("kmeans_fixed_starts", S.with_([("ev", EV), ("m0", FIRST_IDS + "5"), *lloyd_ctes(3)],
                                         "SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM a3"))
def kmeans_fixed_starts(spark, sf_dir):
    """U1 from given starts: three rounds on all dimensions."""
    v = fx.vectors(spark, sf_dir).select("vec_id", "vector")
    return cl.kmeans(v, 5, starts=first_vectors(v, 5)[None], max_iter=3, tol=0.0).select("vec_id", "cluster")


@register("cluster_gmm")
def cluster_gmm(spark, sf_dir):
    """Gaussian mixture with full covariances, 10 restarts, on all
    dimensions of the embeddings."""
    v = fx.vectors(spark, sf_dir)
    return cl.gmm(v.select("vec_id", "vector"), 10, restarts=10, seed=0).select("vec_id", "cluster", "prob")


def em_ctes(rounds: int) -> list[tuple[str, str]]:
    """Two-dimensional mixtures: hard memberships ``p0(vec_id, u, v, c, p)``,
    then ``rounds`` of maximising and expecting."""
    out = [("p0", "SELECT vec_id, x[1] AS u, x[2] AS v, m0.c, CASE WHEN m0.c = a0.c THEN 1.0 ELSE 0.0 END AS p FROM a0, m0")]
    for i in range(rounds):
        out += [
            (f"mu{i}", f"""SELECT c, sum(p) AS n, sum(p * u) / sum(p) AS mu, sum(p * v) / sum(p) AS mv FROM p{i} GROUP BY c"""),
            (f"g{i}", f"""SELECT c, n, mu, mv, sum(p * (u - mu) * (u - mu)) / n + 1e-6 AS uu, sum(p * (v - mv) * (v - mv)) / n + 1e-6 AS vv,
                         sum(p * (u - mu) * (v - mv)) / n AS uv FROM p{i} JOIN mu{i} USING (c) GROUP BY c, n, mu, mv"""),
            (f"j{i}", f"""SELECT vec_id, u, v, c, ln(n / (sum(n) OVER (PARTITION BY vec_id))) - ln(2 * pi()) - 0.5 * ln(uu * vv - uv * uv)
                         - 0.5 * (vv * (u - mu) * (u - mu) - 2 * uv * (u - mu) * (v - mv) + uu * (v - mv) * (v - mv)) / (uu * vv - uv * uv) AS l
                         FROM (SELECT vec_id, u, v FROM p{i} WHERE c = 0), g{i}"""),
            (f"t{i}", f"SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM j{i}"),
            (f"p{i + 1}", f"SELECT vec_id, u, v, c, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY vec_id) AS p FROM t{i}"),
        ]
    return out


@register("gmm_em_steps", S.with_([("ev", "SELECT vec_id, CAST(embedding[1:2] AS DOUBLE[]) AS x FROM embeddings"),
                                   ("m0", FIRST_IDS + "3"), *lloyd_ctes(0), *em_ctes(3)],
                                  f"SELECT vec_id, CAST(c AS INTEGER) AS component, {S.e6('p')} AS p_e6 FROM p3"))
def gmm_em_steps(spark, sf_dir):
    """U2/U3 from fixed starts: two rounds of expectation maximisation on the
    first two dimensions, and the memberships they give."""
    v = fx.vectors(spark, sf_dir).select("vec_id", F.slice("vector", 1, 2).alias("vector"))
    rows = mx.numbered(v)
    shift = mx.mean_vector(rows)
    starts = mx.hard_start(rows, first_vectors(v, 3)[None], shift, 1e-6)
    mixtures, _ = mx.fit_mixtures(rows, starts, shift, max_iter=2, tol=0.0)
    p = mx.with_memberships(v, mixtures[0], shift)
    return p.select("vec_id", F.posexplode("prob").alias("component", "p")).select("vec_id", "component", e6("p").alias("p_e6"))


@register("self_topk", S.with_([("ev", EV), ("unit", """SELECT vec_id, list_transform(x, lambda v: v / greatest(sqrt(list_sum(list_transform(x,
    lambda w: w * w))), 1e-12)) AS x FROM ev"""), ("sims", "SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.x, b.x) AS sim FROM unit a, unit b")],
    f"""SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS INTEGER) AS rank, neighbour, {S.e6('sim')} AS sim_e6
    FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) <= 8"""))
def self_topk(spark, sf_dir):
    """V3 of the corpus against itself: the 8 most similar vectors of each."""
    v = fx.vectors(spark, sf_dir).select("vec_id", "vector")
    return sim.self_topk(v).select("vec_id", "rank", "neighbour", e6("sim").alias("sim_e6"))


@register("pca_project")
def pca_project(spark, sf_dir):
    """Centred PCA to 8 dimensions, fitted on the embeddings, applied
    to them and to their label centroids."""
    v = fx.vectors(spark, sf_dir)
    model = cl.pca_fit(v, 8)
    cent = em.mean_vectors(v, ["label"]).drop("_rows")
    docs = cl.pca_project(model, v.select(F.col("vec_id").alias("id"), "vector")).withColumn("kind", F.lit("vector"))
    cls = cl.pca_project(model, cent.select(F.col("label").cast("bigint").alias("id"), "vector")).withColumn(
        "kind", F.lit("centroid"))
    return docs.unionByName(cls)


@register("pca_norms", S.with_([
    ("ev", "SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings"),
    ("mean", "SELECT dim, avg(x) AS m FROM ev GROUP BY dim"),
], f"SELECT vec_id, {S.e6('sum((x - m) * (x - m))')} AS norm2_e6 FROM ev JOIN mean USING (dim) GROUP BY vec_id"))
def pca_norms(spark, sf_dir):
    """U5/U6 at full rank: the projection keeps the centred vectors' lengths."""
    v = fx.vectors(spark, sf_dir).select("vec_id", "vector")
    _, proj = cl.pca_fit_transform(v, v.select(F.max(F.size("vector"))).first()[0])
    return proj.select("vec_id", e6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2_e6"))


@register("pca_variance", f"""WITH e AS (SELECT embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings),
    c AS (SELECT var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS d FROM e),
    l AS (SELECT (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + b * b) AS r FROM c)
    SELECT 0 AS component, {S.e6('m + r')} AS variance_e6 FROM l UNION ALL SELECT 1, {S.e6('m - r')} FROM l""")
def pca_variance(spark, sf_dir):
    """U5 by subspace rounds: the variances of the first two dimensions' components."""
    v = fx.vectors(spark, sf_dir).select("vec_id", F.slice("vector", 1, 2).alias("vector"))
    fit = cl.subspace_pca(v, 2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(fit.variance)], "component int, x double").select(
        "component", e6("x").alias("variance_e6"))


@register("projection_2d")
def projection_2d(spark, sf_dir):
    """V10 (data part): unconfident documents in 2-D (centred PCA), with the
    hidden truth collapsed to removed labels and 'Others'."""
    c = lang_chain(spark, sf_dir)
    judged = c["unlabeled"].select("doc_id", "label").join(c["scored"].select("doc_id", "is_confident"), "doc_id")
    # read by the fit and the projection
    unc = cut_lineage(judged.where(~F.col("is_confident")).join(c["doc_vectors"], "doc_id"), "unconfident-vectors")
    model = cl.pca_fit(unc, 2)
    proj = cl.pca_project(model, unc.select("doc_id", "label", "vector"))
    unseen = c["split"].select("label").distinct().join(c["existing"], "label", "left_anti")
    out = sim.collapse_truth(proj, unseen)
    return out.select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), "label")


_NAMED_SQL = S.with_(SPLIT + S.vector_ctes(VEC_DIM, MIN_COUNT, SEED_K, THRESHOLD) + [
    ("p", f"""SELECT doc_id, tokens, class_idx AS cluster, {S.e6('max_sim')} AS p FROM scored
              WHERE NOT is_confident AND class_idx IS NOT NULL"""),
    ("t", "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, doc_id) AS rn FROM p"),
    ("edges", "SELECT cluster, max(p) = min(p) AS tied FROM t WHERE rn <= 25 GROUP BY cluster"),
    ("ranked", f"""SELECT p.cluster, p.tokens[-1] AS word, row_number() OVER (PARTITION BY cluster ORDER BY p.p DESC,
                     CASE WHEN tied THEN {S.hash32(42, 'doc_id')} ELSE 0 END, doc_id) AS rank
                   FROM p JOIN edges USING (cluster)"""),
    ("topics", f"""SELECT cluster, rank, {S.strip_punct(f"regexp_replace(word, {S.q(tx.QUOTE_PATTERN)}, '', 'g')")} AS topic
                   FROM ranked WHERE rank <= 25"""),
    ("last", "SELECT cluster, max(rank) AS rank FROM topics GROUP BY cluster"),
], """SELECT cluster, CASE WHEN topic = '' THEN CAST(rank AS VARCHAR) ELSE topic END AS name
      FROM topics JOIN last USING (cluster, rank)""")


@register("label_with_callable", _NAMED_SQL)
def label_with_callable(spark, sf_dir):
    """Cluster samples (U4) -> topic per document -> one name per
    cluster, through a caller's generator."""
    c = lang_chain(spark, sf_dir)
    unc = c["unconfident"].where(F.col("cluster").isNotNull())
    samples = cl.cluster_samples(unc.select("doc_id", "cluster", (e6("max_sim") / 1e6).alias("prob")), k=25)
    return nm.generate_cluster_labels(samples, unc, c["existing"], last_word)


@register("answers_are_kept", f"""SELECT doc_id, array_to_string(regexp_extract_all(regexp_extract({S.q(nm.DOC_PROMPT)} || trim(text), '([^ \t\n\r]+)$', 1), '[^!-/:-@\\[-`{{-~]'), '') AS topic,
    0 AS asked_again FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE trim(text) <> ''""")
def answers_are_kept(spark, sf_dir):
    """Every document's prompt answered and kept by its digest; the second
    pass, whose generator refuses, gives the same answers from the store."""
    docs = fx.table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.trim("text").alias("text"))
    store = f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    prompts = nm.doc_prompts(docs)
    nm.complete(prompts, last_word, ["doc_id"], answers=store).write.format("noop").mode("overwrite").save()
    return nm.complete(prompts, refused, ["doc_id"], answers=store).select(
        "doc_id", F.col("completion").alias("topic"), F.lit(0).alias("asked_again"))


@register("stem_vocabulary", S.with_(S.corpus_ctes("lang") + [
    ("voc", "SELECT DISTINCT term FROM (SELECT unnest(tokens) AS term FROM prepared)"), *stem_ctes()], STEM_BODY))
def stem_vocabulary(spark, sf_dir):
    """T4: the Snowball English stemmer over the corpus vocabulary."""
    from ..operators.stemming import stem_column
    vocab = lang_prepared(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct()
    return vocab.select("term", stem_column(F.col("term")).alias("stem"))


RUN = (SPLIT + S.vector_ctes(VEC_DIM, MIN_COUNT, 3, THRESHOLD, strict=True)
       + S.naming_ctes("CASE WHEN class_idx IS NOT NULL THEN 0 END"))


def _word_vectors(spark, sf_dir):
    """The supplied vector table: hash vectors of the corpus vocabulary."""
    from ..operators.preprocess import prepare_corpus
    vocab = em.min_count_vocab(prepare_corpus(fx.corpus_lang(spark, sf_dir), remove_stopwords=False), MIN_COUNT)
    return cut_lineage(fx.hash_word_vectors(vocab, VEC_DIM), "word-vectors")


def _run(spark, sf_dir):
    """The reference's test run on the language corpus with a supplied
    vector table; with its one cluster every step can be said in SQL."""
    from .runner import run_model
    return run_model(fx.corpus_lang(spark, sf_dir), "test", threshold=THRESHOLD, stemmer=drop_final_s,
                     word_vectors=_word_vectors(spark, sf_dir))


@register("end_to_end_predictions", S.with_(RUN, """SELECT doc_id, truth AS label, prediction, is_confident,
    array_to_string(u.tokens, ' ') AS text FROM preds JOIN unl u USING (doc_id)"""))
def end_to_end_predictions(spark, sf_dir):
    return _run(spark, sf_dir)["predictions"].select("doc_id", "label", "prediction", "is_confident", "text")


@register("rerun_reuses", S.with_(RUN, """SELECT doc_id, truth AS label, prediction, is_confident, 0 AS stages_written
    FROM preds"""))
def rerun_reuses(spark, sf_dir):
    """The second of two runs over one store; it computes no stage."""
    from .runner import run_model
    wv, store = _word_vectors(spark, sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    for _ in range(2):
        out = run_model(fx.corpus_lang(spark, sf_dir), "test", threshold=THRESHOLD, stemmer=drop_final_s, word_vectors=wv, store=store)
    return out["predictions"].select("doc_id", "label", "prediction", "is_confident", F.lit(len(out["written"])).alias("stages_written"))


@register("end_to_end_f1", S.with_(RUN + F1_CTES, F1_BODY))
def end_to_end_f1(spark, sf_dir):
    return _run(spark, sf_dir)["f1_existing"]


@register("end_to_end_new_labels", S.with_(RUN + NEW_CTES, NEW_BODY))
def end_to_end_new_labels(spark, sf_dir):
    return _run(spark, sf_dir)["new_label_metrics"]


# The baseline and final presets on the corpus labelled by source. What the
# mixture decides is left out: the predictions of unconfident documents.
BASE = (S.corpus_ctes("source", remove_stopwords=True) + S.split_ctes(0.5, 5, 0.1, 42))
KNOWN = """SELECT s.doc_id, s.label, CASE WHEN s.is_confident THEN s.best_label END AS prediction, s.is_confident,
    array_to_string(s.tokens, ' ') AS text FROM scored s"""


def _decided(out):
    p = out["predictions"]
    return p.select("doc_id", "label", F.when(F.col("is_confident"), F.col("prediction")).alias("prediction"), "is_confident", "text")


@register("end_to_end_baseline", S.with_(BASE + S.vector_ctes(VEC_DIM, MIN_COUNT, 10, THRESHOLD), KNOWN))
def end_to_end_baseline(spark, sf_dir):
    """The baseline preset with a mixture of 5 fitted to the unconfident
    documents, and a supplied vector table, made of the tokens of the split."""
    from .runner import run_model

    def supplied(split):
        return fx.hash_word_vectors(em.min_count_vocab(split, MIN_COUNT), VEC_DIM)
    return _decided(run_model(fx.corpus_source(spark, sf_dir), "baseline", threshold=THRESHOLD, stemmer=drop_final_s,
                              word_vectors=supplied))


FINAL_THRESHOLD = 0.9
# At full rank the projection turns the centred vectors, so cosines are those of the centred vectors.
FINAL = BASE + S.class_tfidf_ctes() + S.top_ctes("tfidf", 10, False) + S.seed_ctes("top", 10) + [
    ("occ", "SELECT unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM split"),
    ("placed", f"""SELECT {S.strip_punct('word')} AS term, 2 + unicode(word) AS id,
        1 + CASE WHEN pos < 510 THEN pos ELSE 255 + (pos - 510) % 255 END AS place FROM occ"""),
    ("wv", "SELECT term, avg(place) AS a, avg(id) AS b FROM placed WHERE term <> '' GROUP BY term HAVING count(*) >= 5"),
    ("dv", "SELECT doc_id, avg(a) AS a, avg(b) AS b FROM (SELECT doc_id, unnest(tokens) AS term FROM split) JOIN wv USING (term) GROUP BY doc_id"),
    ("mean", "SELECT avg(a) AS ma, avg(b) AS mb FROM dv"),
    ("cv", """SELECT e.class_idx, e.label, avg(a) - any_value(ma) AS a, avg(b) - any_value(mb) AS b
        FROM seeds JOIN wv USING (term) JOIN existing e USING (label), mean GROUP BY e.class_idx, e.label"""),
    ("unl", "SELECT doc_id, label, tokens FROM split WHERE split = 'unlabeled'"),
    ("best", """SELECT doc_id, max(sim) AS max_sim, arg_max(label, sim) AS best_label FROM (
        SELECT d.doc_id, c.label, ((d.a - ma) * c.a + (d.b - mb) * c.b)
          / (greatest(sqrt((d.a - ma) * (d.a - ma) + (d.b - mb) * (d.b - mb)), 1e-12) * greatest(sqrt(c.a * c.a + c.b * c.b), 1e-12)) AS sim
        FROM dv d, mean, cv c) GROUP BY doc_id"""),
    ("scored", f"""SELECT u.doc_id, u.label, u.tokens, b.best_label, coalesce(b.max_sim >= {FINAL_THRESHOLD}, false) AS is_confident
        FROM unl u LEFT JOIN best b USING (doc_id)"""),
]


@register("end_to_end_final", S.with_(FINAL, KNOWN))
def end_to_end_final(spark, sf_dir):
    """The final preset: contextual vectors from a caller's encoder, PCA
    (at full rank), a mixture of 5."""
    from .runner import run_model
    return _decided(run_model(fx.corpus_source(spark, sf_dir), "final", threshold=FINAL_THRESHOLD, pieces_of=first_letter,
                              encode=place_and_id, dim=2, pca_dim=2))
