"""Checks for word, document and class vectors and for similarity (E, V)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import embeddings as em
from ..operators import similarity as sim
from ..operators.clusters import cluster_samples as _cluster_samples
from ..operators.pieces import chunk_pieces, word_pieces
from ..session import checkpoint_dir
from ..sources import corpus as src
from ..sources import fixtures as fx
from . import sqlparts as S
from .common import MIN_COUNT, SEED_K, THRESHOLD, VEC_DIM, drop_final_s, e6, lang_chain, lang_prepared
from .registry import ORACLES, register

P = S.LANG
SPLIT = S.corpus_ctes("lang") + S.split_ctes(P["bottom_p"], P["full_k"], P["keep_p"], P["seed"])
CHAIN = SPLIT + S.vector_ctes(VEC_DIM, MIN_COUNT, SEED_K, THRESHOLD)


def _long(df, keys, vec="vector", out="x_e6"):
    """Vectors as rows ``(keys..., dim, x_e6)``; a NULL vector gives one row of NULLs."""
    return df.select(*keys, F.posexplode_outer(vec).alias("dim", "_x")).select(
        *keys, F.col("dim").cast("int").alias("dim"), e6("_x").alias(out))


# ------------------------------------------------------------- vocabulary

@register("min_count_vocab", S.with_(CHAIN, "SELECT term, n_occ FROM vocab"))
def min_count_vocab(spark, sf_dir):
    return lang_chain(spark, sf_dir)["vocab"]


_TEXT_VEC_SQL = S.with_(CHAIN, f"""SELECT term, len(vector) AS n_dims,
    {S.e6('list_sum(vector)')} AS sum_e6, {S.e6('list_sum(list_transform(vector, lambda x: x * x))')} AS sumsq_e6
    FROM wv""")


def _vec_summary(df, vec="vector"):
    return df.select("term", F.size(vec).alias("n_dims"),
                     e6(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)).alias("sum_e6"),
                     e6(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)).alias("sumsq_e6"))


@register("load_text_vectors", _TEXT_VEC_SQL)
def load_text_vectors(spark, sf_dir):
    """Vectors written in the ``word v1 ... vn`` text format to the
    shared checkpoint folder and read back."""
    wv = lang_chain(spark, sf_dir)["word_vectors"]
    path = f"{checkpoint_dir(spark).rstrip('/')}/text-vectors-{uuid.uuid4().hex}"
    src.write_text_vectors(wv, path)
    return _vec_summary(src.read_text_vectors(spark, path))


@register("reload_word_vectors", _TEXT_VEC_SQL)
def reload_word_vectors(spark, sf_dir):
    """Vectors saved with their settings and loaded again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/word-vectors-{uuid.uuid4().hex}"
    src.save_word_vectors(lang_chain(spark, sf_dir)["word_vectors"], path, {"dim": VEC_DIM})
    return _vec_summary(src.load_word_vectors(spark, path))


@register("reload_split", S.with_(SPLIT, """SELECT doc_id, split, label, len(tokens) AS n_tokens,
    array_to_string(tokens, ' ') AS text FROM split"""))
def reload_split(spark, sf_dir):
    """Both parts saved and each read back on its own."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/split-parts-{uuid.uuid4().hex}"
    src.write_split(lang_chain(spark, sf_dir)["split"], path)
    both = src.read_split(spark, path, "labeled").unionByName(src.read_split(spark, path, "unlabeled"))
    return both.select("doc_id", "split", "label", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("text"))


# ----------------------------------------------------------- doc / class

_DV_SQL = S.with_(CHAIN, f"""SELECT doc_id, CAST(dim AS INTEGER) AS dim, {S.e6('x')} AS x_e6 FROM dv_long
    UNION ALL SELECT doc_id, NULL, NULL FROM unl WHERE doc_id NOT IN (SELECT doc_id FROM dv_long)""")


@register("doc_vectors", _DV_SQL)
def doc_vectors(spark, sf_dir):
    return _long(lang_chain(spark, sf_dir)["doc_vectors"], ["doc_id"])


_DV0_SQL = S.with_(CHAIN + [
    ("zs", "SELECT d.doc_id, w.dim, sum(d.n * w.x) AS s FROM dt d JOIN wv_long w USING (term) GROUP BY d.doc_id, w.dim"),
], f"""SELECT u.doc_id, CAST(r.range AS INTEGER) AS dim, {S.e6('coalesce(zs.s, 0.0) / len(u.tokens)')} AS x_e6
       FROM unl u CROSS JOIN range({VEC_DIM}) r LEFT JOIN zs ON zs.doc_id = u.doc_id AND zs.dim = r.range
       WHERE len(u.tokens) > 0
       UNION ALL SELECT doc_id, NULL, NULL FROM unl WHERE len(tokens) = 0""")


@register("doc_vectors_zero_oov", _DV0_SQL)
def doc_vectors_zero_oov(spark, sf_dir):
    c = lang_chain(spark, sf_dir)
    unl = c["split"].where("split = 'unlabeled'")
    return _long(em.doc_vectors(unl, c["word_vectors"], oov="zero"), ["doc_id"])


@register("class_vectors", S.with_(CHAIN, f"""SELECT label, class_idx, CAST(dim AS INTEGER) AS dim,
    {S.e6('x')} AS x_e6, n_seeds_found FROM cv_long"""))
def class_vectors(spark, sf_dir):
    cv = lang_chain(spark, sf_dir)["class_vectors"]
    return (cv.select("label", "class_idx", "n_seeds_found", F.posexplode("vector").alias("dim", "_x"))
            .select("label", "class_idx", F.col("dim").cast("int").alias("dim"), e6("_x").alias("x_e6"),
                    "n_seeds_found"))


_STATIC_SQL = S.with_(S.corpus_ctes("lang") + [
    ("occ", "SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared"),
    ("occ_v", f"SELECT term, {S.hash_vector(chr(40) + 'term || ' + S.q('@') + ' || CAST(pos % 3 AS VARCHAR))', VEC_DIM)} AS v FROM occ"),
    ("occ_long", "SELECT term, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM occ_v"),
    ("counts", "SELECT term, count(*) AS n_occ FROM occ GROUP BY term HAVING count(*) >= 5"),
    ("means", "SELECT term, dim, avg(x) AS x FROM occ_long WHERE term IN (SELECT term FROM counts) GROUP BY term, dim"),
], f"""SELECT m.term, c.n_occ, {S.e6('sum(m.x)')} AS sum_e6, {S.e6('sum(m.x * m.x)')} AS sumsq_e6
       FROM means m JOIN counts c USING (term) GROUP BY m.term, c.n_occ""")


@register("static_vectors", _STATIC_SQL)
def static_vectors(spark, sf_dir):
    """E11/E14/E15 over per-occurrence vectors that SQL can repeat (the
    word's hash vector, varied by position mod 3)."""
    st = em.static_vectors(_hash_occurrences(spark, sf_dir), 5, VEC_DIM)
    return (st.select("term", "n_occ", e6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("sum_e6"),
                      e6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("sumsq_e6")))


_CHUNK_SQL = S.with_(S.corpus_ctes("lang") + [
    ("w", "SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared"),
    ("c", """SELECT doc_id, pos,
               CASE WHEN pos < 510 THEN 0 ELSE 1 + (pos - 510) // 255 END AS chunk,
               CASE WHEN pos < 510 THEN pos ELSE 255 + (pos - 510) % 255 END AS start FROM w"""),
], """SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS n_words, CAST(min(pos) AS INTEGER) AS first_pos,
         CAST(max(pos) AS INTEGER) AS last_pos, CAST(max(start) + 1 AS INTEGER) AS max_end FROM c GROUP BY doc_id, chunk""")


def _hash_occurrences(spark, sf_dir):
    """One hash vector per distinct key, joined to its occurrences."""
    occ = (lang_prepared(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "term"))
           .withColumn("key", F.concat("term", F.lit("@"), (F.col("pos") % 3).cast("string"))))
    keys = occ.select("key").distinct().withColumn("vector", vx.hash_vector(F.col("key"), VEC_DIM))
    return occ.join(keys, "key")


_OCC = S.corpus_ctes("lang") + [
    ("occ", "SELECT unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared"),
]


@register("token_vector_sums", S.with_(_OCC + [
    ("kinds", "SELECT term, pos % 3 AS k, count(*) AS n FROM occ GROUP BY ALL"),
    ("v", f"SELECT term, n, list_sum({S.hash_vector(chr(40) + 'term || ' + S.q('@') + ' || CAST(k AS VARCHAR))', VEC_DIM)}) AS x FROM kinds"),
], f"SELECT term, CAST(sum(n) AS BIGINT) AS n_occ, {S.e6('sum(n * x)')} AS sum_e6 FROM v GROUP BY term"))
def token_vector_sums(spark, sf_dir):
    """Count and vector sum of every word's occurrences."""
    got = em.collect_vocab(_hash_occurrences(spark, sf_dir), VEC_DIM)
    return got.select("term", "n_occ", e6(F.aggregate("vector_sum", F.lit(0.0), lambda a, x: a + x)).alias("sum_e6"))


@register("static_coverage", S.with_(_OCC + [("n", "SELECT term, count(*) AS n FROM occ GROUP BY term")],
                                     "SELECT count(*) FILTER (n >= 5) AS kept, count(*) AS total FROM n"))
def static_coverage(spark, sf_dir):
    """Words kept by the minimum, and all words."""
    return em.static_coverage(lang_prepared(spark, sf_dir).select(F.explode("tokens").alias("term")), 5)


@register("chunk_tokens", _CHUNK_SQL)
def chunk_tokens(spark, sf_dir):
    """E8 with one piece per word (closed form of the sliding window)."""
    return _chunks(lang_prepared(spark, sf_dir))


# The check's vocabulary: beginnings of one to three letters and pairs at the third place that are frequent, and single
# letters inside words but for q, so that words have several pieces and some have none.
_PIECE_SQL = S.with_(S.corpus_ctes("lang") + [
    ("occ", "SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM prepared) GROUP BY token"),
    ("pieces", """SELECT piece FROM (SELECT left(token, k) AS piece, n FROM occ, (VALUES (1), (2), (3)) AS l(k) WHERE length(token) >= k)
        GROUP BY piece HAVING sum(n) >= 20
        UNION SELECT '##' || substr(token, 3, 2) FROM occ WHERE length(token) >= 4 GROUP BY substr(token, 3, 2) HAVING sum(n) >= 20
        UNION SELECT DISTINCT '##' || c FROM (SELECT unnest(string_split(token, '')) AS c FROM occ) WHERE c NOT IN ('q', '')"""),
    ("walk", """WITH RECURSIVE s(token, place, n) AS (
        SELECT token, 0, 0 FROM occ WHERE length(token) <= 100
        UNION ALL
        SELECT token, place + max(k), n + 1 FROM s, (VALUES (1), (2), (3)) AS l(k)
        JOIN pieces ON piece = CASE WHEN place = 0 THEN '' ELSE '##' END || substr(token, place + 1, k)
        WHERE place + k <= length(token) GROUP BY token, place, n)
        SELECT token, n FROM s WHERE place = length(token)"""),
    ("w", """SELECT doc_id, pos, coalesce(walk.n, 1) AS n, sum(coalesce(walk.n, 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS e
        FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM prepared) LEFT JOIN walk USING (token)"""),
    ("cuts", """WITH RECURSIVE c(doc_id, chunk, origin, since) AS (
        SELECT DISTINCT doc_id, 0, 0::HUGEINT, -1 FROM w
        UNION ALL
        SELECT c.doc_id, chunk + 1, greatest(origin, arg_min(e - n, pos) - 255), min(pos) FROM c JOIN w ON w.doc_id = c.doc_id
        WHERE pos > since AND e - origin > 510 GROUP BY c.doc_id, chunk, origin)
        SELECT * FROM c"""),
    ("placed", "SELECT w.doc_id, w.pos, chunk, e - origin AS fin FROM w ASOF JOIN cuts ON w.doc_id = cuts.doc_id AND w.pos >= cuts.since"),
], """SELECT doc_id, chunk, count(*) AS n_words, CAST(min(pos) AS INTEGER) AS first_pos, CAST(max(pos) AS INTEGER) AS last_pos,
      CAST(max(fin) AS INTEGER) AS max_end FROM placed GROUP BY doc_id, chunk""")


@register("chunk_word_pieces", _PIECE_SQL)
def chunk_word_pieces(spark, sf_dir):
    """E8 with words of several pieces, from a vocabulary table."""
    docs = lang_prepared(spark, sf_dir)
    occ = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    starts = occ.select(F.explode(F.array(*(F.when(F.length("token") >= k, F.left("token", F.lit(k))) for k in (1, 2, 3)))).alias("piece"), "n")
    pairs = occ.where(F.length("token") >= 4).select(F.concat(F.lit("##"), F.substring("token", 3, 2)).alias("piece"), "n")
    frequent = starts.where("piece is not null").union(pairs).groupBy("piece").agg(F.sum("n").alias("n")).where("n >= 20").select("piece")
    letters = occ.select(F.explode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("c")).select(
        F.concat(F.lit("##"), "c").alias("piece"))
    pieces = frequent.union(letters.where("piece <> '##q'")).union(spark.createDataFrame([("[UNK]",)], "piece string")).distinct()
    vocabulary = pieces.select("piece", F.xxhash64("piece").alias("id"))
    w = chunk_pieces(docs, word_pieces(vocabulary))
    return (w.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").alias("first_pos"),
                                             F.max("pos").alias("last_pos"), F.max("end").alias("max_end")))


@register("reload_chunks", _CHUNK_SQL)
def reload_chunks(spark, sf_dir):
    """The chunk table as a stage's output, asked for twice: the second
    time it is read, not computed."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
    config = {"max_pieces": em.MAX_PIECES, "carry": em.CARRY_OVER}
    _, first = src.cached_stage(spark, root, "chunks", config, lambda: _chunks(lang_prepared(spark, sf_dir)))

    def again():
        raise AssertionError("an unchanged stage was computed again")
    out, second = src.cached_stage(spark, root, "chunks", config, again)
    assert first == second
    return out


def _chunks(d):
    w = d.select("doc_id", F.posexplode(em.chunk_positions(F.size("tokens"))).alias("pos", "c"))
    return (w.groupBy("doc_id", F.col("c.chunk").alias("chunk"))
            .agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").cast("int").alias("first_pos"),
                 F.max("pos").cast("int").alias("last_pos"), F.max("c.end").cast("int").alias("max_end")))


# ------------------------------------------------------------- lookups

def _bench_tokens(spark, sf_dir):
    b = fx.short_text(spark, sf_dir)
    return b.select("item_id", tx.tokenize(tx.clean_text(F.col("text"))).alias("t"))


def _pairs(t):
    return F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(0), F.size(t) - 2),
                                              lambda i: F.struct(t[i].alias("u"), t[i + 1].alias("v")))
                  ).otherwise(F.array().cast("array<struct<u:string,v:string>>"))


_BENCH = [
    ("bt", f"SELECT item_id, {S.tokenize(S.clean('text'))} AS t FROM benchmark"),
    ("bpairs", """SELECT DISTINCT p.u, p.v FROM (SELECT unnest(list_transform(range(1, len(t)),
                    lambda i: {'u': t[i], 'v': t[i + 1]})) AS p FROM bt)"""),
    ("bterms", "SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM bt UNION ALL SELECT u || '_' || v FROM bpairs)"),
]

_LOOKUP_SQL = S.with_(CHAIN + _BENCH + S.lookup_ctes("bterms", "found"), f"""SELECT term, CAST(dim AS INTEGER) AS dim, {S.e6('x')} AS x_e6 FROM found
       UNION ALL SELECT term, NULL, NULL FROM bterms WHERE term NOT IN (SELECT term FROM found)""")


@register("word_lookup", _LOOKUP_SQL)
def word_lookup(spark, sf_dir):
    """Benchmark words and '_' compounds of neighbouring words looked
    up in the corpus vectors (exact, else stem, else mean of the pieces)."""
    wv = lang_chain(spark, sf_dir)["word_vectors"]
    t = _bench_tokens(spark, sf_dir)
    pairs = t.select(F.explode(_pairs(F.col("t"))).alias("p"))
    terms = (t.select(F.explode("t").alias("term"))
             .union(pairs.select(F.concat(F.col("p.u"), F.lit("_"), F.col("p.v")).alias("term"))).distinct())
    return _long(em.word_lookup(terms, wv, drop_final_s), ["term"])


_PAIR_SQL = S.with_(CHAIN + _BENCH + S.lookup_ctes("bterms", "found") + [
    ("pc", """SELECT p.u, p.v, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c
              FROM bpairs p JOIN found a ON a.term = p.u JOIN found b ON b.term = p.v AND b.dim = a.dim
              GROUP BY p.u, p.v"""),
], f"""SELECT p.u, p.v, {S.e6('pc.c')} AS cosine_e6 FROM bpairs p LEFT JOIN pc USING (u, v)""")


@register("word_pair_cosine", _PAIR_SQL)
def word_pair_cosine(spark, sf_dir):
    """V9: neighbouring word pairs of the benchmark texts."""
    wv = lang_chain(spark, sf_dir)["word_vectors"]
    pairs = (_bench_tokens(spark, sf_dir).select(F.explode(_pairs(F.col("t"))).alias("p"))
             .select("p.u", "p.v").distinct())
    out = sim.word_pair_cosine(pairs, wv, drop_final_s)
    return out.select("u", "v", e6("cosine").alias("cosine_e6"))


# --------------------------------------------------------- classification

@register("classify_cosine", S.with_(CHAIN, f"""SELECT doc_id, class_idx, best_label,
    {S.e6('max_sim')} AS max_sim_e6, is_confident FROM scored"""))
def classify_cosine(spark, sf_dir):
    s = lang_chain(spark, sf_dir)["scored"]
    return s.select("doc_id", "class_idx", "best_label", e6("max_sim").alias("max_sim_e6"), "is_confident")


@register("classify_blocked", S.with_(CHAIN, f"""SELECT doc_id, class_idx, best_label,
    {S.e6('max_sim')} AS max_sim_e6 FROM scored"""))
def classify_blocked(spark, sf_dir):
    """V2/V4 with a block a class and gaps in the indices."""
    c = lang_chain(spark, sf_dir)
    gapped = c["class_vectors"].withColumn("class_idx", F.col("class_idx") * 7 + 3)
    s = sim.classify(c["doc_vectors"], gapped, max_broadcast_bytes=8 * VEC_DIM)
    return s.select("doc_id", ((F.col("class_idx") - 3) / 7).cast("int").alias("class_idx"), "best_label",
                    e6("max_sim").alias("max_sim_e6"))


@register("confidence_split", S.with_(CHAIN, """SELECT doc_id,
    CASE WHEN is_confident THEN 'confident' ELSE 'unconfident' END AS part FROM scored"""))
def confidence_split(spark, sf_dir):
    s = lang_chain(spark, sf_dir)["scored"]
    return s.select("doc_id", F.when(F.col("is_confident"), "confident").otherwise("unconfident").alias("part"))


def _hist_sql(src_sql: str) -> list[tuple[str, str]]:
    edge = "CASE WHEN {i} = 10 THEN mx ELSE {i} * ((mx - mn) / 10.0::DOUBLE) + mn END"
    return [
        ("hx", src_sql),
        ("rng", """SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS mn,
                          CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS mx FROM hx"""),
        ("h0", """SELECT x, mn, mx, CASE WHEN r >= 10 THEN 9 ELSE r END AS i0 FROM (
                    SELECT x, mn, mx, CAST(floor((x - mn) * (10.0::DOUBLE / (mx - mn))) AS INTEGER) AS r FROM hx, rng)"""),
        ("h1", f"SELECT x, mn, mx, CASE WHEN x < {edge.format(i='i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM h0"),
        ("h2", f"""SELECT CASE WHEN x >= {edge.format(i='(i1 + 1)')} AND i1 <> 9 THEN i1 + 1 ELSE i1 END AS bin FROM h1"""),
        ("hc", "SELECT bin, count(*) AS n FROM h2 GROUP BY bin"),
        ("hist", f"""SELECT CAST(g.range AS INTEGER) AS bin, {edge.format(i='g.range')} AS lo,
                       {edge.format(i='(g.range + 1)')} AS hi, coalesce(hc.n, 0) AS count
                     FROM range(10) g CROSS JOIN rng LEFT JOIN hc ON hc.bin = g.range"""),
    ]


_HIST_BODY = f"""SELECT bin, {S.e6('lo')} AS lo_e6, {S.e6('hi')} AS hi_e6, count,
    round_even(sum(count) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(count) OVER () * 100.0, 1) AS cum_pct
    FROM hist"""


@register("similarity_histogram", S.with_(CHAIN + _hist_sql("SELECT max_sim AS x FROM scored WHERE max_sim IS NOT NULL"),
                                          _HIST_BODY))
def similarity_histogram(spark, sf_dir):
    h = sim.similarity_histogram(lang_chain(spark, sf_dir)["scored"])
    return h.select("bin", e6("lo").alias("lo_e6"), e6("hi").alias("hi_e6"), "count", "cum_pct")


# ------------------------------------------------------- vector fixture

_EMB = [
    ("ev", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
    ("ev_long", "SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM ev"),
    ("cent", "SELECT label AS class_idx, dim, avg(x) AS x FROM ev_long GROUP BY label, dim"),
    ("en", "SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM ev_long GROUP BY vec_id"),
    ("cnn", "SELECT class_idx, sqrt(sum(x * x)) AS nrm FROM cent GROUP BY class_idx"),
    ("esims", """SELECT e.vec_id, c.class_idx, sum((e.x / greatest(en.nrm, 1e-12)) * (c.x / greatest(cnn.nrm, 1e-12))) AS sim
                 FROM ev_long e JOIN en USING (vec_id) JOIN cent c USING (dim) JOIN cnn ON cnn.class_idx = c.class_idx
                 GROUP BY e.vec_id, c.class_idx"""),
    ("own", """SELECT e.vec_id, e.label, sum(e.x * c.x) / (en.nrm * cnn.nrm) AS cos
               FROM ev_long e JOIN en USING (vec_id) JOIN cent c ON c.class_idx = e.label AND c.dim = e.dim
               JOIN cnn ON cnn.class_idx = e.label GROUP BY e.vec_id, e.label, en.nrm, cnn.nrm"""),
]


def _centroids(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    cent = em.mean_vectors(v, ["label"]).select(F.col("label").cast("int").alias("class_idx"),
                                                F.col("label").cast("string").alias("label"), "vector")
    return v, cent


@register("normalize_vectors", S.with_(_EMB, f"""SELECT e.vec_id, CAST(e.dim AS INTEGER) AS dim,
    {S.e6('e.x / greatest(en.nrm, 1e-12)')} AS x_e6 FROM ev_long e JOIN en USING (vec_id)"""))
def normalize_vectors(spark, sf_dir):
    v = sim.normalize_vectors(fx.vectors(spark, sf_dir))
    return _long(v, ["vec_id"])


@register("cosine_topk", S.with_(_EMB, f"""SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(class_idx AS INTEGER) AS class_idx,
    {S.e6('sim')} AS sim_e6 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class_idx) AS rank
    FROM esims) WHERE rank <= 8"""))
def cosine_topk(spark, sf_dir):
    """V3: the 8 nearest label centroids of every embedding."""
    v, cent = _centroids(spark, sf_dir)
    t = sim.cosine_topk(v.select("vec_id", "vector"), cent, k=8)
    return t.select("vec_id", F.col("rank").cast("int"), "class_idx", e6("sim").alias("sim_e6"))


@register("cosine_topk_blocked", ORACLES["cosine_topk"])
def cosine_topk_blocked(spark, sf_dir):
    """V3 with blocks of two centroids and gaps in the indices."""
    v, cent = _centroids(spark, sf_dir)
    gapped = cent.withColumn("class_idx", F.col("class_idx") * 5 + 2)
    dim = v.select(F.max(F.size("vector"))).first()[0] or 1
    t = sim.cosine_topk(v.select("vec_id", "vector"), gapped, k=8, max_broadcast_bytes=16 * dim)
    return t.select("vec_id", F.col("rank").cast("int"), ((F.col("class_idx") - 2) / 5).cast("int").alias("class_idx"),
                    e6("sim").alias("sim_e6"))


@register("pair_cosine", S.with_(_EMB, f"SELECT vec_id, {S.e6('cos')} AS cosine_e6 FROM own"))
def pair_cosine(spark, sf_dir):
    """V8: each embedding against its label's centroid."""
    v, cent = _centroids(spark, sf_dir)
    pairs = v.join(cent.select(F.col("class_idx").alias("label"), F.col("vector").alias("v_vec")), "label")
    out = sim.pair_cosine(pairs.withColumnRenamed("vector", "u_vec"))
    return out.select("vec_id", e6("cosine").alias("cosine_e6"))


_SAMPLES_SQL = S.with_(_EMB + [
    ("p", "SELECT vec_id, label AS cluster, floor(cos * 10) / 10.0 AS p FROM own"),
    ("t", "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, vec_id) AS rn FROM p"),
    ("edges", "SELECT cluster, max(p) AS first, min(p) AS kth FROM t WHERE rn <= 25 GROUP BY cluster"),
    ("ranked", f"""SELECT p.*, row_number() OVER (PARTITION BY cluster ORDER BY p DESC,
                     CASE WHEN first = kth THEN {S.hash32(42, 'vec_id')} ELSE 0 END, vec_id) AS rank
                   FROM p JOIN edges USING (cluster)"""),
], "SELECT cluster, vec_id, CAST(rank AS INTEGER) AS rank, p AS prob FROM ranked WHERE rank <= 25")


@register("cluster_samples", _SAMPLES_SQL)
def cluster_samples(spark, sf_dir):
    """U4 on a grouping SQL can repeat: label as cluster, probability = cosine
    to the label centroid floored to one decimal (so ties occur)."""
    v, cent = _centroids(spark, sf_dir)
    pairs = v.join(cent.select(F.col("class_idx").alias("label"), F.col("vector").alias("c")), "label")
    probs = pairs.select("vec_id", F.col("label").cast("int").alias("cluster"),
                         (F.floor(vx.cosine(F.col("vector"), F.col("c")) * 10) / 10.0).alias("prob"))
    return _cluster_samples(probs, k=25, seed=42, id_col="vec_id").select(
        "cluster", "vec_id", F.col("rank").cast("int"), "prob")
