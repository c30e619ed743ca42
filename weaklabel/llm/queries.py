"""The registered queries of the operators, each over its whole table
with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (anchors, codebooks, decontaminate, html_text, licenses, merkle, packing, pii, pivots, quality, secret_scan,
               simhash, toxicity)
from .common import table

#: Vocabulary of the packing query.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.learnable(table(spark, sf_dir, "labels")), docs)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.learnable(table(spark, sf_dir, "labels")), docs)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
           from documents),
     b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
           from benchmark),
     ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
            from d, unnest(range(1, len(w) - 3)) as t(i) where len(w) > 4),
     bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s
            from b, unnest(range(1, len(w) - 3)) as t(i) where len(w) > 4),
     n as (select item_id, count(*) as n_shingles from bs group by item_id),
     m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id),
     short as (select item_id, len(w) as k, array_to_string(w, ' ') as s from b where len(w) between 1 and 4),
     runs as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as s
              from d, (select distinct k from short) as l, unnest(range(1, len(w) - k + 2)) as t(i))
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles as containment
from m join n using (item_id) where n_shared >= 0.8 * n_shingles
union all
select doc_id, item_id, 1, 1, 1.0 from runs join short using (k, s)
"""

OP10_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
           from documents),
     g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
           from d, unnest(range(1, greatest(len(w) - 11, 1))) as t(i)),
     f as (select s, min(doc_id) as low, max(doc_id) as high from g group by s having min(doc_id) < max(doc_id)),
     c as (select distinct g.doc_id, i + k as place
           from g join f using (s), unnest(range(0, 13)) as u(k) where f.low < g.doc_id),
     r as (select doc_id, list(place) as gone, count(*) as n from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(case when r.n is null then w else
           list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(r.gone, i)), lambda i: w[i]) end, ' '), '')) as kept_sha256
from d left join r using (doc_id)
"""

#: crc32 of the decimal doc_id: each byte enters the register, eight shifts follow.
CRC32 = """xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''),
                  lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
                  lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end,
                  4294967295), 4294967295)"""

OP12_SQL = r"""
with recursive f as (
       select row_number() over (order by doc_id) as nr, doc_id, case when lang is null then '' else '=' || lang end as key,
              coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-')
              || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
              coalesce(octet_length(encode(text)) || ':' || text, '-') as body, n_chars from documents),
     l as (select nr, doc_id, key, SUM as sum, sha256(head || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') || body) as leaf,
              sha256(head || coalesce(octet_length(encode((n_chars + 1)::varchar)) || ':' || (n_chars + 1), '-') || body) as bad from f),
     low as (select l.*, row_number() over (partition by key order by doc_id) - 1 as pos from l),
     t(key, lvl, pos, d) as (
       select key, 0, pos, leaf from low
       union all
       select key, lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos))
       from (select *, count(*) over (partition by key) as n from t) where n > 1 group by key, lvl, pos // 2),
     subs as (select key, arg_max(d, lvl) as subroot, max(lvl) as depth from t group by key),
     u(lvl, pos, d) as (
       select 0, row_number() over (order by key) - 1, subroot from subs
       union all
       select lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos))
       from (select *, count(*) over () as n from u) where n > 1 group by lvl, pos // 2),
     top as (select arg_max(d, lvl) as root, max(lvl) as height from u),
     s as (select subs.*, row_number() over (order by key) - 1 as spos from subs),
     walk(nr, key, lvl, pos, acc) as (
       select nr, key, 0, pos, case when sum % 7 = 0 then bad else leaf end from low
       union all
       select w.nr, w.key, w.lvl + 1, case when w.lvl + 1 = s.depth then s.spos else w.pos // 2 end,
              sha256(case when w.pos % 2 = 1 then coalesce(o.d, x.d) || acc else acc || coalesce(o.d, x.d, '') end)
       from walk w join s using (key) cross join top
       left join t o on w.lvl < s.depth and o.key = w.key and o.lvl = w.lvl and o.pos = xor(w.pos, 1)
       left join u x on w.lvl >= s.depth and x.lvl = w.lvl - s.depth and x.pos = xor(w.pos, 1)
       where w.lvl < s.depth + top.height),
     steps as (
       select w.nr, w.lvl, coalesce(o.d, x.d, '') as d from walk w join s using (key) cross join top
       left join t o on w.lvl < s.depth and o.key = w.key and o.lvl = w.lvl and o.pos = xor(w.pos, 1)
       left join u x on w.lvl >= s.depth and x.lvl = w.lvl - s.depth and x.pos = xor(w.pos, 1)
       where w.lvl < s.depth + top.height),
     proof as (select nr, string_agg(d, '' order by lvl) as p from steps group by nr),
     last as (select nr, arg_max(acc, lvl) as folded from walk group by nr)
select doc_id, leaf, subroot, root, sha256(coalesce(p, '')) as proof_sha256, folded as folded_root, folded = root as verified
from low join s using (key) cross join top join last using (nr) left join proof using (nr)
""".replace("SUM", CRC32)

#: A vector's parts; entries 0 to 63 of each part position; two rounds of assigning and moving.
OP13_SQL = r"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     p as (select vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] as x from kept, unnest(range(16)) as r(part)),
     c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p
            qualify row_number() over (partition by part order by vec_id) <= 64),
""" + "".join(f"""
     d{k} as (select vec_id, part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
              from p join c{k} using (part)),
     a{k} as (select vec_id, part, any_value(x) as x, arg_min(e, d * 64 + e) as e, min(d) as d from d{k} group by vec_id, part),
     s{k} as (select part, e, k, floor(sum(x[k]) / count(*))::bigint as m from a{k}, unnest(range(1, len(x) + 1)) as r(k) group by part, e, k),
     n{k} as (select part, e, list(m order by k) as c from s{k} group by part, e),
     c{k + 1} as (select part, e, coalesce(n{k}.c, c{k}.c) as c from c{k} left join n{k} using (part, e)),
""" for k in range(2)) + r"""
     d2 as (select vec_id, part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from p join c2 using (part)),
     a2 as (select vec_id, part, arg_min(e, d * 64 + e) as e, min(d) as d from d2 group by vec_id, part),
     books as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as codebooks_sha256 from c2),
     o as (select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a2 group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from o join kept using (vec_id) cross join books
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_merkle": op12_merkle,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op9_decontaminate": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op12_merkle": OP12_SQL,
                           "op13_vector_codes": OP13_SQL}


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``fn`` after the package was made importable in Python workers."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: shipped(f) for k, f in QUERIES.items()}
