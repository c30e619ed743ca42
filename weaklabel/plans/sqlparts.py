"""DuckDB SQL building blocks for the oracle checks. They restate the
semantics of the Spark operators in plain SQL over the driver's tables, so
each registered query can be compared with an independent engine."""

from __future__ import annotations

from ..functions import text as tx
from ..functions.stopwords import DEFAULT_STOPWORDS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


STOP = sql_list(sorted(set(DEFAULT_STOPWORDS)))


def hash32(seed, key_sql: str) -> str:
    return f"('0x' || substr(md5('{seed}-' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"


def uniform(seed, key_sql: str) -> str:
    return f"({hash32(seed, key_sql)} / 4294967296.0::DOUBLE)"


def hash_vector(term_sql: str, dim: int) -> str:
    return (f"list_transform(range(0, {dim}), lambda i: ('0x' || substr(md5({term_sql} || '-' || "
            f"CAST(i AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5)")


def clean(col: str) -> str:
    return f"regexp_replace({col}, {q(tx.CLEAN_PATTERN)}, '', 'g')"


def tokenize(col: str, split_contractions: bool = True) -> str:
    toks = f"coalesce(regexp_extract_all(lower({col}), {q(tx.TOKEN_PATTERN)}), [])"
    if not split_contractions:
        return toks
    cases = " ".join(f"WHEN t = {q(w)} THEN {sql_list(p)}" for w, p in tx.TREEBANK_SPLITS.items())
    return f"flatten(list_transform({toks}, lambda t: CASE {cases} ELSE [t] END))"


def tokenize_keep_punct(col: str) -> str:
    return f"coalesce(regexp_extract_all(lower({col}), {q(tx.TOKEN_PUNCT_PATTERN)}), [])"


WORD = tx.WORD_CHARS


def tokenize_treebank(col: str) -> str:
    """T2b in patterns without look-around (RE2): marks that a look-around
    would only see are consumed, so these rules run twice; a sentinel undoes
    the split before clitics. Blanks between tokens may be many."""
    w, end = f"[{WORD}]", f"([^{WORD}]|$)"
    t = f"trim(regexp_replace(lower({col}), {q(tx.BLANKS_PATTERN)}, ' ', 'g'))"

    def sub(text, pattern, to, times=1):
        for _ in range(times):
            text = f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"
        return text
    t = sub(t, "[«“‘„]|`+", r" \0 ")
    t = sub(t, '^"', "``")
    t = sub(t, "``", r" \0 ")
    t = sub(t, r"""([ (\[{<])("|'')""", r"\1 `` ")
    t = sub(t, f"'({w}){end}", "'\x01\\1\\2", 2)
    t = sub(t, "'\x01([mtsdn])", r"'\1")
    t = sub(t, "\x01", " ")
    t = sub(t, r"""([^.])(\.)([\])}>"'»”’]*)( |$)""", r"\1 \2 \3 \4", 2)
    t = sub(t, r"([:,])([^\p{Nd}])", r" \1 \2")
    t = sub(t, "[:,]$", r" \0 ")
    t = sub(t, r"\.\.+", r" \0 ")
    t = sub(t, "[;@#$%&]", r" \0 ")
    t = sub(t, "[?!]", r" \0 ")
    t = sub(t, "([^'])' ", r"\1 ' ")
    t = sub(t, r"[*]", r" \0 ")
    t = sub(t, r"[\]\[(){}<>]", r" \0 ")
    t = sub(t, "--", r" \0 ")
    t = f"(' ' || {t} || ' ')"
    t = sub(t, "[»”’]", r" \0 ")
    t = sub(t, "''", r" \0 ")
    t = sub(t, '"', " '' ")
    t = sub(t, "([^' ])('[smd]|') ", r"\1 \2 ")
    t = sub(t, "([^' ])('ll|'re|'ve|n't) ", r"\1 \2 ")
    for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na")):
        t = sub(t, f"([^{WORD}])({a})({b}){end}", r"\1 \2 \3 \4", 2)
    t = sub(t, f" ('t)(is|was){end}", r" \1 \2 \3", 2)
    return f"coalesce(list_filter(string_split({t}, ' '), lambda w: w <> ''), [])"


def drop_stop(list_sql: str, stop: str = STOP) -> str:
    return f"list_filter({list_sql}, lambda w: NOT list_contains({stop}, w))"


def analyzer_terms(tokens_sql: str) -> str:
    joined = f"array_to_string({tokens_sql}, ' ')"
    return drop_stop(f"coalesce(regexp_extract_all({joined}, {q(tx.ANALYZER_PATTERN)}), [])")


def strip_punct(col: str) -> str:
    return f"regexp_replace({col}, {q(tx.ASCII_PUNCT_PATTERN)}, '', 'g')"


def e6(x: str) -> str:
    """Scaled score, so engines' last-digit differences do not matter."""
    return f"CAST(round(({x}) * 1e6) AS BIGINT)"


def e6_nan(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {e6(x)} END"


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


# ----------------------------------------------------------- corpus chain

LANG = dict(bottom_p=0.5, full_k=1, keep_p=0.6, seed=42, remove_stopwords=False)


def corpus_ctes(source: str = "lang", remove_punctuation: bool = True,
                remove_stopwords: bool = False) -> list[tuple[str, str]]:
    label = "lang" if source == "lang" else "source"
    tok = tokenize(clean("sentence")) if remove_punctuation else tokenize_treebank("sentence")
    if remove_stopwords:
        tok = drop_stop(tok)
    return [
        ("corpus", f"SELECT doc_id, text AS sentence, {label} AS label FROM documents"),
        ("prepared", f"SELECT doc_id, label, {tok} AS tokens FROM corpus"),
    ]


def split_ctes(bottom_p=0.5, full_k=1, keep_p=0.6, seed=42) -> list[tuple[str, str]]:
    return [
        ("counts", "SELECT label, count(*) AS n FROM prepared GROUP BY label"),
        ("rare", f"""SELECT label, n, rank FROM (
             SELECT label, n, row_number() OVER (ORDER BY n, label) AS rank,
                    count(*) OVER () AS n_labels FROM counts)
           WHERE rank <= floor(n_labels * CAST({bottom_p} AS DOUBLE))"""),
        ("cdf0", f"""SELECT label, n, rank,
             (sum(1.0::DOUBLE / n) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) - 1.0::DOUBLE / n)
               / (SELECT sum(1.0::DOUBLE / n) FROM rare) AS lo FROM rare"""),
        ("cdf", "SELECT label, lo, coalesce(lead(lo) OVER (ORDER BY n, label), 1.0::DOUBLE) AS hi FROM cdf0"),
        ("draws", f"SELECT {uniform(seed, chr(39) + 'draw-' + chr(39) + ' || CAST(range AS VARCHAR)')} AS u "
                  f"FROM range({full_k})"),
        ("removed", "SELECT DISTINCT c.label FROM draws d JOIN cdf c ON d.u >= c.lo AND d.u < c.hi"),
        ("kept", "SELECT doc_id, label FROM prepared WHERE label NOT IN (SELECT label FROM removed)"),
        ("sampled", f"""SELECT doc_id FROM (
             SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY {hash32(seed, 'doc_id')}, doc_id) AS rn,
                    count(*) OVER (PARTITION BY label) AS tot FROM kept)
           WHERE rn <= round_even(CAST({keep_p} AS DOUBLE) * tot, 0)"""),
        ("split", """SELECT p.doc_id, p.label, p.tokens,
             CASE WHEN s.doc_id IS NOT NULL THEN 'labeled' ELSE 'unlabeled' END AS split
           FROM prepared p LEFT JOIN sampled s USING (doc_id)"""),
        ("label_sets", """SELECT label, bool_or(split = 'labeled') AS in_labeled,
             bool_or(split = 'unlabeled') AS in_unlabeled FROM split GROUP BY label"""),
        ("existing", """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx
           FROM label_sets WHERE in_labeled"""),
    ]


def class_tfidf_ctes(src: str = "split", where: str = "split = 'labeled'") -> list[tuple[str, str]]:
    return [
        ("lab_terms", f"SELECT doc_id, label, {analyzer_terms('tokens')} AS terms FROM {src} WHERE {where}"),
        ("tf", "SELECT label, term, count(*) AS tf FROM (SELECT label, unnest(terms) AS term FROM lab_terms) GROUP BY label, term"),
        ("tfw", """SELECT label, term, tf, count(*) OVER (PARTITION BY term) AS df,
             tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT label) FROM lab_terms)) / (count(*) OVER (PARTITION BY term) + 1.0::DOUBLE)) + 1.0) AS w
           FROM tf"""),
        ("tfidf", """SELECT label, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS score FROM tfw"""),
    ]


def top_ctes(scores: str, k: int, strict: bool, name: str = "top") -> list[tuple[str, str]]:
    take = k if strict else max(10, 3 * k)
    return [(name, f"""SELECT label, term, rank, score FROM (
        SELECT label, term, score, row_number() OVER (PARTITION BY label
               ORDER BY round(score, 9) DESC NULLS LAST, term) AS rank FROM {scores})
        WHERE rank <= {take}""")]


def seed_ctes(top: str, k: int, name: str = "seeds") -> list[tuple[str, str]]:
    return [(name, f"""SELECT label, term, rank, score FROM (
        SELECT label, term, score, row_number() OVER (PARTITION BY label ORDER BY rank) AS rank FROM (
          SELECT *, count(*) OVER (PARTITION BY term) AS lists FROM {top})
        WHERE lists = 1 AND NOT list_contains({STOP}, term))
      WHERE rank <= {k}""")]


def li_ctes(src: str, nan_first: bool = False, prefix: str = "li") -> list[tuple[str, str]]:
    """``src(doc_id, label, tokens)`` -> ``{prefix}(label, term, li, ctf, idf, score)``."""
    p = prefix
    keep = "" if nan_first else "WHERE idf > 0"
    return [
        (f"{p}_terms", f"SELECT doc_id, label, {analyzer_terms('tokens')} AS terms FROM {src}"),
        (f"{p}_dt", f"SELECT doc_id, label, term, count(*) AS n FROM (SELECT doc_id, label, unnest(terms) AS term FROM {p}_terms) GROUP BY ALL"),
        (f"{p}_pair", f"SELECT label, term, count(*) AS n_docs_with, sum(n) AS occ FROM {p}_dt GROUP BY label, term"),
        (f"{p}_sizes", f"SELECT label, count(*) AS class_size FROM {p}_terms GROUP BY label"),
        (p, f"""SELECT * FROM (SELECT label, term, li, ctf, idf, pow(li * ctf * idf, 1.0::DOUBLE / 3.0) AS score FROM (
             SELECT a.label, a.term, a.n_docs_with / s.class_size AS li, tanh(a.occ / s.class_size) AS ctf,
                    ln((SELECT count(*) FROM {p}_terms) / sum(a.occ) OVER (PARTITION BY a.term)) AS idf
             FROM {p}_pair a JOIN {p}_sizes s USING (label))) {keep}"""),
    ]


# ----------------------------------------------------------- vector chain

def stem(word_sql: str) -> str:
    """The checks' stemmer: a final s goes."""
    return f"regexp_replace({word_sql}, 's$', '')"


def lookup_ctes(src: str, name: str) -> list[tuple[str, str]]:
    """E2/E3 for ``src(term)`` -> ``name(term, dim, x)``: the word itself,
    else its stem, else (with '_') the mean of the pieces found that way."""
    return [
        (f"{name}_terms", f"SELECT DISTINCT term FROM {src}"),
        (f"{name}_whole", f"""SELECT t.term, w.dim, w.x FROM {name}_terms t JOIN wv_long w USING (term)
            UNION ALL SELECT t.term, w.dim, w.x FROM {name}_terms t JOIN wv_long w ON w.term = {stem('t.term')}
            WHERE t.term NOT IN (SELECT term FROM wv)"""),
        (f"{name}_split", f"""SELECT term, unnest(string_split(trim(term), '_')) AS piece FROM {name}_terms
            WHERE contains(term, '_') AND term NOT IN (SELECT term FROM {name}_whole)"""),
        (f"{name}_pieces", f"""SELECT p.term, w.dim, w.x FROM {name}_split p JOIN wv_long w ON w.term = p.piece
            UNION ALL SELECT p.term, w.dim, w.x FROM {name}_split p JOIN wv_long w ON w.term = {stem('p.piece')}
            WHERE p.piece NOT IN (SELECT term FROM wv)"""),
        (name, f"""SELECT term, dim, x FROM {name}_whole
            UNION ALL SELECT term, dim, avg(x) FROM {name}_pieces GROUP BY term, dim"""),
    ]


def vector_ctes(dim: int, min_count: int, seed_k: int, threshold: float,
                strict: bool = False) -> list[tuple[str, str]]:
    """Hash word vectors over the >= min_count vocabulary, document and
    class vectors (through the whole word lookup), nearest class and
    confidence for the unlabelled part. Expects ``split`` and ``existing``
    (from split_ctes)."""
    return class_tfidf_ctes() + top_ctes("tfidf", seed_k, strict) + seed_ctes("top", seed_k) + [
        ("vocab", f"""SELECT term, count(*) AS n_occ FROM (
              SELECT {strip_punct('t')} AS term FROM (SELECT unnest(tokens) AS t FROM split))
            WHERE term <> '' GROUP BY term HAVING count(*) >= {min_count}"""),
        ("wv", f"SELECT term, {hash_vector('term', dim)} AS vector, n_occ FROM vocab"),
        ("wv_long", "SELECT term, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM wv"),
        ("unl", "SELECT doc_id, label, tokens FROM split WHERE split = 'unlabeled'"),
        ("dt", "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM unl) GROUP BY ALL"),
        ("sought", "SELECT term FROM dt UNION ALL SELECT term FROM seeds"),
        *lookup_ctes("sought", "lk"),
        ("dv_long", """SELECT d.doc_id, w.dim, sum(d.n * w.x) / sum(d.n) AS x
            FROM dt d JOIN lk w USING (term) GROUP BY d.doc_id, w.dim"""),
        ("cv_long", """SELECT s.label, e.class_idx, w.dim, avg(w.x) AS x, count(*) AS n_seeds_found
            FROM seeds s JOIN lk w USING (term) JOIN existing e USING (label) GROUP BY s.label, e.class_idx, w.dim"""),
        ("dn", "SELECT doc_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM dv_long GROUP BY doc_id"),
        ("cn", "SELECT class_idx, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM cv_long GROUP BY class_idx"),
        ("sims", """SELECT d.doc_id, c.class_idx, c.label, sum((d.x / dn.nrm) * (c.x / cn.nrm)) AS sim
            FROM dv_long d JOIN dn USING (doc_id) JOIN cv_long c USING (dim) JOIN cn ON c.class_idx = cn.class_idx
            GROUP BY d.doc_id, c.class_idx, c.label"""),
        ("best", """SELECT doc_id, class_idx, label AS best_label, sim AS max_sim FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, class_idx) AS rn FROM sims)
            WHERE rn = 1"""),
        ("scored", f"""SELECT u.doc_id, u.label, u.tokens, b.max_sim, b.class_idx, b.best_label,
              coalesce(b.max_sim >= {threshold}, false) AS is_confident
            FROM unl u LEFT JOIN best b USING (doc_id)"""),
    ]


def naming_ctes(cluster: str = "class_idx") -> list[tuple[str, str]]:
    """Unconfident documents grouped by nearest class (or another
    ``cluster``), named by LI-cTF-IDF, and the assembled predictions.
    Expects ``scored``."""
    return [
        ("unconf", f"SELECT doc_id, label AS truth, tokens, {cluster} AS cluster FROM scored WHERE NOT is_confident"),
        ("unconf_l", "SELECT doc_id, CAST(cluster AS VARCHAR) AS label, tokens FROM unconf WHERE cluster IS NOT NULL"),
    ] + li_ctes("unconf_l", prefix="nli") + top_ctes("nli", 8, False, "ntop") + seed_ctes("ntop", 8, "nseeds") + [
        ("names", """SELECT CAST(l.label AS INTEGER) AS cluster, coalesce(s.term, 'cluster_' || l.label) AS name
            FROM (SELECT DISTINCT label FROM unconf_l) l
            LEFT JOIN (SELECT label, term FROM nseeds WHERE rank = 1) s USING (label)"""),
        ("new_classes", """SELECT u.doc_id, u.truth, u.tokens, u.cluster, n.name AS prediction
            FROM unconf u LEFT JOIN names n USING (cluster)"""),
        ("preds", """SELECT doc_id, label AS truth, best_label AS prediction, true AS is_confident FROM scored WHERE is_confident
            UNION ALL SELECT doc_id, truth, prediction, false FROM new_classes"""),
    ]
