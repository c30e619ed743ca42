"""Secret scan: base patterns, and character Markov models for the rest.

Everything is DataFrame and SQL functions. Two Markov models of character
pairs are trained from labelled samples, one on random strings (secrets), one
on ordinary identifiers and words. A long token whose log-likelihood ratio per
character favours the random model is a secret too, unless a base match
already covers it. Each model is a table of 128 x 128 numbers.

All work on a text is linear in its length, and k log k in its matches: running
sums and maxima of arrays are made by doubling steps (``scan_array``), overlaps
are read off one sorted sweep, and texts are masked piece by piece.

Defined cases: a null text counts as empty; characters outside ASCII are in no
token; repeated rows get a row each; an empty table gives no rows; extra
columns are not read, and ``redact`` returns them as they are. Without samples
of both kinds the models are uniform and add nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# The base patterns, in the order in which equal starts are listed.
ASSIGN = r"(?:(?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = ("assign", "access", "hex")
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = 12
#: Tokens the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
EXTRA = "random"
#: Mean log-likelihood ratio of a character pair from which a token is random.
MARGIN = 0.7
#: Smoothing: the weight of the second character's own frequency against the pair's counts.
PRIOR = 4.0
ALPHABET = 64
#: Past the end of any text.
BEYOND = 2**31 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_array(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative ``op`` over an
    array of numbers, the first value itself first. Step b joins each place
    with the one 2 ** b before it, so n values take log2(n) steps."""
    def step(acc: Column, b: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), b)
        return F.transform(acc, lambda x, i: F.when(i >= back, op(x, F.get(acc, i - back))).otherwise(x))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("bigint"))))
    return F.aggregate(steps, values, step)


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, rank, kind, end, value>> of the leftmost
    non-overlapping matches, in characters. The text is cut at the matches:
    a match ends where the pieces and matches up to it end."""
    rank = [*KINDS, EXTRA].index(kind)
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                   F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def place(c: Column) -> Column:
        steps = F.transform(c["found"], lambda v, i: F.get(c["gaps"], i) + F.length(v))
        ends = scan_array(steps, lambda a, b: a + b)

        def one(e: Column, v: Column) -> Column:
            return F.struct((e - F.length(v)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                            e.alias("end"), v.alias("value"))
        return F.zip_with(ends, c["found"], one)
    return let(cut, place)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
NONE = f"cast(array() as {SPANS})"


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches by kind. Cheap tests keep the costlier matching to the
    texts that can hold a match."""
    lower = F.lower(text)
    may = {"assign": None, "access": text.contains("AKIA"), "hex": text.rlike(PATTERNS["hex"])}
    for k in KEYWORDS:
        may["assign"] = lower.contains(k) if may["assign"] is None else may["assign"] | lower.contains(k)
    out = {k: F.when(may[k], spans_of(text, PATTERNS[k], k)).otherwise(F.expr(NONE)) for k in KINDS}
    out["assign"] = F.filter(out["assign"], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_VALUE)
    return out


def with_base(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``docs`` with a column of spans for each base kind, and of tokens."""
    spans = base_spans(text)
    tokens = F.when(text.rlike(TOKEN), spans_of(text, TOKEN, EXTRA)).otherwise(F.expr(NONE))
    return docs.select("*", *(spans[k].alias(f"{prefix}{k}") for k in KINDS), tokens.alias(f"{prefix}{EXTRA}"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """``(value, secret)`` training strings from all of ``docs``: what base
    matches hold, and the words of six characters and more outside them."""
    cols = with_base(docs.select(F.coalesce("text", F.lit("")).alias("text")), F.col("text"))
    value = F.regexp_extract("s.value", ASSIGN, 1)
    secret = (cols.select(F.explode(F.concat(*KINDS)).alias("s"))
              .select(F.when(F.col("s.kind") == "assign", value).otherwise(F.col("s.value")).alias("value"), F.lit(True).alias("secret")))
    rest = cols.select("text")
    for k in KINDS:
        rest = rest.select(F.regexp_replace("text", PATTERNS[k], " ").alias("text"))
    words = rest.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("value"))
    return secret.union(words.select("value", F.lit(False)))


def pairs_of(value: Column) -> Column:
    """The value's character pairs, each starting one character later."""
    return F.regexp_extract_all(value, F.lit(r"(?s)(?=(..))"), F.lit(1))


def pair_index(pair: Column) -> Column:
    """Number of an ASCII character pair."""
    return F.ascii(pair) * 128 + F.ascii(F.substring(pair, 2, 1))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each character pair
    given its first character, as 128 x 128 numbers. The counts are summed on
    Spark; at most 2 x 16,384 of them are collected."""
    pairs = (samples.select("secret", F.explode(pairs_of(F.col("value"))).alias("pair"))
             .groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n"))
             .select("secret", "n", pair_index(F.col("pair")).alias("pair"))
             .where("pair >= 0 and pair < 16384").collect())
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs:
        counts[r["secret"]][r["pair"]] = r["n"]
    if not counts[True] or not counts[False]:
        return [0.0] * 16384
    first: dict[bool, dict[int, int]] = {True: {}, False: {}}
    second: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for y, got in counts.items():
        for pair, n in got.items():
            first[y][pair // 128] = first[y].get(pair // 128, 0) + n
            second[y][pair % 128] = second[y].get(pair % 128, 0) + n
    every = {y: sum(counts[y].values()) for y in counts}

    def log_p(y: bool, pair: int) -> float:
        alone = (second[y].get(pair % 128, 0) + 0.5) / (every[y] + 0.5 * ALPHABET)
        return math.log((counts[y].get(pair, 0) + PRIOR * alone) / (first[y].get(pair // 128, 0) + PRIOR))
    return [log_p(True, p) - log_p(False, p) for p in range(16384)]


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the value's character pairs."""
    numbers = F.array(*(F.lit(x) for x in table)) if len(table) < 64 else F.from_json(
        F.lit("[" + ",".join(f"{x:.6f}" for x in table) + "]"), "array<double>")
    total = F.aggregate(pairs_of(value), F.lit(0.0), lambda acc, p: acc + F.element_at(numbers, pair_index(p) + 1))
    return total / (F.length(value) - 1)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps. Both lie in one sorted list: a
    token is free if all base spans before it end by its start and the next
    one starts at its end or later."""
    def events(spans: Column, token: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(token).alias("token"),
                                                     s["end"].alias("end"), s.alias("span")))

    def sweep(e: Column) -> Column:
        ends = F.transform(e, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(-1))
        starts = F.transform(F.reverse(e), lambda x: F.when(x["token"] == 0, x["start"]).otherwise(BEYOND))
        around = F.struct(e.alias("events"), scan_array(ends, F.greatest).alias("before"), scan_array(starts, F.least).alias("after"))
        return let(around, free)

    def free(a: Column) -> Column:
        e, last = a["events"], F.size(a["events"]) - 1
        kept = F.filter(e, lambda x, i: (x["token"] == 1) & (F.get(a["before"], i) <= x["start"])
                        & (F.get(a["after"], last - i) >= x["end"]))
        return F.transform(kept, lambda x: x["span"])
    return let(F.array_sort(F.concat(events(base, 0), events(tokens, 1))), sweep)


def with_spans(docs: DataFrame, table: list[float]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of the base spans and of all spans, and the names
    of these columns (they clash with none of ``docs``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prefix = free_name(docs, "found_")
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    df = with_base(docs, text, prefix)
    base, found, every = f"{prefix}base", f"{prefix}{EXTRA}", f"{prefix}all"
    df = df.withColumn(base, F.array_sort(F.concat(*(F.col(f"{prefix}{k}") for k in KINDS))))
    free = F.when(F.size(base) > 0, apart(F.col(found), F.col(base))).otherwise(F.col(found))
    df = df.withColumn(found, F.when(F.size(found) > 0, free).otherwise(F.expr(NONE)))
    df = df.withColumn(found, F.when(F.size(found) > 0, F.filter(found, lambda t: ratio(t["value"], table) >= MARGIN))
                       .otherwise(F.expr(NONE)))
    df = df.withColumn(every, F.array_sort(F.concat(base, found)))
    return df, {"base": base, "all": every, **{k: f"{prefix}{k}" for k in KINDS}}


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every
    row; no shuffle."""
    df, name = with_spans(docs.select(F.col("doc_id").cast("bigint"), "text"), table)
    return df.select("doc_id", *(F.size(name[k]).cast("bigint").alias(f"n_{k}") for k in KINDS),
                     F.sha2(listed(name["base"]).cast("binary"), 256).alias("base_sha256"), listed(name["all"]).alias("spans"))


MASK = "[SECRET]"
#: Characters of the blocks in which a text is cut for masking.
CHUNK = 1_024


def gaps_of(spans: Column, length: Column) -> Column:
    """array<struct<a, b>>: what lies before, between and after the sorted
    spans, touching and overlapping ones taken as one."""
    def cut(s: Column) -> Column:
        reach = scan_array(F.transform(s, lambda x: x["end"]), F.greatest)
        return let(F.struct(s.alias("spans"), reach.alias("reach")), between)

    def between(z: Column) -> Column:
        before = F.transform(z["spans"], lambda s, i: F.struct(
            F.when(i > 0, F.get(z["reach"], i - 1)).otherwise(-1).alias("a"), s["start"].alias("b")))
        last = F.struct(F.element_at(z["reach"], -1).alias("a"), length.alias("b"))
        return F.concat(F.filter(before, lambda g: g["b"] > g["a"]), F.array(last))
    gaps = let(spans, cut)
    return F.transform(gaps, lambda g: F.struct(F.greatest(g["a"], F.lit(0)).alias("a"), g["b"].alias("b")))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with its spans replaced. A gap is put together from the blocks
    it lies in, so no place is searched from the start of the text."""
    def join(z: Column) -> Column:
        def piece(g: Column, k: Column) -> Column:
            start = F.greatest(g["a"] - k * CHUNK, F.lit(0))
            return F.substring(F.get(z["blocks"], k), start + 1, F.least(g["b"] - k * CHUNK, F.lit(CHUNK)) - start)

        def gap(g: Column) -> Column:
            blocks = F.sequence((g["a"] / CHUNK).cast("int"), ((g["b"] - 1) / CHUNK).cast("int"))
            return F.when(g["b"] > g["a"], F.array_join(F.transform(blocks, lambda k: piece(g, k)), "")).otherwise(F.lit(""))
        return F.array_join(F.transform(z["gaps"], gap), MASK)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), gaps_of(spans, F.length(text)).alias("gaps")), join)


def redact(docs: DataFrame, table: list[float]) -> DataFrame:
    """``docs`` with every span of its text replaced by ``MASK`` (touching or
    overlapping spans by one), and n_chars, if there, made to fit."""
    df, name = with_spans(docs, table)
    t = F.col("text")
    clean = masked(t, F.col(name["all"]))
    text = F.when(F.size(name["all"]) > 0, clean).otherwise(t)
    out = df.withColumn("text", text).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
