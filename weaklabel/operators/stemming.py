"""T4: stemming. The default stemmer is the Snowball English ("Porter2")
algorithm as published by its author, written as column expressions: each step
is a chain of suffix tests on the word of the step before, with the regions R1
and R2 as numbers beside it. Any ``str -> str`` function can be passed instead;
it runs in Arrow-batched pandas UDFs with a per-batch memo."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
FIRST_PAIR = f"(?s)^.*?{VOWEL}{OTHER}"                     # up to the first consonant after a vowel
SHORT_END = f"^{VOWEL}{OTHER}\\z|{OTHER}{VOWEL}[^aeiouywxY]\\z"

# The algorithm's exception lists and suffix tables.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
         "ive", "ize", "ion", "al", "er", "ic"]


def _let(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def _cut(w: Column, n: int, to: str = "") -> Column:
    short = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(short, F.lit(to)) if to else short


def _first(w: Column, rules: list[tuple[str, Column]]) -> Column:
    """The result of the first rule whose suffix the word has, else the word."""
    out = None
    for suffix, result in rules:
        out = F.when(w.endswith(suffix), result) if out is None else out.when(w.endswith(suffix), result)
    return out.otherwise(w)


def _kept(w: Column, suffix: str, region: Column, result: Column, also: Column | None = None) -> tuple[str, Column]:
    """A rule that applies if the suffix lies in the region."""
    there = F.length(w) - len(suffix) >= region
    return suffix, F.when(there if also is None else there & also, result).otherwise(w)


def _regions(w: Column) -> Column:
    """struct(w, r1, r2): where the regions begin."""
    def pair(text: Column) -> Column:
        n = F.length(F.regexp_extract(text, FIRST_PAIR, 0))
        return F.when(n > 0, n).otherwise(F.length(text))
    special = F.length(F.regexp_extract(w, "^(gener|commun|arsen)", 0))
    return _let(F.struct(w.alias("w"), F.when(special > 0, special).otherwise(pair(w)).alias("r1")), lambda x: F.struct(
        x["w"], x["r1"], (x["r1"] + pair(F.substring(x["w"], x["r1"] + 1, F.length(x["w"])))).alias("r2")))


def _step_0(w: Column) -> Column:
    return _first(w, [("'s'", _cut(w, 3)), ("'s", _cut(w, 2)), ("'", _cut(w, 1))])


def _step_1a(w: Column) -> Column:
    short = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    plural = F.when(w.rlike(f"(?s){VOWEL}.+s\\z"), _cut(w, 1)).otherwise(w)
    return _first(w, [("sses", _cut(w, 2)), ("ied", short), ("ies", short), ("us", w), ("ss", w), ("s", plural)])


def _step_1b(w: Column, r1: Column) -> Column:
    def rest(n: int) -> Column:
        def mended(stem: Column) -> Column:
            return (F.when(stem.rlike("(at|bl|iz)\\z"), F.concat(stem, F.lit("e")))
                    .when(stem.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)\\z"), _cut(stem, 1))
                    .when((r1 >= F.length(stem)) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e"))).otherwise(stem))
        return F.when(_cut(w, n).rlike(VOWEL), _let(_cut(w, n), mended)).otherwise(w)
    return _first(w, [_kept(w, "eedly", r1, _cut(w, 5, "ee")), ("ingly", rest(5)), ("edly", rest(4)),
                      _kept(w, "eed", r1, _cut(w, 3, "ee")), ("ing", rest(3)), ("ed", rest(2))])


def _step_2(w: Column, r1: Column) -> Column:
    also = {"ogi": w.endswith("logi"), "li": w.rlike("[cdeghkmnrt]li\\z")}
    return _first(w, [_kept(w, a, r1, _cut(w, len(a), b), also.get(a)) for a, b in STEP2])


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    return _first(w, [_kept(w, a, r2 if a == "ative" else r1, _cut(w, len(a), b)) for a, b in STEP3])


def _step_4(w: Column, r2: Column) -> Column:
    also = {"ion": w.rlike("[st]ion\\z")}
    return _first(w, [_kept(w, a, r2, _cut(w, len(a)), also.get(a)) for a in STEP4])


def _step_5(w: Column, r1: Column, r2: Column) -> Column:
    n = F.length(w) - 1
    e = F.when((n >= r2) | ((n >= r1) & ~_cut(w, 1).rlike(SHORT_END)), _cut(w, 1)).otherwise(w)
    return _first(w, [("e", e), ("ll", F.when(n >= r2, _cut(w, 1)).otherwise(w))])


def snowball_english(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two characters stay."""
    start = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), f"(?<={VOWEL})y", "Y")

    def on(step: Callable, x: Column) -> Column:
        return F.struct(step(x).alias("w"), x["r1"].alias("r1"), x["r2"].alias("r2"))
    out = _let(start, _regions)
    out = _let(out, lambda x: on(lambda y: _step_0(y["w"]), x))
    out = _let(out, lambda x: on(lambda y: _step_1a(y["w"]), x))

    def later(x: Column) -> Column:
        z = _let(x, lambda y: on(lambda v: _step_1b(v["w"], v["r1"]), y))
        z = _let(z, lambda y: on(lambda v: F.regexp_replace(v["w"], f"(?s)^(.+{OTHER})[yY]\\z", "$1i"), y))
        z = _let(z, lambda y: on(lambda v: _step_2(v["w"], v["r1"]), y))
        z = _let(z, lambda y: on(lambda v: _step_3(v["w"], v["r1"], v["r2"]), y))
        z = _let(z, lambda y: on(lambda v: _step_4(v["w"], v["r2"]), y))
        return _let(z, lambda y: _step_5(y["w"], y["r1"], y["r2"]))
    stem = F.regexp_replace(_let(out, lambda x: F.when(x["w"].isin(AFTER_1A), x["w"]).otherwise(later(x))), "Y", "y")
    odd = None
    for a, b in EXCEPTIONS.items():
        odd = F.when(word == a, F.lit(b)) if odd is None else odd.when(word == a, F.lit(b))
    return F.when(F.length(word) <= 2, word).otherwise(odd.otherwise(stem))


def _memo(fn):
    cache: dict = {}

    def one(w):
        if w not in cache:
            cache[w] = fn(w)
        return cache[w]
    return one, cache


def stem_column(col: Column, stemmer=None) -> Column:
    """Stem a STRING column."""
    if stemmer is None:
        return snowball_english(col)

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        one, _ = _memo(stemmer)
        return s.map(lambda w: None if w is None else one(w))
    return stem(col)


def stem_tokens(col: Column, stemmer=None) -> Column:
    """Stem every token of an ``ARRAY<STRING>`` column, order kept."""
    if stemmer is None:
        return F.transform(col, snowball_english)

    @F.pandas_udf("array<string>")
    def stem(s: pd.Series) -> pd.Series:
        one, _ = _memo(stemmer)
        return s.map(lambda ts: None if ts is None else [one(t) for t in ts])
    return stem(col)
