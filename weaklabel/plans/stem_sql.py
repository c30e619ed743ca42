"""The Snowball English stemmer as DuckDB CTEs, restated from the published
steps with a table for each; y after a vowel is marked without look-behind, in
two passes. Only the suffix tables are shared with the column expressions."""

from __future__ import annotations

from ..operators import stemming as st
from .sqlparts import q

V, O = "[aeiouy]", "[^aeiouy]"
ALSO = {"ogi": "ends_with(w, 'logi')", "li": "regexp_matches(w, '[cdeghkmnrt]li$')", "ion": "regexp_matches(w, '[st]ion$')"}


def short_end(w: str) -> str:
    return f"regexp_matches({w}, {q(f'^{V}{O}$|{O}{V}[^aeiouywxY]$')})"


def cut(n: int, to: str = "") -> str:
    return f"left(w, length(w) - {n})" + (f" || {q(to)}" if to else "")


def chain(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(w, {q(a)}) THEN {b}" for a, b in rules) + " ELSE w END"


def kept(a: str, to: str, region: str) -> tuple[str, str]:
    return a, f"CASE WHEN length(w) - {len(a)} >= {region} AND {ALSO.get(a, 'true')} THEN {cut(len(a), to)} ELSE w END"


def rest(n: int) -> str:
    """The word without its last ``n`` letters, mended, if a vowel remains."""
    stem = f"left(w, length(w) - {n})"
    return (f"CASE WHEN NOT regexp_matches({stem}, {q(V)}) THEN w WHEN regexp_matches({stem}, '(at|bl|iz)$') THEN {stem} || 'e' "
            f"WHEN regexp_matches({stem}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - {n + 1}) "
            f"WHEN r1 >= length({stem}) AND {short_end(stem)} THEN {stem} || 'e' ELSE {stem} END")


def pair(w: str) -> str:
    found = f"regexp_extract({w}, {q(f'^.*?{V}{O}')})"
    return f"CASE WHEN {found} <> '' THEN length({found}) ELSE length({w}) END"


def stem_ctes() -> list[tuple[str, str]]:
    """``voc(term)`` to ``p8(term, w)``."""
    y = f"regexp_replace(regexp_replace(term, {q(chr(94) + chr(39))}, ''), '^y', chr(1))"
    for vowels in (V, "[aeiouyY]"):
        y = f"regexp_replace({y}, {q(f'({vowels})y')}, {q(r'\1Y')}, 'g')"
    special = "regexp_extract(w, '^(gener|commun|arsen)')"
    ied = f"CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END"
    plural = f"CASE WHEN regexp_matches(w, {q(f'{V}.+s$')}) THEN {cut(1)} ELSE w END"
    last = f"length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short_end('left(w, length(w) - 1)')})"
    steps = [
        chain([("'s'", cut(3)), ("'s", cut(2)), ("'", cut(1))]),
        chain([("sses", cut(2)), ("ied", ied), ("ies", ied), ("us", "w"), ("ss", "w"), ("s", plural)]),
        chain([kept("eedly", "ee", "r1"), ("ingly", rest(5)), ("edly", rest(4)), kept("eed", "ee", "r1"), ("ing", rest(3)), ("ed", rest(2))]),
        f"regexp_replace(w, {q(f'^(.+{O})[yY]$')}, {q(r'\1i')})",
        chain([kept(a, b, "r1") for a, b in st.STEP2]),
        chain([kept(a, b, "r2" if a == "ative" else "r1") for a, b in st.STEP3]),
        chain([kept(a, "", "r2") for a in st.STEP4]),
        chain([("e", f"CASE WHEN {last} THEN {cut(1)} ELSE w END"), ("ll", f"CASE WHEN length(w) - 1 >= r2 THEN {cut(1)} ELSE w END")]),
    ]
    out = [("marked", f"SELECT term, replace({y}, chr(1), 'Y') AS w FROM voc"),
           ("one", f"SELECT *, CASE WHEN {special} <> '' THEN length({special}) ELSE {pair('w')} END AS r1 FROM marked"),
           ("p0", f"SELECT *, r1 + {pair('substr(w, r1 + 1)')} AS r2, false AS done FROM one")]
    done = "w IN (" + ", ".join(q(x) for x in st.AFTER_1A) + ")"
    for i, step in enumerate(steps):
        out.append((f"q{i}", f"SELECT term, r1, r2, done, CASE WHEN done THEN w ELSE {step} END AS w FROM p{i}"))
        out.append((f"p{i + 1}", f"SELECT term, r1, r2, w, {done if i == 1 else 'done'} AS done FROM q{i}"))
    return out


STEM_BODY = ("SELECT term, CASE WHEN length(term) <= 2 THEN term "
             + " ".join(f"WHEN term = {q(a)} THEN {q(b)}" for a, b in st.EXCEPTIONS.items())
             + " ELSE replace(w, 'Y', 'y') END AS stem FROM p8")
