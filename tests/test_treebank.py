"""The Treebank cascade against worked examples and against ``re`` with the
published rules on random strings."""

import random
import re

from pyspark.sql import functions as F

from weaklabel.functions import text as tx

EXAMPLES = {
    "He said, \"It's 3.50, isn't it?\"": "he said , `` it 's 3.50 , is n't it ? ''",
    "They'll cannot; I'd've gone... well--no.": "they 'll can not ; i'd 've gone ... well -- no .",
    "Prices: $1,000.50 (approx.) at 10:30, \"ok\".": "prices : $ 1,000.50 ( approx . ) at 10:30 , `` ok '' .",
    "'Tis gonna be 'fine' [yes]": "'t is gon na be 'fine ' [ yes ]",
    "John's dogs' toys, e.g. two. End": "john 's dogs ' toys , e.g . two . end",
    "": "", "  \n ": "",
    "a. b.c d.": "a . b.c d .",
}


def published(text):
    """The rules in Python's own regular expressions."""
    t = re.sub(r"\s+", " ", text.lower()).strip()
    for p, to in [(r"([«“‘„]|[`]+)", r" \1 "), (r'^"', "``"), (r"(``)", r" \1 "), (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
                  (r"(')(?!re|ve|ll|m|t|s|d|n)(\w)\b", r"\1 \2"), (r"""([^.])(\.)([\])}>"'»”’]*)(?= |$)""", r"\1 \2 \3 "),
                  (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.{2,}", r" \g<0> "), (r"[;@#$%&]", r" \g<0> "),
                  (r"[?!]", r" \g<0> "), (r"([^'])' ", r"\1 ' "), (r"[*]", r" \g<0> "), (r"[\]\[(){}<>]", r" \g<0> "), (r"--", " -- ")]:
        t = re.sub(p, to, t)
    t = f" {t} "
    for p, to in [(r"([»”’])", r" \1 "), (r"''", " '' "), (r'"', " '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
                  (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "), (r"\b(can)(not)\b", r" \1 \2 "), (r"\b(d)('ye)\b", r" \1 \2 "),
                  (r"\b(gim)(me)\b", r" \1 \2 "), (r"\b(gon)(na)\b", r" \1 \2 "), (r"\b(got)(ta)\b", r" \1 \2 "),
                  (r"\b(lem)(me)\b", r" \1 \2 "), (r"\b(more)('n)\b", r" \1 \2 "), (r"\b(wan)(na)\b", r" \1 \2 "),
                  (r" ('t)(is)\b", r" \1 \2 "), (r" ('t)(was)\b", r" \1 \2 ")]:
        t = re.sub(p, to, t)
    return t.split()


def test_treebank(spark):
    rng = random.Random(11)
    bits = ["can", "not", "cannot", "n't", "'s", "'ll", "'", "''", '"', "``", "`", ".", "..", "...", ",", ":", "--", "-", "1", "2.5", "é", "ab", " ",
            " ", " ", "(", ")", "[", "»", "“", "$", "&", "?", "!", "*", "gonna", "more", "'n", "d", "'ye", "'tis", "'t", "was", "is", "x", "\n", "wanna"]
    texts = [*EXAMPLES, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: list(r.w) for r in df.select("i", tx.tokenize_treebank(F.col("t")).alias("w")).collect()}
    assert got[-1] == []
    for i, t in enumerate(texts):
        assert got[i] == published(t), t
    for i, want in enumerate(EXAMPLES.values()):
        assert " ".join(got[i]) == want


def test_rules_that_look_back_equal_those_that_take_the_character_before(spark):
    import random

    before = [("([«“‘„]|`+)", " $1 "), (r"""([^.])(\.)([\])}>"'»”’]*)(?= |$)""", "$1 $2 $3 "), ("([^'])' ", "$1 ' "),
              ("([^' ])('[smd]|') ", "$1 $2 "), ("([^' ])('ll|'re|'ve|n't) ", "$1 $2 ")]
    now = [r for r in tx.TREEBANK_RULES + tx.TREEBANK_ENDINGS]
    heads = [["«“‘„", "`+"], [r"(\.)(?<="], [r"'(?<!\G"], ["'[smd]"], ["'ll|'re"]]
    rng = random.Random(7)
    bits = list("abn .'\")«`“’") + ["' ", "' ' ", "n't ", "'s ", "'ll ", ". ", ".' "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string")
    for (pattern, to), marks in zip(before, heads, strict=True):
        new = F.col("t")
        found = [r for r in now if any(m in r[0] for m in marks)]
        assert found and all(p != pattern for p, _ in found)
        for p, made in found:
            new = F.regexp_replace(new, p, made)
        assert df.where(~new.eqNullSafe(F.regexp_replace("t", pattern, to))).count() == 0, pattern
