"""The stemmer in column expressions against the algorithm word by word."""

import random

from plain_snowball import EXCEPTIONS, STEP2, STEP3, STEP4
from plain_snowball import snowball_english as plain

from weaklabel.operators.stemming import stem_column, stem_tokens


def test_columns_equal_the_plain_algorithm(spark):
    rng = random.Random(12)
    ends = ["", *(a for a, _ in STEP2), *(a for a, _ in STEP3), *STEP4, "ing", "ingly", "ed", "edly", "eed", "eedly", "s", "ss", "us", "sses", "ies",
            "ied", "'s", "'s'", "'", "y", "e", "l", "ll", "bb", "att", "ble", "iz", "yy"]
    starts = ["", "gener", "commun", "arsen", "y", "'", "'y", "inn", "cann", "succ", "pro", "sky", "hop", "bey", "say", "ay"]
    words = {"".join([rng.choice(starts), *(rng.choice("aeiouybcdlnrstwxz") for _ in range(rng.randint(0, 5))), rng.choice(ends), rng.choice(ends[-30:] + [""] * 30)])
             for _ in range(15_000)}
    words |= set(EXCEPTIONS) | {"inning", "innings", "succeed", "succeeds", "étude", "中文s", "generate", "hoping", "hopping", "a", "is", "'", "''", "ying"}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "w string")
    rows = df.select("w", stem_column(df.w).alias("s")).collect()
    assert [(r.w, r.s) for r in rows if r.s != (None if r.w is None else plain(r.w))] == []
    tokens = spark.createDataFrame([(["running", "skies", None],), (None,)], "t array<string>")
    assert [r.s for r in tokens.select(stem_tokens(tokens.t).alias("s")).collect()] == [["run", "sky", None], None]
    assert tokens.select(stem_tokens(tokens.t, lambda w: None if w is None else w[:2]).alias("s")).first().s == ["ru", "sk", None]
