"""The convolutional classifier against a plain forward pass and held-out rows."""

import random
import re

import numpy as np
import pytest

from weaklabel.llm import queries, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score double"
INSULTS = {"en": ["gromlin", "vexard"], "de": ["schnurzel", "blotzer"]}


def sentence(rng, lang, n):
    words = toxicity.FUNCTION_WORDS[lang].split()
    own = [f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}um" for i in range(300)]
    return [rng.choice(words) if rng.random() < 0.4 else rng.choice(own) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        w = sentence(rng, lang, rng.randint(5, 80))
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS[lang]) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame([(*r[:3], None) for r in corpus], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[3]) for r in corpus if r[0] % 5], "doc_id bigint, label int")
    return toxicity.fit(labels, docs)


def test_held_out_rows_and_long_texts(spark, corpus, model):
    docs = spark.createDataFrame([(*r[:3], None) for r in corpus], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in corpus if r[0] % 5 == 0]
    assert sum(got[r[0]].predicted == r[3] for r in held) >= 0.97 * len(held)
    assert {"", "en", "de"} <= set(model.curves)
    rng = random.Random(7)
    clean = " ".join(sentence(rng, "en", 100_000))
    worst = clean + " gromlin vexard, gromlin"
    low, high, mixed = model.scores([clean, worst, clean[:300] + "\nVEXARD!! gromlin " + clean[300:600]])
    assert low < toxicity.THRESHOLD <= min(high, mixed)


def test_scores_read_the_text_alone(spark, corpus, model):
    text = corpus[1][1]
    rows = [(1, text, "en", None), (-5, text, "zz", 1.0), (None, text, None, None), (1, text, "en", None)]
    got = toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1


def test_awkward_rows(spark, model):
    rows = [(1, None, None, None), (2, "", None, None), (3, " \n\t!!!", None, None), (4, "x" * 3_000_000, None, None),
            (5, "中文 é 𝄞 " * 1000, None, None), (None, "gromlin", None, None)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got[1].score == got[2].score == got[3].score and got[1].predicted == 0 and len(got) == 6
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    docs = spark.createDataFrame([(1, "a b", None, None)], SCHEMA)
    for labels in ([(1, 1)], []):
        blind = toxicity.fit(spark.createDataFrame(labels, "doc_id bigint, label int"), docs)
        assert [(r.score, r.predicted) for r in toxicity.score(docs, blind).collect()] == [(0.5, 0)]


def plain_logit(net, text):
    """One window at a time, over all words of the text and the zeros after it."""
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    known = {int(b): i + 1 for i, b in enumerate(net.buckets)}
    x = [net.embedding[known.get(toxicity.bucket(w), 0)] for w in words] + [net.embedding[0]] * 3
    pooled = []
    for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
        ys = [np.concatenate(x[i:i + w]) @ f + b for i in range(len(words) + 1)]
        pooled.append(np.maximum(np.max(ys, 0), 0))
    return float(np.concatenate(pooled) @ net.out + net.out_bias)


def test_forward_pass_against_plain_windows(corpus, model, monkeypatch):
    texts = ["", "gromlin", "unknown words only", *(r[1] for r in corpus[:40]), " ".join(r[1] for r in corpus[:60])]
    for piece, block in [(1 << 20, 1 << 15), (50, 7)]:
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got = [model.network.logit(w) for w in toxicity.runs(texts)]
        assert np.allclose(got, [plain_logit(model.network, t) for t in texts], atol=1e-3)


def test_language_and_cuts():
    assert [toxicity.language(w) for w in toxicity.runs(["the cat is in the house", "das Haus ist nicht auf dem Berg", "zzz yyy", ""])] == ["en", "de", "", ""]
    text = "ab " * 50 + "x" * 100 + " cd"
    assert "".join(toxicity.pieces(text, 20)) == text and "x" * 100 in "|".join(toxicity.pieces(text, 20))
    logit, label = np.array([-3.0, -2.0, 1.0, 4.0, 5.0]), np.array([0.0, 0, 0, 1, 1])
    assert 1 < toxicity.threshold(logit, label, np.ones(5)) < 4
    a, b = toxicity.calibrated(logit, label, np.ones(5))
    assert a > 0 and 1 / (1 + np.exp(-(a * 2.5 + b))) == pytest.approx(toxicity.THRESHOLD)


def test_never_learns_from_held_out_rows(spark):
    import zlib
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id for r in toxicity.learnable(labels).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_query(spark):
    got = queries.queries()["op11_toxicity"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score is null").count() == 0


def test_learns_from_every_row_and_word(spark, monkeypatch):
    """Rows in shards, each beyond its first words: an insult that stands only
    at the end of long texts is learned, from all rows that have it."""
    monkeypatch.setattr(toxicity, "ALONE_ROWS", 1_000)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1_000)
    rng = random.Random(8)
    rows = []
    for i in range(3_000):
        w = sentence(rng, "en", 5_000 if i % 100 == 0 else 60)
        rows.append((i, " ".join([*w, *(["gromlin", "vexard"] if i % 4 == 0 else [])]), "en", None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(3_000)], "doc_id bigint, label int")
    kept = toxicity.hashed_rows(labels, docs).collect()
    assert sorted(len(r.words) // 4 for r in kept) == sorted(len(r[1].split()) for r in rows)
    model = toxicity.fit(labels, docs)
    tail = " ".join(sentence(rng, "en", 5_000))
    low, high = model.scores([tail, tail + " gromlin vexard"])
    assert low < toxicity.THRESHOLD <= high


def test_copies_count_once(spark):
    docs = spark.createDataFrame([(1, "a b", None, None), (2, "a b", None, None), (3, "c", None, None), (4, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (2, 0), (4, 0)], "doc_id bigint, label int")
    got = toxicity.hashed_rows(labels, docs).collect()
    assert sorted((r.label, len(r.words) // 4) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 2)]
