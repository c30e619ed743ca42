from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from weaklabel.functions import text as tx
from weaklabel.functions.stopwords import SPARK_ENGLISH
from weaklabel.operators.preprocess import prepare_corpus
from plain_snowball import snowball_english


def test_stopwords_equal_spark_list(spark):
    assert SPARK_ENGLISH == StopWordsRemover.loadDefaultStopWords("english")


def test_clean_and_tokenize_unicode(spark):
    df = spark.createDataFrame([("Ça va, où_1?",)], "s string")
    r = df.select(tx.clean_text(F.col("s")).alias("c"), tx.tokenize(tx.clean_text(F.col("s"))).alias("t")).first()
    assert r.c == "Ça va où_1"
    assert r.t == ["ça", "va", "où_1"]


def test_empty_inputs_give_empty_tokens(spark):
    df = spark.createDataFrame([(1, ""), (2, "?!.,"), (3, None), (4, "  \n ")], "id int, s string")
    out = dict(df.select("id", tx.tokenize(tx.clean_text(F.col("s"))).alias("t")).collect())
    assert out == {1: [], 2: [], 3: [], 4: []}


def test_treebank_contractions(spark):
    df = spark.createDataFrame([("I cannot go, gonna stay",)], "s string")
    assert df.select(tx.tokenize(tx.clean_text(F.col("s")))).first()[0] == ["i", "can", "not", "go", "gon", "na", "stay"]


def test_keep_punct_tokens(spark):
    df = spark.createDataFrame([("Hi, you!",)], "s string")
    assert df.select(tx.tokenize_keep_punct(F.col("s"))).first()[0] == ["hi", ",", "you", "!"]


def test_analyzer_drops_short_and_stop(spark):
    df = spark.createDataFrame([(["a", "bb", "the", "ccc", "x-yy"],)], "t array<string>")
    assert df.select(tx.analyzer_terms(F.col("t"), SPARK_ENGLISH)).first()[0] == ["bb", "ccc", "yy"]


def test_clean_label(spark):
    df = spark.createDataFrame([('"Sports"!',), ("'Arts & Crafts'",)], "s string")
    assert [r[0] for r in df.select(tx.clean_label(F.col("s"))).collect()] == ["Sports", "Arts  Crafts"]


def test_prepare_corpus_stopwords_flag(spark, mini_corpus):
    extra = spark.createDataFrame([(9, "The dog and the eel", "b")], mini_corpus.schema)
    kept = prepare_corpus(extra, remove_stopwords=False).first().tokens
    dropped = prepare_corpus(extra, remove_stopwords=True).first().tokens
    assert kept == ["the", "dog", "and", "the", "eel"]
    assert dropped == ["dog", "eel"]


def test_snowball_samples():
    cases = {"running": "run", "generously": "generous", "happiness": "happi", "ponies": "poni",
             "caresses": "caress", "agreed": "agre", "national": "nation", "dying": "die", "sky": "sky"}
    assert {w: snowball_english(w) for w in cases} == cases


def test_stem_tokens_udf(spark):
    df = spark.createDataFrame([(1, "cats running happily", "a")], "doc_id bigint, sentence string, label string")
    assert prepare_corpus(df, stem=True).first().tokens == ["cat", "run", "happili"]


def test_lemmatize_by_rules(spark):
    from weaklabel.operators.preprocess import lemma_table, lemmatize_rules, prepare_corpus
    docs = spark.createDataFrame([(1, ["dogs", "churches", "geese", "wolves", "glasses", "bus", "women", "ponies", "xyzs", "dogs"]), (2, []), (3, None)],
                                 "doc_id bigint, tokens array<string>")
    words = spark.createDataFrame([(w,) for w in "dog church goose wolf glass bus woman pony bu geese axe ax".split()] + [(None,)], "lemma string")
    odd = spark.createDataFrame([("geese", "goose"), ("oxen", "ox"), (None, "x"), ("axes", "axe"), ("axes", "ax")], "token string, lemma string")
    got = {r.doc_id: r.tokens for r in lemmatize_rules(docs, words, odd).collect()}
    assert got[1] == ["dog", "church", "geese", "wolf", "glass", "bu", "woman", "pony", "xyzs", "dog"]
    assert not got[2] and not got[3]
    # An exception keeps to its own forms, unknown ones leave the word; further rounds only where nothing was known.
    t = spark.createDataFrame([("oxen",), ("axes",), ("dogss",), ("running",)], "token string")
    assert {r.token: r.lemma for r in lemma_table(t, words, odd).collect()} == {"axes": "ax", "dogss": "dog"}
    assert {r.token: r.lemma for r in lemma_table(t, spark.createDataFrame([("runn",)], "lemma string"), pos="v").collect()} == {"running": "runn"}
    corpus = spark.createDataFrame([(1, "Two dogs!", "a")], "doc_id bigint, sentence string, label string")
    assert prepare_corpus(corpus, lemmatize=True, dictionary=words).first().tokens[-1] == "dog"


def test_packed_words_come_back_and_are_shuffled_as_text(spark):
    from weaklabel.functions import text as tx
    rows = [(1, ["a", "bb", ""]), (2, []), (3, [""]), (4, None), (5, ["x", None]), (6, ["l\nf", "y"]), (7, ["p q", "\\n", ""]), (None, ["z"]), (1, ["c"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    other = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "doc_id bigint, v int")
    for how in ("inner", "left"):
        got = tx.packed_join(docs, other, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.join(other, "doc_id", how).collect()))
    assert docs.select(tx.packed("tokens").alias("p")).where("p.text is not null and p.words is not null").count() == 0
    assert docs.select(tx.packed("tokens").alias("p")).where("p.text is not null").count() == 5
