"""Corpus preprocessing (T1-T5, P4's first half): clean, tokenize, drop
stopwords, stem, lemmatize. Map-only except the optional lemma join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stopwords import DEFAULT_STOPWORDS
from ..session import cut_lineage


def prepare_corpus(corpus: DataFrame, remove_punctuation: bool = True,
                   remove_stopwords: bool = True, stem: bool = False,
                   lemmatize: bool = False, stopwords=None, stemmer=None,
                   lemmas: DataFrame | None = None, dictionary: DataFrame | None = None,
                   exceptions: DataFrame | None = None) -> DataFrame:
    """``(doc_id, sentence, label)`` -> ``(doc_id, label, tokens)``.

    ``stemmer`` is a ``str -> str`` function (default: the built-in
    Snowball English stemmer); ``lemmas`` a ``(token, lemma)`` table, or
    ``dictionary(lemma)`` and ``exceptions(token, lemma)`` for the rules."""
    text = F.col("sentence")
    if remove_punctuation:
        tokens = tx.tokenize(tx.clean_text(text))
    else:
        tokens = tx.tokenize_treebank(text)
    if remove_stopwords:
        tokens = tx.remove_stopwords(tokens, DEFAULT_STOPWORDS if stopwords is None else stopwords)
    out = corpus.select("doc_id", "label", tokens.alias("tokens"))
    if stem:
        from .stemming import stem_tokens
        out = out.withColumn("tokens", stem_tokens(F.col("tokens"), stemmer))
    if lemmatize:
        if lemmas is None and dictionary is None:
            raise ValueError("lemmatize=True needs a (token, lemma) table or a dictionary of lemmas")
        out = lemmatize_tokens(out, lemmas) if lemmas is not None else lemmatize_rules(out, dictionary, exceptions)
    return out


#: Characters of a lemma table that is broadcast.
MAX_LEMMA_CHARS = 64 << 20


def lemmatize_tokens(docs: DataFrame, lemmas: DataFrame, max_chars: int = MAX_LEMMA_CHARS) -> DataFrame:
    """T5: replace each token by its lemma where the table has one.

    A lemma table of at most ``max_chars`` characters (checked first) is
    broadcast and documents stay where they are. With a larger one tokens are
    joined to it with their position and put back in order per document."""
    lemmas = lemmas.where(F.col("token").isNotNull() & F.col("lemma").isNotNull()).select("token", "lemma")
    if (lemmas.agg(F.sum(F.length("token") + F.length("lemma") + 100)).first()[0] or 0) <= max_chars:
        table = lemmas.toArrow().combine_chunks()
        # of a token listed twice the last lemma holds
        last = {w: i for i, w in enumerate(table.column("token").to_pylist())}
        shared = docs.sparkSession.sparkContext.broadcast(tuple(
            table.column(c).take(pa.array(last.values(), pa.int64())).combine_chunks() for c in ("token", "lemma")))

        @F.arrow_udf("array<string>")
        def looked_up(lists: pa.Array) -> pa.Array:
            return pa.concat_arrays([looked_up_terms(lists.slice(a, SLICE), *shared.value)
                                     for a in range(0, max(1, len(lists)), SLICE)])
        return docs.withColumn("tokens", looked_up("tokens")).select(*docs.drop("tokens").columns, "tokens")
    lem = lemmas.select(F.col("token").alias("_tok"), F.col("lemma").alias("_lemma"))
    exploded = docs.select("doc_id", F.posexplode("tokens").alias("_pos", "_tok"))
    joined = exploded.join(lem, "_tok", "left")
    regrouped = (joined.groupBy("doc_id")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     "_pos", F.coalesce("_lemma", "_tok").alias("_w")))).alias("_s")))
    rest = docs.drop("tokens")
    return (rest.join(regrouped, "doc_id", "left")
            .select(*rest.columns, F.coalesce(F.transform("_s", lambda s: s["_w"]),
                                              F.array().cast("array<string>")).alias("tokens")))


#: Documents whose tokens are looked up at a time.
SLICE = 1_024


def looked_up_terms(lists: pa.Array, tokens: pa.Array, lemmas: pa.Array) -> pa.Array:
    """``lists`` of words with the lemmas of those among ``tokens``, null lists
    as empty ones. Words stay in Arrow's buffers: no object a word."""
    words = lists.flatten()
    at = pc.index_in(words, value_set=tokens, skip_nulls=True)
    found = pc.if_else(pc.is_valid(at), lemmas.cast(words.type).take(at), words)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


# The published detachment rules of the dictionary lemmatizer, by part of speech, in order.
DETACHMENTS = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}
#: Times the rules are applied to a word's own results before it is left as it is.
DETACH_ROUNDS = 4


def detached(word, pos: str):
    """The words that the rules make of ``word``, in the rules' order."""
    one = [F.when(word.endswith(end), F.concat(word.substr(F.lit(1), F.length(word) - len(end)), F.lit(to)))
           for end, to in DETACHMENTS[pos]]
    return F.filter(F.array(*one), lambda w: w.isNotNull()) if one else F.array().cast("array<string>")


def lemma_table(tokens: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, pos: str = "n",
                rounds: int = DETACH_ROUNDS) -> DataFrame:
    """T5 by rules: ``(token, lemma)`` of the distinct ``tokens(token)`` whose
    lemma is another word. ``dictionary(lemma)`` lists the known lemmas,
    ``exceptions(token, lemma)`` irregular forms.

    A listed exception takes its own lemmas; any other token itself and what
    the detachment rules make of it, and only where none of these is known what
    the rules make of that, up to ``rounds`` times. Of the known candidates of
    the first such step the shortest wins, the earlier one in ties; a token
    without one stays. Candidates are made in the row and joined once with the
    dictionary."""
    known = dictionary.select(F.col("lemma").alias("form")).where("form is not null").distinct()
    words = tokens.select("token").where("token is not null").distinct()

    def listed(forms, step: int):
        return F.transform(forms, lambda w, i: F.struct(F.lit(step).alias("step"), i.alias("place"), w.alias("form")))
    steps, forms = [F.array(F.struct(F.lit(0).alias("step"), F.lit(-1).alias("place"), F.col("token").alias("form")))], F.array("token")
    for r in range(rounds):
        forms = F.flatten(F.transform(forms, lambda w: detached(w, pos)))
        steps.append(listed(forms, max(0, r)))
    regular = words
    odd = None
    if exceptions is not None:
        own = exceptions.where("token is not null and lemma is not null").select("token", F.col("lemma").alias("form"))
        regular = words.join(own, "token", "left_anti")
        odd = (own.join(words, "token", "left_semi").select("token", F.lit(0).alias("step"), F.lit(0).alias("place"), "form")
               .union(words.join(own, "token", "left_semi").select("token", F.lit(0), F.lit(-1), F.col("token"))))
    made = regular.select("token", F.inline(F.concat(*steps)))
    made = made if odd is None else made.union(odd)
    best = made.join(known, "form").groupBy("token").agg(
        F.min(F.struct("step", F.length("form").alias("size"), "place", "form")).alias("best"))
    return best.select("token", F.col("best.form").alias("lemma")).where("lemma <> token")


def lemmatize_rules(docs: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, pos: str = "n",
                    rounds: int = DETACH_ROUNDS) -> DataFrame:
    """T5: every token replaced by its lemma by rules and dictionary."""
    tokens = docs.select(F.explode("tokens").alias("token"))
    return lemmatize_tokens(docs, cut_lineage(lemma_table(tokens, dictionary, exceptions, pos, rounds), "lemmas"))


def plural_lemmas(docs: DataFrame) -> DataFrame:
    """A lemma table derived from the corpus itself: a token ending in 's'
    whose stem without the 's' is also a token maps to that stem. Stands in
    for a dictionary in checks; any ``(token, lemma)`` table works."""
    vocab = docs.select(F.explode("tokens").alias("token")).distinct()
    cand = (vocab.where(F.col("token").endswith("s") & (F.length("token") > 3))
            .select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma")))
    return cand.join(vocab.select(F.col("token").alias("lemma")), "lemma", "left_semi")
