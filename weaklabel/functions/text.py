"""Text column functions (T1-T12). All are built-in Spark expressions, so
they stay inside whole-stage codegen and run where the data is.

Regex classes are spelled out instead of ``\\w`` / ``\\s``: Java's and RE2's
shorthands are ASCII-only, while the reference's Python regexes are
Unicode-aware. The same pattern strings run in DuckDB (RE2), which is what
keeps the SQL oracle in step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\w`` for str patterns: letters, digits and the underscore.
WORD_CHARS = r"\p{L}\p{N}_"
# Python's ``\s`` for str patterns (``str.isspace``).
SPACE_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

CLEAN_PATTERN = f"[^{WORD_CHARS}{SPACE_CHARS}]"          # T1: [^\w\s]
BLANKS_PATTERN = f"[{SPACE_CHARS}]+"                      # T2 split points
NON_WORD_PATTERN = f"[^{WORD_CHARS}]+"                    # T7 split points
TOKEN_PATTERN = f"[^{SPACE_CHARS}]+"                      # T2: runs between blanks
TOKEN_PUNCT_PATTERN = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}]"  # T2b
ANALYZER_PATTERN = f"[{WORD_CHARS}]{{2,}}"                # T7: (?u)\b\w\w+\b
ASCII_PUNCT_PATTERN = r"[!-/:-@\[-`{-~]"                  # T8: string.punctuation
QUOTE_PATTERN = "[\"']"                                   # T9: quotes first
# Blanks but the plain one, for Spark; the ASCII range settles nearly all characters.
ODD_BLANKS = f"[[^ -~]&&[{SPACE_CHARS}]]"

# The Penn Treebank tokenizer's contraction splits that still
# apply once punctuation is gone (whole lower-case tokens).
TREEBANK_SPLITS = {
    "cannot": ["can", "not"],
    "gimme": ["gim", "me"],
    "gonna": ["gon", "na"],
    "gotta": ["got", "ta"],
    "lemme": ["lem", "me"],
    "wanna": ["wan", "na"],
}

# The Penn Treebank tokenizer's published rules, in order, on
# lower-case text with single blanks; ``$1`` is the first group. A rule that is
# about a mark asks for the mark first and looks back for what stands before it,
# so that letters are passed quickly; ``\G`` keeps two matches from sharing a
# character. Before ...
TREEBANK_RULES = [
    ("([[^ -_a-~]&&[«“‘„]])", " $1 "),                                        # opening quotes
    ("(`+)", " $1 "),
    ('^"', "``"),
    ("(``)", " $1 "),
    (r"""([ (\[{<])("|'')""", "$1 `` "),
    (f"'(?!re|ve|ll|[mtsdn])([{WORD_CHARS}])(?![{WORD_CHARS}])", "' $1"),
    (r"""(\.)(?<=[^.]\.)([\])}>"'»”’]*)(?= |$)""", " $1 $2 "),                 # the period that ends a sentence
    (r"([:,])([^\p{Nd}])", " $1 $2"),                                         # not inside numbers
    ("([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),                                                    # ellipsis
    ("([;@#$%&?!])", " $1 "),
    (r"'(?<!\G')(?<=[^']') ", " ' "),
    (r"(\*)", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    ("(--)", " $1 "),
]
# ... and after a blank was put on either side.
TREEBANK_ENDINGS = [
    ("([[^ -~]&&[»”’]])", " $1 "),                                            # closing quotes
    ("('')", " $1 "),
    ('"', " '' "),
    ("(?=')(?<=[^' ])('[smd]|') ", " $1 "),
    ("(?=[n'])(?='|n't )(?<=[^' ])('ll|'re|'ve|n't) ", " $1 "),
    (f"(?=[cdglmw])(?=cann|d'y|gimm|gonn|gott|lemm|more'|wann)(?<![{WORD_CHARS}])(can|d|gim|gon|got|lem|more|wan)((?<=can)not|(?<=d)'ye|(?<=gim|lem)me|(?<=gon)na|(?<=got)ta|"
     f"(?<=more)'n|(?<=wan)na)(?![{WORD_CHARS}])", " $1 $2 "),
    (f" ('t)(is|was)(?![{WORD_CHARS}])", " $1 $2 "),
]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_text(col: Column) -> Column:
    """Drop every character that is neither a word character nor a blank."""
    return F.regexp_replace(col, CLEAN_PATTERN, "")


def _split_contractions(tokens: Column) -> Column:
    def one(t):
        expr = None
        for word, parts in TREEBANK_SPLITS.items():
            expr = (F.when(t == word, _lit_array(parts)) if expr is None
                    else expr.when(t == word, _lit_array(parts)))
        return expr.otherwise(F.array(t))
    # ``tokens`` is referenced once and bound to ``t``, so that the guard does not
    # make Catalyst evaluate the whole clean/split pipeline twice
    return F.get(F.transform(F.array(tokens), lambda t: F.when(
        F.arrays_overlap(t, _lit_array(TREEBANK_SPLITS)), F.flatten(F.transform(t, one))).otherwise(t)), F.lit(0))


def tokenize(col: Column, split_contractions: bool = True) -> Column:
    """Lower-case and split on blanks. NULL text gives an empty list.
    (Splitting and dropping empty pieces equals extracting the runs between
    blanks, at a quarter of the cost; a plain blank is split at without a
    regular expression, so the rarer ones are made plain first.)"""
    toks = F.coalesce(
        F.array_remove(F.split(F.regexp_replace(F.lower(col), ODD_BLANKS, " "), " "), ""),
        F.array().cast("array<string>"))
    return _split_contractions(toks) if split_contractions else toks


def tokenize_keep_punct(col: Column) -> Column:
    """Word runs and single punctuation marks, a plainer tokenizer than T2b's cascade."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PUNCT_PATTERN), 0),
        F.array().cast("array<string>"))


def tokenize_treebank(col: Column) -> Column:
    """The Penn Treebank cascade on the lower-cased text: quotes become
    pairs of back-ticks and apostrophes, contractions are split, numbers keep
    their points and commas, an ellipsis and double dashes are tokens. There
    is no trained sentence model: a period before a blank or the end of the
    text, closing marks between, ends a sentence. NULL text gives no tokens."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), ODD_BLANKS, " "), " {2,}", " "))
    for pattern, to in TREEBANK_RULES:
        text = F.regexp_replace(text, pattern, to)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in TREEBANK_ENDINGS:
        text = F.regexp_replace(text, pattern, to)
    return F.coalesce(F.filter(F.split(text, " +"), lambda w: w != ""), F.array().cast("array<string>"))


def remove_stopwords(tokens: Column, stopwords) -> Column:
    """Keep order, drop listed words (hash-set membership, not a scan)."""
    stop = sorted(set(stopwords))
    if not stop:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(stop))


def join_tokens(tokens: Column) -> Column:
    """``' '.join(doc)``."""
    return F.array_join(tokens, " ")


def analyzer_terms(tokens: Column, stopwords) -> Column:
    """The term analyzer of the TF-IDF step run over the joined tokens:
    runs of two or more word characters, minus the analyzer's stopwords."""
    # maximal word-character runs of length >= 2, i.e. ANALYZER_PATTERN's matches
    stop = sorted(set(stopwords))
    terms = F.filter(F.split(join_tokens(tokens), NON_WORD_PATTERN),
                     lambda w: (F.length(w) >= 2) & ~w.isin(stop) if stop else F.length(w) >= 2)
    return F.coalesce(terms, F.array().cast("array<string>"))


def strip_ascii_punct(col: Column) -> Column:
    """``word.translate(str.maketrans('', '', string.punctuation))``."""
    return F.regexp_replace(col, ASCII_PUNCT_PATTERN, "")


def clean_label(col: Column) -> Column:
    """Drop quotes, then ASCII punctuation, from a generated label."""
    return strip_ascii_punct(F.regexp_replace(col, QUOTE_PATTERN, ""))


def lower_label(col: Column) -> Column:
    """T10 (Q23: cast first, cluster ids may be integers)."""
    return F.lower(col.cast("string"))


def packed(tokens):
    """A list of words as ``STRUCT<text, words>`` that ``unpacked`` turns back
    into the same list. A row holds a string in a few bytes beside its
    characters and each item of a list in eight and filled up to eight, so
    shuffles of texts take a part of the disk. Lists with a NULL or a word with
    a line feed stay as they are."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    odd = c.isNull() | F.exists(c, lambda w: w.isNull() | w.contains("\n")) | (F.size(c) == 0)
    return F.struct(F.when(~odd, F.array_join(c, "\n")).alias("text"), F.when(odd, c).alias("words"))


def unpacked(pack):
    """The list of words that was ``packed``."""
    c = F.col(pack) if isinstance(pack, str) else pack
    return F.when(c["text"].isNotNull(), F.split(c["text"], "\n", -1)).otherwise(c["words"])


def packed_join(docs, other, how: str = "inner"):
    """``docs(doc_id, .., tokens)`` joined with ``other`` by ``doc_id``, its
    tokens ``packed`` while they are shuffled."""
    joined = docs.withColumn("tokens", packed("tokens")).join(other, "doc_id", how)
    return joined.withColumn("tokens", unpacked("tokens"))
