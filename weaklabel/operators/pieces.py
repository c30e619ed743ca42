"""Word pieces (E8): longest-match-first segmentation with a user's piece
vocabulary, as the encoders of contextual vectors need it.

The vocabulary is one bounded table (its size is checked) that becomes a trie
in a broadcast; words are walked through it once, so a word costs its length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embeddings import CARRY_OVER, MAX_PIECES, prepare_sentence

#: Pieces of a vocabulary, and words whose pieces a task remembers.
MAX_VOCABULARY = 2_000_000
MEMORY = 100_000


class WordPieces:
    """``word -> ids``. Pieces inside a word carry ``mark``; a word that cannot
    be cut into pieces, is empty or has more than ``max_chars`` characters is
    the one piece ``unknown``."""

    def __init__(self, ids: dict[str, int], unknown: str = "[UNK]", mark: str = "##", max_chars: int = 100):
        if unknown not in ids:
            raise ValueError(f"the vocabulary has no {unknown!r}")
        self.unknown, self.max_chars = ids[unknown], max_chars
        self.first: dict = {}
        self.rest: dict = {}
        self.known: dict[str, list[int]] = {}
        for piece, i in ids.items():
            inside = piece.startswith(mark) and len(piece) > len(mark)
            node = self.rest if inside else self.first
            for c in piece[len(mark):] if inside else piece:
                node = node.setdefault(c, {})
            node[""] = i                                     # the empty key ends a piece

    def __call__(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[word] = self.cut(word)
        return found

    def cut(self, word: str) -> list[int]:
        if not word or len(word) > self.max_chars:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            node, best = (self.rest if at else self.first), None
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    best = k + 1, node[""]
            if best is None:
                return [self.unknown]
            at = best[0]
            out.append(best[1])
        return out


def word_pieces(vocabulary: DataFrame, max_vocabulary: int = MAX_VOCABULARY, **kw) -> WordPieces:
    """The segmenter of ``vocabulary(piece, id)``; of equal pieces the smallest
    id counts. More than ``max_vocabulary`` pieces are an error."""
    v = vocabulary.where("piece is not null and id is not null").groupBy("piece").agg(F.min("id").alias("id"))
    n = v.count()
    if n > max_vocabulary:
        raise ValueError(f"{n} pieces exceed {max_vocabulary}")
    return WordPieces({r["piece"]: r["id"] for r in v.collect()}, **kw)


def chunk_pieces(docs: DataFrame, pieces: WordPieces, col: str = "tokens", max_pieces: int = MAX_PIECES,
                 carry: int = CARRY_OVER) -> DataFrame:
    """E8 for words of several pieces: ``(doc_id, pos, chunk, start, end)`` of
    every word, the last three counted in pieces of its chunk. Map-only; a
    document without words gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for pdf in batches:
            for doc_id, words in zip(pdf["doc_id"], pdf[col], strict=True):
                if words is None or not len(words):
                    continue
                positions, _ = prepare_sentence(list(words), shared.value, max_pieces, carry)
                out = pd.DataFrame(positions, columns=["chunk", "start", "end"])
                out.insert(0, "doc_id", doc_id)
                out.insert(1, "pos", range(len(out)))
                yield out
    return docs.select("doc_id", col).mapInPandas(run, "doc_id long, pos int, chunk int, start int, end int")
