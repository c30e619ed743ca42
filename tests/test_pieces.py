import pytest

from weaklabel.operators import embeddings as em
from weaklabel.operators import pieces as pc

IDS = {p: i for i, p in enumerate("[UNK] un ##aff ##able play ##ing ##in ##g a ##b ##bc ##".split())}


def test_longest_match_first():
    cut = pc.WordPieces(IDS)
    names = {i: p for p, i in IDS.items()}
    assert [names[i] for i in cut("unaffable")] == ["un", "##aff", "##able"]
    assert [names[i] for i in cut("playing")] == ["play", "##ing"]
    assert [names[i] for i in cut("abc")] == ["a", "##bc"] and [names[i] for i in cut("abb")] == ["a", "##b", "##b"]
    for word in ("xyz", "unx", "", "a" * 101, "abcb" * 30, "é"):
        assert [names[i] for i in cut(word)] == ["[UNK]"]
    assert [names[i] for i in cut("##")] == ["##"]                # the mark alone is an ordinary piece
    with pytest.raises(ValueError, match="UNK"):
        pc.WordPieces({"a": 1})


def test_segmenter_from_a_table_and_chunks(spark):
    rows = [*IDS.items(), ("a", 99), (None, 5), ("zz", None)]
    seg = pc.word_pieces(spark.createDataFrame(rows, "piece string, id int"))
    assert seg("a") == [IDS["a"]] and seg("zz") == [0]
    with pytest.raises(ValueError, match="exceed"):
        pc.word_pieces(spark.createDataFrame(rows, "piece string, id int"), max_vocabulary=3)
    words = ["unaffable", "playing", "a", "xyz", "abc"] * 40
    docs = spark.createDataFrame([(1, words, "x"), (2, [], "x"), (3, None, "x"), (4, ["a"], "x")], "doc_id bigint, tokens array<string>, pos string")
    got = sorted((r.doc_id, r.pos, r.chunk, r.start, r.end) for r in pc.chunk_pieces(docs, seg, max_pieces=20, carry=7).collect())
    want, _ = em.prepare_sentence(words, seg, 20, 7)
    assert got == [(1, i, *p) for i, p in enumerate(want)] + [(4, 0, 0, 0, 1)]
    assert max(e for *_, e in got) <= 20 and all(e - s == len(seg(words[i])) for d, i, _, s, e in got if d == 1)
