import os
import tempfile

from weaklabel.sources import corpus as src


def test_cached_stage_reuses_output(spark):
    root = tempfile.mkdtemp(prefix="stage-")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)
    a, fp1 = src.cached_stage(spark, root, "nums", {"n": 5}, compute)
    b, fp2 = src.cached_stage(spark, root, "nums", {"n": 5}, compute)
    c, fp3 = src.cached_stage(spark, root, "nums", {"n": 5}, compute, upstream="other")
    assert len(calls) == 2 and fp1 == fp2 != fp3
    assert b.count() == 5


def test_split_roundtrip_prunes(spark):
    df = spark.createDataFrame([(1, "a", ["x"], "labeled"), (2, "b", ["y"], "unlabeled")],
                               "doc_id bigint, label string, tokens array<string>, split string")
    path = os.path.join(tempfile.mkdtemp(prefix="split-"), "t")
    src.write_split(df, path)
    part = src.read_split(spark, path, "labeled")
    assert [r.doc_id for r in part.collect()] == [1]


def test_text_vectors_roundtrip(spark):
    wv = spark.createDataFrame([("a", [0.1, -2.5e-7], 1)], "term string, vector array<double>, n_occ bigint")
    path = os.path.join(tempfile.mkdtemp(prefix="tv-"), "v")
    src.write_text_vectors(wv, path)
    back = src.read_text_vectors(spark, path).first()
    assert back.term == "a" and back.vector == [0.1, -2.5e-7]


def test_duplicate_ids_detected(spark):
    df = spark.createDataFrame([(1, "x", "a"), (1, "y", "a")], "doc_id bigint, sentence string, label string")
    assert src.duplicate_ids(df).count() == 1


def test_release_deletes_only_the_cuts_of_this_application(spark, tmp_path, monkeypatch):
    from weaklabel import session
    app = spark.sparkContext.applicationId
    monkeypatch.setattr(session, "_CUTS", {"another": ["/nowhere"]})
    monkeypatch.setattr(session, "_KEPT", {})
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: str(tmp_path))
    other = tmp_path / "tables" / "mine.txt"
    other.parent.mkdir()
    other.write_text("x")
    kept = session.keep(spark.range(3))
    assert session.cut_lineage(kept, "a").count() == session.cut_lineage(kept, "b").count() == 3
    assert len(session._CUTS[app]) == 2 and len(list(other.parent.iterdir())) == 3
    assert session.release(spark) == 2 and session.release(spark) == 0
    assert [p.name for p in other.parent.iterdir()] == ["mine.txt"] and not kept.storageLevel.useMemory
    assert session._CUTS == {"another": ["/nowhere"]}
