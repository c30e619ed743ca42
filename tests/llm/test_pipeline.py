"""The pipeline's stages, against what the operators say one document at a time."""

import corpus_pipeline
from weaklabel.llm import decontaminate, quality, simhash
from weaklabel.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == [name for name, _ in corpus_pipeline.STAGES] and len(steps) == 5
    good = steps["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.fit(quality.learnable(table(spark, SF, "labels")), docs)
    score = model.scorer()
    want = {r.doc_id for r in docs.collect() if score(r.text or "") >= quality.THRESHOLD}
    assert {r.doc_id for r in good.collect()} == want

    alone = steps["SimHash near-dedup"](spark, docs, SF)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in alone.collect()} == {d for d, c in groups.items() if c == d} and alone.columns == docs.columns

    clean = steps["benchmark decontamination"](spark, docs, SF)
    items = [set(decontaminate.shingles_of(decontaminate.words_of(r.text))) for r in table(spark, SF, "benchmark").collect()]

    def holds(text):
        own = set(decontaminate.shingles_of(decontaminate.words_of(text)))
        return any(i and len(i & own) >= 0.8 * len(i) for i in items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not holds(r.text)}

    masked = steps["secret scans"](spark, docs, SF)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in masked.collect():
        assert ("[SECRET]" in r.text) == (r.text != before[r.doc_id]) and r.n_chars == len(r.text)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.columns[:3] == ["doc_id", "piece", "start"]
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
