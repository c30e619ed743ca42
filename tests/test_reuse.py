"""Stage reuse across runs, and answers that outlive lost tasks."""

import os

import pytest

from weaklabel.operators import naming as nm
from weaklabel.plans.runner import run_model
from weaklabel.sources import corpus as src


def test_a_second_run_computes_nothing_and_changes_rerun_downstream(spark, tmp_path):
    rows = [(i, f"{'apple pear plum' if i % 3 else 'dog cat cow'} word{i % 7} thing{i % 5}", "fruit" if i % 3 else "pets") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, sentence string, label string").write.parquet(str(tmp_path / "in"))
    wv = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("apple pear plum dog cat cow".split())], "term string, vector array<double>")

    def run(**kw):
        out = run_model(spark.read.parquet(str(tmp_path / "in")), "test", word_vectors=wv, store=str(tmp_path / "store"), **kw)
        return out["written"], sorted(map(tuple, out["predictions"].select("doc_id", "prediction").collect()))
    first, preds = run()
    assert first[0] == "split" and first[-1] == "predictions" and len(first) == len(set(first)) >= 10
    assert run() == ([], preds)
    later, _ = run(threshold=0.9)
    assert later == ["scored", "clusters", "names", "predictions"]
    assert run(threshold=0.9)[0] == [] and run()[0] == []
    spark.createDataFrame([(100, "apple dog", "pets")], "doc_id bigint, sentence string, label string").write.mode("append").parquet(str(tmp_path / "in"))
    again, more = run()
    assert again[0] == "split" and "predictions" in again and more != preds


def test_input_digest_of_rows_and_settings(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    assert src.input_digest(a) == src.input_digest(spark.createDataFrame([(1, "x")], "i int, s string"))
    assert src.input_digest(a) != src.input_digest(a.union(a)) and src.input_digest(a) != src.input_digest(a.select("i"))
    s = src.settings_of({"f": test_input_digest_of_rows_and_settings, "k": 3, "t": a})
    assert s["f"].endswith("test_input_digest_of_rows_and_settings") and s["k"] == 3 and s["t"] == src.input_digest(a)


def counting(folder, fail_once=None):
    """A generator that notes every prompt it was asked, and dies once."""
    def generate(prompts):
        for p in prompts:
            with open(os.path.join(folder, "asked"), "a") as f:
                f.write(p + "\n")
        if fail_once and any(fail_once in p for p in prompts) and not os.path.exists(os.path.join(folder, "died")):
            open(os.path.join(folder, "died"), "w").close()
            raise RuntimeError("task lost")
        return [p.upper() for p in prompts]
    return generate


def test_answered_prompts_are_never_asked_again(spark, tmp_path):
    rows = [(i, f"prompt {i % 40}") for i in range(80)] + [(99, None)]
    prompts = spark.createDataFrame(rows, "doc_id bigint, prompt string")
    store = (tmp_path / "answers").as_uri()

    def ask(fail=None):
        out = nm.complete(prompts, counting(str(tmp_path), fail), ["doc_id"], batch_size=1, tasks=1, answers=store)
        return {r.doc_id: r.completion for r in out.collect()}
    with pytest.raises(Exception, match="task lost"):                   # the task dies in the middle
        ask("prompt 17")
    before = (tmp_path / "asked").read_text().splitlines()
    got = ask("prompt 17")
    asked = (tmp_path / "asked").read_text().splitlines()
    assert got == {i: f"PROMPT {i % 40}" for i in range(80)} | {99: None}
    assert len(before) >= 1 and all(asked.count(p) == 1 + (p == "prompt 17") for p in set(asked)) and len(set(asked)) == 40
    ask()
    assert (tmp_path / "asked").read_text().splitlines() == asked


def test_calls_are_paced(spark, tmp_path):
    import time
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "doc_id bigint, prompt string")
    start = time.time()
    assert nm.complete(prompts, counting(str(tmp_path)), ["doc_id"], batch_size=1, tasks=1, calls_per_second=4.0).count() == 6
    nm.complete(prompts, counting(str(tmp_path)), ["doc_id"], batch_size=1, tasks=1, calls_per_second=4.0).collect()
    assert time.time() - start > 1.2
