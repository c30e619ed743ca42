"""Label generation and assembly.

Generated names come from a caller-supplied function (the reference calls a
chat model); it runs inside ``mapInPandas`` on Arrow batches with a bounded
retry, so it is shipped once per task and never sees the whole table. Answers
can be kept by prompt, so that lost tasks and later runs do not ask again."""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The reference's prompt texts, joined without separators as
# the reference joins them.
DOC_PROMPT = "Generate a general topic for the following document. No header needed."
LABEL_PROMPT_1 = "Use one generic topic word to describe the following list of topics."
LABEL_PROMPT_2 = "Example labels: "
LABEL_PROMPT_3 = "The label should be with similar granuality of, but different from the examples."
LABEL_PROMPT_4 = "Your answer should limit to one single word."


def doc_prompts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """G1: fixed text followed by the document."""
    return docs.withColumn("prompt", F.concat(F.lit(DOC_PROMPT), F.col(text_col)))


def label_prompt_head(existing: DataFrame):
    """The cluster prompt's fixed part with the existing labels (sorted,
    joined by ', '), as a scalar column."""
    labels = existing.select(F.array_join(F.array_sort(F.collect_list("label")), ", ")).scalar()
    return F.concat(F.lit(LABEL_PROMPT_1), F.lit(LABEL_PROMPT_2), labels, F.lit("."),
                    F.lit(LABEL_PROMPT_3), F.lit(LABEL_PROMPT_4))


def cluster_prompts(topics: DataFrame, existing: DataFrame) -> DataFrame:
    """Per cluster, the head plus numbered topics ``'i. topic'`` in
    sample order, joined by newlines. ``topics(cluster, rank, topic)``."""
    g = (topics.groupBy("cluster")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("_t")))
    listing = F.array_join(F.transform("_t", lambda s: F.concat(s["rank"].cast("string"), F.lit(". "),
                                                                  s["topic"])), "\n")
    return g.select("cluster", F.concat(label_prompt_head(existing), listing).alias("prompt"))


def _answer_store(path: str):
    """(read, write) of answers by prompt digest in a shared folder, one small
    file each, moved into place when whole. Any URI that Arrow can open."""
    import pyarrow.fs as pafs
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def read(digest: str) -> str | None:
        name = f"{root}/{digest}"
        if store.get_file_info(name).type != pafs.FileType.File:
            return None
        with store.open_input_stream(name) as f:
            return f.read().decode()

    def write(digest: str, answer: str) -> None:
        part = f"{root}/{digest}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(answer.encode())
        store.move(part, f"{root}/{digest}")
    return read, write


def complete(prompts: DataFrame, generate, key_cols, retries: int = 5, base_delay: float = 1.0,
             retry_on: tuple = (ConnectionError, TimeoutError), batch_size: int = 16,
             tasks: int | None = None, answers: str | None = None, calls_per_second: float | None = None) -> DataFrame:
    """``generate(list[str]) -> list[str]`` over ``prompt`` with
    exponential backoff on ``retry_on``, in ``tasks`` tasks (default: the
    cluster's parallelism); the answer is cleaned (T9). Adds ``completion``.
    A call that does not give one answer a prompt is an error.

    With ``answers``, a folder that driver and executors share, each answer is
    kept there under its prompt's digest as soon as it is given, and looked up
    before a call: a task that is lost and repeated, and a later run, ask no
    answered prompt again, and equal prompts are asked once. The tasks
    together make at most ``calls_per_second`` calls."""
    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    pause = tasks / calls_per_second if calls_per_second else 0.0

    def asked(chunk: list[str]) -> list[str]:
        for attempt in range(retries + 1):
            try:
                out = list(generate(chunk))
                break
            except retry_on:
                if attempt == retries:
                    raise
                time.sleep(base_delay * (2 ** attempt))
        if len(out) != len(chunk):
            raise ValueError(f"{len(out)} answers for {len(chunk)} prompts")
        return out

    def run(batches):
        read, write = _answer_store(answers) if answers else (lambda d: None, lambda d, a: None)
        free_at = 0.0
        for pdf in batches:
            digests, texts = pdf["digest"].tolist(), pdf["prompt"].tolist()
            out: dict[str, str] = {}
            for i in range(0, len(texts), batch_size):
                here = range(i, min(i + batch_size, len(texts)))
                out.update({digests[k]: a for k in here if (a := read(digests[k])) is not None})
                open_ = [k for k in here if digests[k] not in out]
                if not open_:
                    continue
                time.sleep(max(0.0, free_at - time.monotonic()))
                free_at = time.monotonic() + pause
                for k, a in zip(open_, asked([texts[k] for k in open_]), strict=True):
                    write(digests[k], a)
                    out[digests[k]] = a
            yield pd.DataFrame({"digest": digests, "completion": [out[d] for d in digests]})
    keyed = prompts.select(*key_cols, F.sha2(F.col("prompt").cast("binary"), 256).alias("digest"), "prompt")
    distinct = keyed.select("digest", "prompt").dropDuplicates(["digest"]).where("prompt is not null")
    given = distinct.repartition(tasks, "digest").sortWithinPartitions("digest").mapInPandas(run, "digest string, completion string")
    return keyed.join(given, "digest", "left").select(*key_cols, tx.clean_label(F.col("completion")).alias("completion"))


def generate_cluster_labels(samples: DataFrame, docs: DataFrame, existing: DataFrame, generate,
                            **kw) -> DataFrame:
    """A topic per sampled document, then one name per cluster from the
    numbered topics. ``samples(cluster, doc_id, rank)``, ``docs(doc_id, tokens)``."""
    s = samples.join(docs.select("doc_id", F.array_join("tokens", " ").alias("text")), "doc_id")
    topics = complete(doc_prompts(s), generate, ["cluster", "rank"], **kw).withColumnRenamed("completion", "topic")
    named = complete(cluster_prompts(topics, existing), generate, ["cluster"], **kw)
    return named.select("cluster", F.col("completion").alias("name"))


def new_class_predictions(unconfident: DataFrame, names: DataFrame) -> DataFrame:
    """Each clustered unconfident document gets its cluster's name."""
    return unconfident.join(names.select("cluster", "name"), "cluster", "left").withColumnRenamed(
        "name", "prediction")


def full_predictions(confident: DataFrame, new_classes: DataFrame) -> DataFrame:
    """Confident documents keep the nearest known class, unconfident ones
    the generated name. ``(doc_id, label, prediction, is_confident)``; order
    by ``doc_id`` only when writing out. With ``tokens`` on both sides the
    document's ``text`` is added."""
    text = ([F.array_join("tokens", " ").alias("text")]
            if "tokens" in confident.columns and "tokens" in new_classes.columns else [])
    c = confident.select("doc_id", "label", F.col("best_label").alias("prediction"),
                         F.lit(True).alias("is_confident"), *text)
    n = new_classes.select("doc_id", "label", "prediction", F.lit(False).alias("is_confident"), *text)
    return c.unionByName(n)
