"""The pipeline on a small table, each stage against what it promises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticejobs.llm import common
from noticejobs.llm.common import stored

pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in ("ri", "sto", "bla", "men", "tor", "qua", "fel") for b in ("ver", "ne", "ding", "ta", "lo", "mi")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for k in range(240):
        w = list(rng.choice(WORDS, 120))
        if k % 4 == 0:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
        labels.append((k, int(k % 4 != 0), 0))
    texts[11] = texts[10] + " tail"
    texts[22] = texts[21]
    texts[30] = None
    texts[33] += " write to jo@example.com now"
    rows = [(k, t, "en", "s0", len(t or "")) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality_rules"]) == {k for k in range(240) if k % 4 and k != 30}
    assert set(kept["quality_classifier"]) == set(kept["quality_rules"])
    assert set(kept["ngram_jaccard_join"]) == set(kept["quality_rules"]) - {11, 22}
    assert "[EMAIL]" in kept["personal_data"][33] and set(kept["personal_data"]) == set(kept["ngram_jaccard_join"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept["personal_data"])


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_ids(spark, folder):
    """Names that the stages use themselves, and rows that share an id, through the stages that keep columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("copy_id", "component_id", "n_words", "base", "found", "all_spans", "y", "h", "score"):
        docs = docs.withColumn(name, F.lit("clash"))
    text = {r.doc_id: r.text for r in docs.collect()}
    docs = docs.unionByName(docs.filter("doc_id = 1")).unionByName(docs.filter("doc_id = 2").withColumn("text", F.lit(text[5] + " other end")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == columns, name
    got = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted(got) == sorted(set(got)) and {1, 2} <= set(got)
    assert {r[0] for r in docs.select("copy_id").distinct().collect()} == {"clash"}


def test_null_labels_and_ids(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 50, F.col("doc_id")))
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("quality", F.when(F.col("doc_id") % 7 > 0, F.col("quality")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stored(stage(spark, kept, str(tmp_path)))
    assert kept.filter("doc_id is null").count() == 1 and kept.count() > 150


def test_a_result_outlives_the_next_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        results.append(stage(spark, results[-1] if results else docs, folder))
    counts = [x.count() for x in results]
    assert [x.count() for x in results] == counts == sorted(counts, reverse=True) and counts[-1] > 0
    corpus_pipeline.run(spark, folder).count()
    assert [x.count() for x in results] == counts


def test_a_task_gives_its_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release_memory", lambda: done.append(1))
    task = common.leaves_nothing(lambda batches: (x + 1 for x in batches))
    assert list(task(iter([1, 2]))) == [2, 3] and done == [1]


def test_memory_of_a_task_goes_back_to_the_system():
    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])

    @common.leaves_nothing
    def run(batches):
        held = [bytes(1000) for _ in range(200_000)]
        kept.extend(held[::20_000])  # what stays lies between what is freed
        del held
        yield resident()

    kept = []
    (before,) = run([])
    assert resident() < before + 20_000
