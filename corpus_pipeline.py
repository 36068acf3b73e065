"""Corpus pipeline: quality rules, quality classifier, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All stages but the last return the columns of ``docs``, whatever other columns and names
they are. A stage deletes the tables that it wrote for itself, but for those that its result reads; the result stays readable until
its caller deletes these (``run`` does, as it writes every result).

Defined results of every stage but the last: an empty table gives an empty one; rows are kept or dropped whole. Null and empty
texts have no words, so the first stage rejects them; the others keep them, but for what their score decides.
Rows that share a doc_id are judged each by their text; the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticejobs.llm import decision_list, langid, nbsvm, packing, pii, trie_join
from noticejobs.llm.common import delete_unread, leaves_nothing, release_memory, slices, stored, tracking
from noticejobs.llm.queries import documents, tokenizer_file

#: The whole cannot be expressed in SQL (learned rules and weights, trie join, packing).
ORACLE_SQL: str | None = None


def stage(body: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Delete what the stage stored for itself and its result does not read."""

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tracking() as held:
            out = body(spark, docs, sf_dir)
            delete_unread(out, held)
        release_memory()  # of the driver: what it gathered (sketch, weights) is free by now
        return out

    return run_stage


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what neither the base limits nor the learned decision list reject. A null label counts as none."""
    known = decision_list.labelled(docs.select("doc_id", "text"), labels(spark, sf_dir))
    rules = decision_list.learn(stored(decision_list.described(known).drop("text")))
    # The row travels as one struct, so that no column of it can clash with a statistic. A filter does not pass the row
    # number, which is not deterministic; below it each use of a statistic would compute it again.
    rows = decision_list.described(docs.select(F.struct("*").alias("_row"), "text")).withColumn("_number", F.monotonically_increasing_id())
    return rows.filter((F.col("_number") >= 0) & ~decision_list.base_failed() & ~rules.rejects()).select("_row.*")


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score of at least 0.3; the model learns from the labelled documents of the whole table."""
    model = nbsvm.learn(documents(spark, sf_dir), labels(spark, sf_dir).filter(langid.fold(5) != 0))
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    @leaves_nothing
    def run(batches):
        features = nbsvm.Features()
        for batch in batches:
            keep: list[bool] = []
            for _, rows in slices(batch.select(["doc_id", "text"])):
                keep += (shared.value.scores(*features.slots(rows)) >= 0.3).tolist()
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Null texts and null ids link with nothing and stay. Of rows that share a doc_id one stays, that whose row hashes to the
    least; equal rows among them are one.
    """
    groups = trie_join.jaccard_groups(docs, n=5, num=80, den=100)
    copies = stored(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    ids = F.broadcast(copies) if copies.count() <= trie_join.BROADCAST_IDS else copies  # else the table and the ids are joined by a shuffle
    # The row travels as one struct, so that no column of it can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = rows.join(ids, "doc_id", "left_anti")
    repeated = stored(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("doc_id is not null and count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select("_row.*")
    many = F.broadcast(repeated) if repeated.count() <= trie_join.BROADCAST_IDS else repeated
    single, several = kept.join(many, "doc_id", "left_anti"), kept.join(many, "doc_id", "left_semi")
    one = several.groupBy("doc_id").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return single.select("_row.*").unionByName(one.select("_row.*"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; ``n_chars``, where there is one, follows the text; a null text stays null."""
    rows = pii.detect(docs.select(F.struct("*").alias("_whole"), "text"), keep=("_whole",))
    text = pii.redacted(F.col("_whole.text"), F.col("all_spans"))
    changed = F.size("all_spans") > 0
    out = rows.select("_whole", text.alias("_text"), changed.alias("_changed"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    old = {name: F.col("_whole").getField(name) for name in docs.columns}
    return out.select(*[F.when(F.col("_changed"), new[c]).otherwise(v).cast(docs.schema[c].dataType).alias(c) if c in new else v.alias(c) for c, v in old.items()])


@stage
def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences; a null text has the end id alone, rows that share a doc_id are packed each."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("retrieval_packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with tracking() as held:
        for _, f in STAGES[:-1]:
            docs = stored(f(spark, docs, sf_dir))
            delete_unread(docs, held)
    return STAGES[-1][1](spark, docs, sf_dir)
