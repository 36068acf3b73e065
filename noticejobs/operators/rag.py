"""Documents for question answering: chunks, statistics, categories (retrieval: search.py and nearest.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S


def search_documents(docs: DataFrame, q: str, category: str | None = None) -> DataFrame:
    out = docs.filter(S.any_of([S.holds("title", q), S.holds("category", q)])) if q else docs
    return out.filter(F.col("category") == category) if category else out


def askable_documents(docs: DataFrame) -> DataFrame:
    return docs.filter("embedded")


def sort_documents(docs: DataFrame, by: str) -> DataFrame:
    order = {"newest": F.desc_nulls_last("uploaded_at"), "viewed": F.desc_nulls_last("view_count"), "title": F.asc("title")}
    return docs.orderBy(order[by], "id")


def rag_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if("embedded").alias("embedded"), F.coalesce(F.sum(F.when(F.col("embedded"), F.col("chunk_count"))), F.lit(0)).alias("chunks"), F.count_if(~F.col("embedded")).alias("not_indexed"))


def toggle_embed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip ``embedded`` of the listed documents; a document that is off has no chunks."""
    flip = ids.select(F.col("id").alias("_id")).distinct()
    on = F.when(F.col("_id").isNotNull(), ~F.col("embedded")).otherwise(F.col("embedded"))
    return docs.join(flip, F.col("id") == F.col("_id"), "left").withColumn("embedded", on).drop("_id").withColumn("chunk_count", F.when(F.col("embedded"), F.col("chunk_count")).otherwise(0))


def chunk_total(length: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((length - overlap) / (size - overlap))).cast("int")


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_no, text): windows of ``size`` characters that overlap."""
    steps = F.sequence(F.lit(0), chunk_total(F.length("content"), size, overlap) - 1)
    return docs.filter(F.length("content") > 0).select(F.col("id").alias("doc_id"), "content", F.explode(steps).alias("chunk_no")).select("doc_id", "chunk_no", F.substring("content", F.col("chunk_no") * (size - overlap) + 1, F.lit(size)).alias("text"))


def auto_categorize(notices: DataFrame, keywords: dict[str, tuple[str, ...]], text: str = "content", minimum: float = 0.5) -> DataFrame:
    """Category of the source, else by keyword votes; confidence is the winner's share of the hits."""
    votes = {c: sum((F.when(S.holds(text, w), 1).otherwise(0) for w in words), F.lit(0)) for c, words in keywords.items()}
    total, most = sum(votes.values(), F.lit(0)), F.greatest(*votes.values())
    given = F.col("source_category") if "source_category" in notices.columns else F.lit(None).cast("string")
    voted = F.when(total > 0, F.coalesce(*[F.when(v == most, c) for c, v in votes.items()]))
    confidence = F.when(given.isNotNull(), 1.0).otherwise(F.when(total > 0, F.round(most / total, 6)).otherwise(0.0))
    return notices.withColumns({"auto_category": F.coalesce(given, voted), "confidence": confidence}).withColumn("to_moderation", F.col("confidence") < minimum)
