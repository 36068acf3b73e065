"""Conversations: pairs, context, summaries, ratings, citations, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S


def pair_questions(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant message right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("content").over(w)})
    return paired.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("content").alias("question"), "answer")


def context_window(messages: DataFrame, n: int) -> DataFrame:
    """Every message with the n turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return messages.withColumn("context", F.collect_list("content").over(w))


def conversation_summary(messages: DataFrame) -> DataFrame:
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(user).alias("questions"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("first_question"), F.max_by(F.when(assistant, F.col("content")), F.when(assistant, F.col("turn"))).alias("last_answer"),
        (F.max("turn") - F.min("turn")).alias("span"),
    )


def answer_quality(ratings: DataFrame) -> DataFrame:
    """Share of messages whose last rating is up."""
    last = ratings.groupBy("message_id").agg(F.max_by("rating", "ts").alias("rating"))
    return last.agg(F.count("*").alias("rated"), F.round(F.avg((F.col("rating") == "up").cast("int")), 6).alias("up_rate"))


def citation_counts(messages: DataFrame) -> DataFrame:
    return messages.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("citations"))


def search_conversations(messages: DataFrame, q: str) -> DataFrame:
    """Conversations with the text in any message."""
    return messages.filter(S.holds("content", q)).select("conv_id").distinct()


def search_rules(rules: DataFrame, q: str) -> DataFrame:
    return rules.filter(S.holds("name", q) | F.coalesce(F.exists("conditions", lambda c: S.holds(c, q)), F.lit(False)))
