"""Related notices, recommendations and questions.

Suggestions are searches: a stated set of queries goes in blocks against all rows (nearest.py). So frequent tags and words need no
cap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.operators.activity import current_saved, seen, trending_by_category, unseen_notices
from noticejobs.operators.nearest import Scores, best_partners, dealt, top_k

#: What a shared category lacks of a shared tag; sums of it and of whole numbers are exact.
LITTLE = 2.0**-10


def related_notices(notices: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Best k suggestions for each of ``queries`` (default: all): 2 for the same organization, 1 for the same category, 1 for
    each shared tag; at least one shared tag or the same organization."""
    tags = F.filter(F.coalesce(F.array_distinct("tags"), F.lit([]).cast("array<string>")), lambda t: t.isNotNull())
    label = lambda mark, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(mark), c))).otherwise(F.lit([]).cast("array<string>"))
    words = F.concat(F.transform(tags, lambda t: F.concat(F.lit("t"), t)), label("o", "organization"), label("c", "category"))
    # A category alone is no suggestion: it counts a little less than 1, and scores are rounded up from 1 on.
    weight = lambda w: F.when(F.startswith(w, F.lit("o")), 2.0).when(F.startswith(w, F.lit("c")), 1 - LITTLE).otherwise(1.0)
    described = lambda df: df.select(F.col("id").cast("long").alias("id"), words.alias("words")).withColumn("weights", F.transform("words", weight))
    score = Scores(lambda c, _, __: np.where(c >= 1, np.ceil(c), -np.inf), lambda s, _, __: np.maximum(s - 1 + LITTLE / 2, 1))

    best = best_partners(dealt(described(notices), "id"), described(notices if queries is None else queries), score, k)
    return best.select(F.col("a").alias("id"), "rank", F.col("b").alias("related_id"), F.col("score").cast("long").alias("score"))


def related_questions(messages: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Questions like each of ``queries`` (messages; default: all questions): Jaccard similarity of their words."""
    def words(df: DataFrame) -> DataFrame:
        found = F.array_distinct(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: w != ""))
        return df.filter("role = 'user' and content is not null").select(F.col("id").cast("long").alias("id"), found.alias("words")).withColumn("weights", F.transform("words", lambda _: F.lit(1.0)))

    def score(shared: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        value = np.round(shared / np.maximum(q + r - shared, 1), 6)
        return np.where(value > 0, value, -np.inf)

    def least(value: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        value = np.maximum(value - 1e-6, 0)
        return (value / (1 + value)).astype(np.float32) * (q + r).astype(np.float32) - np.float32(1e-3)

    best = best_partners(dealt(words(messages), "id"), words(messages if queries is None else queries), Scores(score, least, step=1e-6), k)
    return best.select(F.col("a").alias("id"), "rank", F.col("b").alias("related_id"), F.col("score").alias("jaccard"))


def class_rows(published: DataFrame) -> DataFrame:
    """``published`` with its class: category, high priority, trending. Within a class all notices have the same score for a user."""
    rows = published.withColumns({"high": F.coalesce(F.col("priority") == "high", F.lit(False)), "trending": F.coalesce("trending", F.lit(0))})
    return rows.withColumn("class", F.to_json(F.struct("category", "high", "trending")))


def best_candidates(asked: DataFrame, classed: DataFrame, activities: DataFrame, k: int) -> DataFrame:
    """Rows of ``asked`` (user_id, class, score, ...) with notices of their class, enough of them for the best k unseen ones of a user.

    Notices of a class go by id, so its first k, and one more for each that the user has seen there, hold its best k unseen ones. A class
    is left out where those with a higher score already have k unseen notices.
    """
    counts = seen(activities).join(classed.select("notice_id", "class"), "notice_id").groupBy("user_id", "class").agg(F.count("*").alias("seen_in"))
    depth = k + (counts.agg(F.max("seen_in")).first()[0] or 0)  # a constant, so that only so many rows of a class are sorted in one place
    ranked = classed.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("notice_id"))).filter(F.col("at") <= depth)
    first = ranked.groupBy("class").agg(F.array_sort(F.collect_list("notice_id")).alias("ids"))  # a row a class
    first = first.join(classed.groupBy("class").agg(F.count("*").alias("size")), "class")
    asked = asked.join(counts, ["user_id", "class"], "left").withColumn("seen_in", F.coalesce("seen_in", F.lit(0)))
    held = asked.join(F.broadcast(first.select("class", "size")), "class")
    higher = Window.partitionBy("user_id").orderBy(-F.col("score")).rangeBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.sum(F.col("size") - F.col("seen_in")).over(higher)).filter(F.coalesce("before", F.lit(0)) < k)
    taken = F.slice("ids", 1, F.lit(k) + F.col("seen_in").cast("int"))
    return held.join(F.broadcast(first.select("class", "ids")), "class").withColumn("notice_id", F.explode(taken)).drop("class", "ids", "size", "seen_in", "before")


def recommend(users: DataFrame, notices: DataFrame, activities: DataFrame, rules: DataFrame, k: int, as_of: str) -> DataFrame:
    """Best k unseen notices of each user, with the reason: of all published ones in the categories that the user viewed,
    saved in or has a rule for, and of the ten that are trending in each category."""
    meta = notices.select(F.col("id").alias("notice_id"), "category")
    per_category = lambda events, name: events.join(meta, "notice_id").groupBy("user_id", "category").agg(F.count("*").alias(name))
    viewed = per_category(activities.filter("type = 'view'").select("user_id", F.col("related_id").alias("notice_id")), "views_in")
    saved = per_category(current_saved(activities), "saves_in")
    wanted = rules.filter("enabled and type = 'category'").select("user_id", F.explode("conditions").alias("category")).distinct().withColumn("ruled", F.lit(1))
    taste = viewed.join(saved, ["user_id", "category"], "full_outer").join(wanted, ["user_id", "category"], "full_outer").na.fill(0, ["views_in", "saves_in", "ruled"])
    everyone = users.select(F.col("id").alias("user_id"))
    taste = taste.join(everyone, "user_id", "left_semi")
    published = notices.filter("status = 'published'").select(F.col("id").alias("notice_id"), "category", "priority", "organization")
    trend = [r["notice_id"] for r in trending_by_category(activities, notices, 10, as_of).distinct().collect()]  # ten a category at most
    published = published.withColumn("trending", F.col("notice_id").isin(trend).cast("int") if trend else F.lit(0))
    classed = class_rows(published)
    classes = classed.select("class", "category", "high", "trending").distinct()
    asked = taste.join(F.broadcast(classes), "category")
    if trend:  # everyone is offered what is trending elsewhere
        offered = everyone.crossJoin(F.broadcast(classes.filter("trending = 1"))).join(taste.select("user_id", "category"), ["user_id", "category"], "left_anti")
        asked = asked.unionByName(offered.withColumns({c: F.lit(0) for c in ("views_in", "saves_in", "ruled")}))
    terms = {"viewed": F.least("views_in", F.lit(10)), "saved": 3 * F.least("saves_in", F.lit(10)), "rule": 20 * F.col("ruled"), "priority": F.when(F.col("high"), 5).otherwise(0), "trending": F.col("trending")}
    most = F.greatest(*terms.values())
    asked = asked.select("user_id", "class", sum(terms.values(), F.lit(0)).cast("long").alias("score"), F.coalesce(*[F.when(v == most, n) for n, v in terms.items()]).alias("reason"))
    scored = unseen_notices(best_candidates(asked, classed, activities, k), activities)
    return top_k(scored, "user_id", [F.desc("score"), F.col("notice_id")], k).select("user_id", "rank", "notice_id", "score", "reason")
