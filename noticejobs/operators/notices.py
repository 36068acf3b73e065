"""Browsing notices: filters, search, facets, sorting, paging, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S
from noticejobs.sources.schemas import CATEGORY_NAMES

SEARCHED = ("title", "ai_summary", "description", "organization")
#: Weight of a query term by the field it is found in. Fixed values.
WEIGHTS = {"title": 5, "tags": 4, "organization": 3, "description": 2, "ai_summary": 2, "content": 1}


def published(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "published")


def search_hit(df: DataFrame, q: str, fields: Sequence[str]) -> Column:
    tests = [S.holds(c, q) for c in fields if c in df.columns]
    if "tags" in df.columns:
        tests.append(tag_hit(q))
    return S.any_of(tests)


def search_notices(df: DataFrame, q: str, scope: str = "list") -> DataFrame:
    """Literal, case-insensitive substring over the listed fields and tags; scope "global" adds content and category."""
    return df.filter(search_hit(df, q, SEARCHED + (("content", "category") if scope == "global" else ()))) if q else df


def filter_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Equality; "all" is no filter."""
    return df if value == "all" else df.filter(F.col(column) == value)


def advanced_filter(df: DataFrame, categories=(), date_from=None, date_to=None, organizations=(), priorities=(), is_ocr=None, deadline=None, as_of=None) -> DataFrame:
    """All given filters at once; ``deadline`` is "upcoming" or "expired"."""
    for column, values in (("category", categories), ("organization", organizations), ("priority", priorities)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    if date_from:
        df = df.filter(F.col("published_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        df = df.filter(F.col("published_at") <= F.lit(date_to).cast("timestamp"))
    if is_ocr is not None:
        df = df.filter(F.coalesce("is_ocr", F.lit(False)) == is_ocr)
    return {None: lambda: df, "upcoming": lambda: upcoming(df, as_of), "expired": lambda: expired(df, as_of)}[deadline]()


def deadline_status(df: DataFrame, as_of: str) -> DataFrame:
    days = F.col("days")
    said = F.when(days < 0, "Closed").when(days == 0, "Closes today").when(days == 1, "Closes tomorrow").when(days > 1, F.concat(days.cast("string"), F.lit(" days remaining")))
    return df.withColumn("days", S.deadline_days("deadline", as_of)).withColumns({"deadline_label": said, "urgent": F.coalesce(days.between(0, 7), F.lit(False))})


def upcoming(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(S.deadline_days("deadline", as_of) >= 0)


def expired(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(S.deadline_days("deadline", as_of) < 0)


def urgent_notices(df: DataFrame, n: int = 2) -> DataFrame:
    return df.filter(F.col("priority") == "high").orderBy(F.desc_nulls_last("published_at"), "id").limit(n)


def title_search(df: DataFrame, q: str) -> DataFrame:
    return df.filter(S.holds("title", q))


def notice_badges(df: DataFrame, as_of: str) -> DataFrame:
    days = S.deadline_days("deadline", as_of)
    ocr = F.coalesce("is_ocr", F.lit(False))
    return df.withColumns({
        "badge_ocr": ocr, "badge_urgent": F.coalesce(days.between(0, 7), F.lit(False)), "badge_summary": F.coalesce(F.col("ai_summary") != "", F.lit(False)),
        "portal_label": F.coalesce("source_portal", F.lit("Unknown")),
        "ocr_label": F.when(ocr, F.concat(F.lit("OCR "), F.coalesce("ocr_confidence", F.lit(90)).cast("string"), F.lit("%"))),
    })


def normalize_notices(df: DataFrame) -> DataFrame:
    """Both schema flavours as the canonical one: fields merged, enums mapped."""
    def either(*names: str) -> Column:
        have = [n for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    mapping = F.create_map(*[F.lit(x) for item in CATEGORY_NAMES.items() for x in item])
    category = F.lower("category")
    return df.withColumns({
        "category": F.coalesce(F.try_element_at(mapping, category), category),
        "priority": F.when(F.lower("priority") == "medium", "normal").otherwise(F.lower("priority")),
        "deadline": either("deadline", "expires_at"), "ai_summary": either("ai_summary", "summary"),
    }).drop("expires_at", "summary")


def publish_scheduled(df: DataFrame, as_of: str) -> DataFrame:
    due = (F.col("status") == "draft") & (F.col("published_at") <= S.moment(as_of))
    return df.withColumn("status", F.when(due, "published").otherwise(F.col("status")))


def category_counts(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category of the dimension with its number of notices, 0 when empty."""
    return categories.join(df.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def facet_counts(df: DataFrame) -> DataFrame:
    """Published notices in all ("all") and per category."""
    return published(df).rollup("category").agg(F.count("*").alias("n"), F.grouping("category").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n")


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of each column, in one pass of grouping sets."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    name = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, c) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in columns])
    return sets.select(name.alias("facet"), value.alias("value"), "n")


def count_portals(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct portals; a missing one counts as one value."""
    count = (F.approx_count_distinct if approx else F.count_distinct)("source_portal")
    return df.agg((count + F.coalesce(F.max(F.col("source_portal").isNull().cast("long")), F.lit(0))).alias("portals"))


def category_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"), F.sum("views").alias("views"), F.max("published_at").alias("last_published"))


def drilldown(df: DataFrame) -> DataFrame:
    """Totals by month, category and priority with all subtotals; level tells which were summed up."""
    return df.withColumn("month", F.date_format("published_at", "yyyy-MM")).rollup("month", "category", "priority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def sort_notices(df: DataFrame, by: str = "date") -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published_at" if by == "date" else "views"), "id")


def paginate(df: DataFrame, order: Sequence[Column], page: int, limit: int = 10) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, value_column: str, value, last_id, limit: int = 10) -> DataFrame:
    """Keyset page: what follows (value, id) in descending order; does not read the pages before."""
    c = F.col(value_column)
    after = (c < F.lit(value)) | ((c == F.lit(value)) & (F.col("id") > F.lit(last_id)))
    return df.filter(after).orderBy(c.desc(), "id").limit(limit)


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def views_rank(df: DataFrame) -> DataFrame:
    """Rank and percent rank of views within the category, null views last.

    Notices are counted by value first. Values are ranked within bands (64 for each power of two), and a band adds what all
    bands above it hold, so a category is never sorted in one place.
    """
    values = df.groupBy(F.col("category").alias("_c"), F.col("views").alias("_v")).agg(F.count("*").alias("_n"))
    band = F.floor(F.signum("_v") * F.log2(1 + F.abs(F.col("_v").cast("double"))) * 64)
    values = values.withColumn("_band", band)
    order = F.desc_nulls_last("_band")
    bands = values.groupBy("_c", "_band").agg(F.sum("_n").alias("_held"))
    above = F.coalesce(F.sum("_held").over(Window.partitionBy("_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select(F.col("_c").alias("_c2"), F.col("_band").alias("_band2"), above.alias("_above"), F.sum("_held").over(Window.partitionBy("_c")).alias("_all"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_c", "_band").orderBy(F.desc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("_inner", inner).join(bands, F.col("_c").eqNullSafe(F.col("_c2")) & F.col("_band").eqNullSafe(F.col("_band2")))
    rank = (F.col("_above") + F.col("_inner") + 1).alias("views_rank")
    percent = F.when(F.col("_all") > 1, (F.col("_above") + F.col("_inner")) / (F.col("_all") - 1)).otherwise(0.0).alias("views_percent")
    ranked = ranked.select("_c", "_v", rank, percent)
    return df.join(ranked, F.col("category").eqNullSafe(F.col("_c")) & F.col("views").eqNullSafe(F.col("_v"))).drop("_c", "_v")


def distinct_organizations(df: DataFrame) -> DataFrame:
    return df.select("organization").distinct()


def relevance_search(df: DataFrame, q: str, k: int = 10, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """Weighted field hits of every query term; best first, then newest, then id."""
    score = F.lit(0)
    for term in q.lower().split():
        for field, w in weights.items():
            if field in df.columns:
                hit = tag_hit(term) if field == "tags" else S.holds(field, term)
                score = score + F.when(hit, w).otherwise(0)
    return df.withColumn("relevance", score).filter("relevance > 0").orderBy(F.desc("relevance"), F.desc_nulls_last("published_at"), "id").limit(k)


def tag_hit(term: str) -> Column:
    return F.coalesce(F.exists("tags", lambda t: S.holds(t, term)), F.lit(False))


def term_suggestions(df: DataFrame, column: str, prefix_len: int = 3, k: int = 5) -> DataFrame:
    """Most frequent terms for each prefix."""
    terms = df.select(F.explode(F.split(F.lower(column), "[^a-z0-9]+")).alias("term")).filter(F.length("term") >= prefix_len)
    counts = terms.groupBy(F.substring("term", 1, prefix_len).alias("prefix"), "term").agg(F.count("*").alias("n"))
    return top_n_per_group(counts, "prefix", [F.desc("n"), F.col("term")], k)
