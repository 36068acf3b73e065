"""Queries over notices: filters, search, facets, sorting, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticejobs.functions import scalars as S
from noticejobs.operators import notices as N
from noticejobs.plans.registry import query
from noticejobs.sources import adapters as A
from noticejobs.sources.adapters import NOTICES_AS_OF
from noticejobs.sources.schemas import CATEGORIES

CLOCK = f"TIMESTAMP '{NOTICES_AS_OF}'"
DAYS = f"CAST(ceil((epoch_ms(deadline) - epoch_ms({CLOCK})) / 86400000.0) AS BIGINT)"


def day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c if isinstance(c, str) else "t")


DAY = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("SELECT id, title FROM notices WHERE status = 'published'", "notices")
def p1_published(spark, d):
    return N.published(A.notices(spark, d)).select("id", "title")


@query("SELECT id, title FROM notices WHERE contains(lower(title), 'nation_1') OR contains(lower(organization), 'nation_1')", "notices")
def p2_search(spark, d):
    return N.search_notices(A.notices(spark, d), "Nation_1").select("id", "title")


@query("SELECT id FROM rag_documents WHERE contains(lower(title), 'thing') OR contains(lower(organization), 'thing') OR len([t for t in tags if contains(t, 'thing')]) > 0 OR contains(lower(content), 'thing') OR contains(lower(category), 'thing')", "rag_documents")
def p3_global_search(spark, d):
    return N.search_notices(A.rag_documents(spark, d), "thing", "global").select("id")


@query("SELECT id, category, priority FROM notices WHERE category = 'tenders' AND priority = 'high'", "notices")
def p4_filters(spark, d):
    return N.filter_equal(N.filter_equal(N.filter_equal(A.notices(spark, d), "category", "tenders"), "priority", "high"), "status", "all").select("id", "category", "priority")


@query(f"SELECT id FROM notices WHERE category IN ('exams', 'policy') AND published_at >= TIMESTAMP '1998-01-01' AND published_at <= TIMESTAMP '2000-12-31' AND priority IN ('high', 'low') AND is_ocr AND {DAYS} < 0", "notices")
def p5_advanced_filter(spark, d):
    return N.advanced_filter(A.notices(spark, d), categories=("exams", "policy"), date_from="1998-01-01", date_to="2000-12-31", priorities=("high", "low"), is_ocr=True, deadline="expired", as_of=NOTICES_AS_OF).select("id")


@query(f"""SELECT id, {DAYS} AS days, CASE WHEN {DAYS} < 0 THEN 'Closed' WHEN {DAYS} = 0 THEN 'Closes today' WHEN {DAYS} = 1 THEN 'Closes tomorrow' WHEN {DAYS} > 1 THEN concat({DAYS}, ' days remaining') END AS deadline_label,
    coalesce({DAYS} BETWEEN 0 AND 7, false) AS urgent FROM notices WHERE deadline IS NOT NULL""", "notices")
def p6_deadline_status(spark, d):
    return N.deadline_status(A.notices(spark, d).filter("deadline is not null"), NOTICES_AS_OF).select("id", "days", "deadline_label", "urgent")


@query(f"SELECT CASE WHEN {DAYS} >= 0 THEN 'upcoming' ELSE 'expired' END AS kind, count(*) AS n FROM notices WHERE deadline IS NOT NULL GROUP BY 1", "notices")
def p7_upcoming_expired(spark, d):
    rows = A.notices(spark, d)
    both = N.upcoming(rows, NOTICES_AS_OF).select(F.lit("upcoming").alias("kind")).unionByName(N.expired(rows, NOTICES_AS_OF).select(F.lit("expired").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT id, title FROM notices WHERE priority = 'high' ORDER BY published_at DESC NULLS LAST, id LIMIT 2", "notices")
def p8_urgent(spark, d):
    return N.urgent_notices(A.notices(spark, d)).select("id", "title")


@query("SELECT id, status FROM notices WHERE contains(lower(title), 'urgent')", "notices")
def p9_title_search(spark, d):
    return N.title_search(A.notices(spark, d), "urgent").select("id", "status")


@query(f"SELECT id, is_ocr AS badge_ocr, coalesce({DAYS} BETWEEN 0 AND 7, false) AS badge_urgent, coalesce(source_portal, 'Unknown') AS portal_label, CASE WHEN is_ocr THEN 'OCR 90%' END AS ocr_label FROM notices", "notices")
def p15_badges(spark, d):
    rows = A.notices(spark, d).withColumns({"ai_summary": F.lit(None).cast("string"), "ocr_confidence": F.lit(None).cast("int")})
    return N.notice_badges(rows, NOTICES_AS_OF).select("id", "badge_ocr", "badge_urgent", "portal_label", "ocr_label")


@query("""SELECT id, CASE category WHEN 'policy' THEN 'policy' WHEN 'announcements' THEN 'announcements' ELSE category END AS category, priority, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline FROM notices""", "notices")
def p16_normalize(spark, d):
    """The shared-package flavour (gazette, general, medium, expires_at) back to the canonical one."""
    rows = A.notices(spark, d)
    other = rows.select("id", F.when(F.col("category") == "policy", "gazette").when(F.col("category") == "announcements", "general").otherwise(F.col("category")).alias("category"), F.when(F.col("priority") == "normal", "medium").otherwise(F.col("priority")).alias("priority"), F.col("deadline").alias("expires_at"))
    return N.normalize_notices(other).select("id", "category", "priority", day("deadline"))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'draft' AND published_at <= TIMESTAMP '1998-01-01' THEN 'published' ELSE status END AS status FROM notices) GROUP BY 1", "notices")
def p17_publish_scheduled(spark, d):
    return N.publish_scheduled(A.notices(spark, d), "1998-01-01").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT coalesce(category, 'all') AS category, count(*) AS n FROM notices WHERE status = 'published' GROUP BY ROLLUP (category)", "notices")
def a1_facet_counts(spark, d):
    return N.facet_counts(A.notices(spark, d))


@query("""SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(priority) = 0 THEN 'priority' WHEN grouping(organization) = 0 THEN 'organization' ELSE 'source_portal' END AS facet,
    coalesce(category, priority, organization, source_portal) AS value, count(*) AS n FROM notices GROUP BY GROUPING SETS ((category), (priority), (organization), (source_portal))""", "notices")
def a2_facets(spark, d):
    return N.facets(A.notices(spark, d), ["category", "priority", "organization", "source_portal"])


@query("SELECT count(DISTINCT p) + max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS portals FROM (SELECT CASE WHEN id % 97 = 0 THEN NULL ELSE source_portal END AS p FROM notices)", "notices")
def a3_count_portals(spark, d):
    return N.count_portals(A.notices(spark, d).withColumn("source_portal", F.when(F.col("id") % 97 != 0, F.col("source_portal"))))


@query("SELECT count(*) AS n FROM notices WHERE status = 'published' AND (contains(lower(title), 'high') OR contains(lower(organization), 'high'))", "notices")
def a4_result_count(spark, d):
    return N.search_notices(N.published(A.notices(spark, d)), "high").agg(F.count("*").alias("n"))


@query("SELECT category, count(*) AS n, CAST(sum(views) AS BIGINT) AS views, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS last_published FROM notices GROUP BY category", "notices")
def a14_category_stats(spark, d):
    return N.category_stats(A.notices(spark, d)).select("category", "n", "views", day("last_published"))


@query("SELECT strftime(published_at, '%Y-%m') AS month, category, priority, count(*) AS n, CAST(grouping(strftime(published_at, '%Y-%m'), category, priority) AS BIGINT) AS level FROM notices GROUP BY ROLLUP (strftime(published_at, '%Y-%m'), category, priority)", "notices")
def a30_drilldown(spark, d):
    return N.drilldown(A.notices(spark, d))


@query("SELECT c.category, coalesce(n, 0) AS n FROM (VALUES ('exams'), ('vacancies'), ('tenders'), ('policy'), ('announcements'), ('results')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM notices GROUP BY 1) x ON x.category = c.category", "notices")
def j9_dense_counts(spark, d):
    return N.category_counts(A.notices(spark, d), spark.createDataFrame([(c,) for c in (*CATEGORIES, "results")], "category string"))


@query("SELECT id, category, views, rank FROM (SELECT id, category, views, CAST(row_number() OVER (PARTITION BY category ORDER BY views DESC, id) AS BIGINT) AS rank FROM notices) WHERE rank <= 5", "notices")
def w4_top_per_group(spark, d):
    return N.top_n_per_group(A.notices(spark, d), "category", [F.desc("views"), F.col("id")], 5).select("id", "category", "views", F.col("rank").cast("long"))


@query("SELECT id, category, CAST(rank() OVER (PARTITION BY category ORDER BY views DESC) AS BIGINT) AS views_rank, round(percent_rank() OVER (PARTITION BY category ORDER BY views DESC), 6) AS views_percent FROM notices", "notices")
def w12_views_rank(spark, d):
    return N.views_rank(A.notices(spark, d)).select("id", "category", F.col("views_rank").cast("long"), F.round("views_percent", 6).alias("views_percent"))


@query("SELECT id, views FROM notices ORDER BY views DESC NULLS LAST, id", "notices")
def t1_sort_by_views(spark, d):
    return N.sort_notices(A.notices(spark, d), "views").select("id", "views")


@query(f"SELECT id, {DAY.format('published_at')} FROM (SELECT * FROM notices ORDER BY published_at DESC NULLS LAST, id LIMIT 10 OFFSET 20)", "notices")
def t2_page(spark, d):
    return N.paginate(A.notices(spark, d), [F.desc_nulls_last("published_at"), F.col("id")], 3).select("id", day("published_at"))


@query("SELECT id, views FROM notices WHERE views < 200000 ORDER BY views DESC, id LIMIT 10", "notices")
def t2_keyset_page(spark, d):
    return N.page_after(A.notices(spark, d), "views", 200_000, 2**62).select("id", "views")


@query("SELECT id, title FROM notices WHERE status = 'published' ORDER BY published_at DESC, id LIMIT 5", "notices")
def t5_first_n(spark, d):
    return N.first_n(N.published(A.notices(spark, d)), [F.desc("published_at"), F.col("id")], 5).select("id", "title")


@query("""WITH s AS (SELECT id, 5 * CAST(contains(lower(title), 'the') AS INT) + 4 * CAST(len([t for t in tags if contains(t, 'the')]) > 0 AS INT) + 3 * CAST(contains(lower(organization), 'the') AS INT) + CAST(contains(lower(content), 'the') AS INT)
    + 5 * CAST(contains(lower(title), 'ing') AS INT) + 4 * CAST(len([t for t in tags if contains(t, 'ing')]) > 0 AS INT) + 3 * CAST(contains(lower(organization), 'ing') AS INT) + CAST(contains(lower(content), 'ing') AS INT) AS relevance FROM rag_documents)
    SELECT id, CAST(relevance AS BIGINT) AS relevance FROM s WHERE relevance > 0 ORDER BY relevance DESC, id LIMIT 20""", "rag_documents")
def t7_relevance(spark, d):
    rows = A.rag_documents(spark, d).withColumn("published_at", F.lit(NOTICES_AS_OF).cast("timestamp"))
    return N.relevance_search(rows, "The ing", 20).select("id", F.col("relevance").cast("long"))


@query("SELECT DISTINCT organization FROM notices", "notices")
def u4_organizations(spark, d):
    return N.distinct_organizations(A.notices(spark, d))


@query("""WITH t AS (SELECT unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM rag_documents), c AS (SELECT substr(term, 1, 3) AS prefix, term, count(*) AS n FROM t WHERE length(term) >= 3 GROUP BY 1, 2)
    SELECT prefix, term, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, term) AS k FROM c) WHERE k <= 5""", "rag_documents")
def a28_term_suggestions(spark, d):
    return N.term_suggestions(A.rag_documents(spark, d), "content").select("prefix", "term", "n")


@query("""SELECT id, regexp_replace(regexp_replace(lower(title), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g') AS slug, CASE WHEN length(title) <= 20 THEN title ELSE concat(substr(title, 1, 19), '…') END AS short, concat(upper(substr(title, 1, 1)), substr(title, 2)) AS capital,
    concat(strftime(published_at, '%b '), day(published_at), strftime(published_at, ', %Y')) AS date_text FROM notices""", "notices")
def f1_f5_text_functions(spark, d):
    return A.notices(spark, d).select("id", S.slugify("title").alias("slug"), S.truncate("title", 20).alias("short"), S.capitalize("title").alias("capital"), S.format_date("published_at").alias("date_text"))


@query(f"""WITH m AS (SELECT id, published_at, CAST(floor((epoch_ms({CLOCK}) - epoch_ms(published_at)) / 60000.0) AS BIGINT) AS m FROM notices)
    SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(m // 60, 'h ago') WHEN m < 10080 THEN concat(m // 1440, 'd ago') ELSE concat(strftime(published_at, '%b '), day(published_at), strftime(published_at, ', %Y')) END AS said FROM m""", "notices")
def f4_relative_time(spark, d):
    return A.notices(spark, d).select("id", S.relative_time("published_at", NOTICES_AS_OF).alias("said"))


@query("SELECT id, replace(lower(content), 'the', '<mark>the</mark>') AS marked, substr(content, greatest(1, instr(lower(content), 'ing') - 40), 80) AS cut FROM rag_documents", "rag_documents")
def f17_f18_highlight_excerpt(spark, d):
    return A.rag_documents(spark, d).select("id", S.highlight(F.lower("content"), "the").alias("marked"), S.excerpt("content", "ing").alias("cut"))
