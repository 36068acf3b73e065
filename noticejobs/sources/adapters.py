"""Canonical tables derived from the driver's tables, and the same tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clocks of the derived tables.
NOTICES_AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segment_category(c: str) -> Column:
    return F.expr(f"CASE {c} WHEN 'AUTOMOBILE' THEN 'exams' WHEN 'BUILDING' THEN 'vacancies' WHEN 'FURNITURE' THEN 'tenders' WHEN 'HOUSEHOLD' THEN 'policy' ELSE 'announcements' END")


def notices(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r, l = (table(spark, d, x) for x in ("orders", "customer", "nation", "region", "lineitem"))
    last = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("deadline"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").cast("long").alias("id"), F.concat_ws(" ", "n_name", "c_mktsegment", "o_orderpriority").alias("title"), segment_category("c_mktsegment").alias("category"), F.col("n_name").alias("organization"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END").alias("priority"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'draft' ELSE 'published' END").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("deadline").cast("timestamp").alias("deadline"), F.floor("o_totalprice").cast("long").alias("views"),
        F.concat(F.lower("r_name"), F.lit(".example")).alias("source_portal"), (F.col("o_orderkey") % 10 < 7).alias("is_ocr"), F.col("o_custkey").cast("long").alias("author_id"),
    )


def activities(spark: SparkSession, d: str) -> DataFrame:
    return events_as_activities(table(spark, d, "events"))


def events_as_activities(events: DataFrame) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'alert' WHEN 'click' THEN 'search' ELSE 'document' END")
    return events.select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), kind.alias("type"), F.col("ts").cast("timestamp").alias("timestamp"), F.get_json_object("props", "$.k").cast("long").alias("related_id"), "value")


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role"), F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"))


def events_as_logs(events: DataFrame) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'view' THEN 'info' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'success' END")
    items = F.when(F.col("event_type").isin("purchase", "click"), F.floor("value").cast("long")).otherwise(0)
    return events.select(F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("source"), (F.col("user_id") % 20).cast("string")).alias("source"), status.alias("status"), items.alias("items"))


def scrape_logs(spark: SparkSession, d: str) -> DataFrame:
    return events_as_logs(table(spark, d, "events"))


def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key = F.col("c_custkey").cast("long")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("kind", key % 25).filter("kind in (1, 2, 3)")
    condition = F.when(F.col("kind") == 1, segment_category("c_mktsegment")).when(F.col("kind") == 2, F.col("n_name")).otherwise(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'nation_1' ELSE 'low' END"))
    return rows.select((key * 10 + F.col("kind")).alias("id"), key.alias("user_id"), F.expr("CASE kind WHEN 1 THEN 'category' WHEN 2 THEN 'organization' ELSE 'keyword' END").alias("type"), F.array(condition).alias("conditions"), (key % 4 != 0).alias("enabled"), F.concat(F.lit("rule "), key.cast("string")).alias("name"), F.expr("CASE WHEN c_custkey % 7 > 0 THEN timestamp'1992-01-01' + make_dt_interval(int(c_custkey * 37 % 3600)) END").alias("created_at"))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))


def rag_documents(spark: SparkSession, d: str) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("long").alias("id"), title.alias("title"), F.col("source").alias("category"), F.col("lang").alias("organization"), F.col("text").alias("content"), F.col("n_chars").cast("long").alias("size"),
        (F.col("doc_id") % 6 != 2).alias("embedded"), F.floor(F.col("n_chars") / 500).cast("long").alias("chunk_count"), F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z]+"), lambda w: w != "")).alias("tags"),
    )


def moderation_queue(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("long").alias("id"), "source", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), F.lit("pending").alias("status"), F.col("lang").alias("category"))


def scraped_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").cast("long").alias("id"), "url", "html")


CATEGORY_SQL = "CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'exams' WHEN 'BUILDING' THEN 'vacancies' WHEN 'FURNITURE' THEN 'tenders' WHEN 'HOUSEHOLD' THEN 'policy' ELSE 'announcements' END"
SQL_TABLES = {
    "notices": f"""SELECT CAST(o.o_orderkey AS BIGINT) AS id, concat(n.n_name, ' ', c.c_mktsegment, ' ', o.o_orderpriority) AS title, {CATEGORY_SQL} AS category, n.n_name AS organization,
        CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o.o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS priority, CASE o.o_orderstatus WHEN 'P' THEN 'draft' ELSE 'published' END AS status,
        CAST(o.o_orderdate AS TIMESTAMP) AS published_at, CAST(d.deadline AS TIMESTAMP) AS deadline, CAST(floor(o.o_totalprice) AS BIGINT) AS views, concat(lower(r.r_name), '.example') AS source_portal, (o.o_orderkey % 10) < 7 AS is_ocr, CAST(o.o_custkey AS BIGINT) AS author_id
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS deadline FROM lineitem GROUP BY l_orderkey) d ON d.l_orderkey = o.o_orderkey""",
    "activities": """SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'alert' WHEN 'click' THEN 'search' ELSE 'document' END AS type,
        CAST(ts AS TIMESTAMP) AS "timestamp", CAST(json_extract_string(props, '$.k') AS BIGINT) AS related_id, value FROM events""",
    "users": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS username, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status FROM customer",
    "scrape_logs": """SELECT CAST(event_id AS BIGINT) AS id, CAST(ts AS TIMESTAMP) AS "time", concat('source', user_id % 20) AS source, CASE event_type WHEN 'view' THEN 'info' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'success' END AS status,
        CASE WHEN event_type IN ('purchase','click') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS items FROM events""",
    "alert_rules": f"""SELECT CAST(c_custkey AS BIGINT) * 10 + c_custkey % 25 AS id, CAST(c_custkey AS BIGINT) AS user_id, CASE c_custkey % 25 WHEN 1 THEN 'category' WHEN 2 THEN 'organization' ELSE 'keyword' END AS type,
        CASE c_custkey % 25 WHEN 1 THEN {CATEGORY_SQL} WHEN 2 THEN n.n_name ELSE CASE c_custkey % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'nation_1' ELSE 'low' END END AS condition, c_custkey % 4 <> 0 AS enabled, concat('rule ', c_custkey) AS name, CASE WHEN c_custkey % 7 > 0 THEN TIMESTAMP '1992-01-01' + to_days(CAST(c_custkey * 37 % 3600 AS INT)) END AS created_at
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c_custkey % 25 IN (1, 2, 3)""",
    "chat_messages": "SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text AS content FROM conversations",
    "rag_documents": """SELECT CAST(doc_id AS BIGINT) AS id, split_part(text, chr(10), 1) AS title, source AS category, lang AS organization, text AS content, CAST(n_chars AS BIGINT) AS size, doc_id % 6 <> 2 AS embedded, CAST(floor(n_chars / 500.0) AS BIGINT) AS chunk_count,
        list_distinct([w for w in regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^a-z]+') if w <> '']) AS tags FROM documents""",
    "moderation_queue": "SELECT CAST(d.doc_id AS BIGINT) AS id, d.source, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic, 'pending' AS status, d.lang AS category FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "scraped_pages": "SELECT CAST(page_id AS BIGINT) AS id, url, html FROM pages",
    "matches": """SELECT r.id AS rule_id, r.user_id, n.id AS notice_id, n.published_at AS matched_at, r.condition FROM notices n JOIN alert_rules r ON r.enabled AND (r.created_at IS NULL OR n.published_at >= r.created_at) AND
        ((r.type = 'category' AND lower(r.condition) = n.category) OR (r.type = 'organization' AND lower(r.condition) = lower(n.organization)) OR (r.type = 'keyword' AND (contains(lower(n.title), lower(r.condition)) OR contains(lower(n.organization), lower(r.condition)))))""",
}
NEEDS = {"matches": ("notices", "alert_rules")}


def sql(body: str, *tables: str) -> str:
    """``body`` with the named derived tables as common table expressions."""
    order = list(dict.fromkeys(t for name in tables for t in (*NEEDS.get(name, ()), name)))
    body = body.strip()
    opening = next((x for x in ("WITH RECURSIVE ", "WITH ") if body.startswith(x)), "")
    with_more = body[len(opening) :].lstrip() if opening else None
    head = (opening or "WITH ") + ",\n".join(f"{t} AS ({SQL_TABLES[t]})" for t in order)
    return f"{head},\n{with_more}" if with_more else f"{head}\n{body}"


Builder = Callable[[SparkSession, str], DataFrame]
