"""Queries over pages, feeds, versions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticejobs.functions import scalars as S
from noticejobs.operators import ingest as I
from noticejobs.plans.registry import query
from noticejobs.sources import adapters as A
from noticejobs.sources import files
from noticejobs.sources.keyed import KeyedTable
from noticejobs.sources.shared import shared_folder

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


def day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"SELECT id, url AS source_url, {HOST} AS source_portal FROM scraped_pages", "scraped_pages")
def f8_source_portal(spark, d):
    return A.scraped_pages(spark, d).select("id", F.col("url").alias("source_url"), S.source_portal("url").alias("source_portal"))


@query(r"""SELECT id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)) AS title, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?is)<title[^>]*>.*?</title\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body_chars FROM scraped_pages""", "scraped_pages")
def s4_extract_pages(spark, d):
    return files.extract_notice_fields(A.scraped_pages(spark, d)).select("id", "title", F.length("body").cast("long").alias("body_chars"))


@query(f"""WITH p AS (SELECT id, url AS source_url, id AS scraped_at FROM scraped_pages), b AS (SELECT id + 1000000 AS id, source_url, id + 10 AS scraped_at FROM p WHERE id % 3 = 0), u AS (SELECT * FROM p UNION ALL SELECT * FROM b)
    SELECT id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY scraped_at DESC, id DESC) AS k FROM u) WHERE k = 1""", "scraped_pages")
def u2_upsert_scraped(spark, d):
    p = A.scraped_pages(spark, d).select("id", F.col("url").alias("source_url"), F.col("id").alias("scraped_at"))
    again = p.filter("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), "source_url", (F.col("scraped_at") + 10).alias("scraped_at"))
    return I.upsert_scraped(p, again).select("id", "source_url")


@query("""WITH p AS (SELECT id, coalesce(url, CAST(id AS VARCHAR)) AS source_url, id AS scraped_at FROM scraped_pages), u AS (SELECT * FROM p WHERE id % 4 > 0 UNION ALL SELECT id + 1000000, source_url, scraped_at + 10 FROM p WHERE id % 3 = 0 UNION ALL SELECT id + 2000000, source_url, scraped_at - 10 FROM p WHERE id % 5 = 0)
    SELECT id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY scraped_at DESC, id DESC) AS k FROM u) WHERE k = 1""", "scraped_pages")
def u2_stored_upsert(spark, d):
    """The same into a stored table: two arrivals of scrapes, one with older rows, go to the partitions they touch."""
    p = A.scraped_pages(spark, d).select("id", F.coalesce("url", F.col("id").cast("string")).alias("source_url"), F.col("id").alias("scraped_at"))
    path = shared_folder(spark)
    table = KeyedTable.create(p.filter("id % 4 > 0"), f"pages_{path.rpartition('/')[2]}", "source_url", ("scraped_at", "id"), path)
    for n, change, late in ((3, 1_000_000, 10), (5, 2_000_000, -10)):
        table.upsert(p.filter(F.col("id") % n == 0).select((F.col("id") + change).alias("id"), "source_url", (F.col("scraped_at") + late).alias("scraped_at")))
    return table.rows().select("id", "source_url")


@query("SELECT id, url FROM scraped_pages WHERE url NOT IN (SELECT url FROM scraped_pages WHERE id % 2 = 0)", "scraped_pages")
def u3_new_since(spark, d):
    p = A.scraped_pages(spark, d).select("id", "url")
    return I.new_since(p.filter("id % 2 = 0"), p, "url").select("id", "url")


@query("SELECT source_portal, count(*) AS n, count(views) AS with_views FROM (SELECT source_portal, views FROM notices WHERE is_ocr UNION ALL SELECT source_portal, NULL FROM notices WHERE NOT is_ocr) GROUP BY 1", "notices")
def u1_unified_feed(spark, d):
    n = A.notices(spark, d)
    return I.unified_feed(n.filter("is_ocr"), n.filter("not is_ocr").drop("views")).groupBy("source_portal").agg(F.count("*").alias("n"), F.count("views").alias("with_views"))


@query(f"WITH s AS (SELECT {HOST} AS host, min(url) AS url FROM scraped_pages GROUP BY 1) SELECT {HOST} AS source_name, count(*) AS n FROM scraped_pages GROUP BY 1", "scraped_pages")
def j15_source_category(spark, d):
    p = A.scraped_pages(spark, d)
    sources = p.groupBy(S.source_portal("url").alias("name")).agg(F.min("url").alias("url"), F.lit("policy").alias("category"))
    return I.map_source_category(p.withColumnRenamed("url", "source_url"), sources).groupBy("source_name").agg(F.count("*").alias("n"))


@query("""SELECT id, array_to_string([x for x in [CASE WHEN trim(title) = '' THEN 'missing title' END, CASE WHEN id % 5 = 0 THEN 'missing description' END, CASE WHEN category NOT IN ('src1', 'src2') THEN 'unknown category' END,
    CASE WHEN id % 7 = 0 THEN 'unknown priority' END, CASE WHEN id % 11 = 0 THEN 'unknown status' END] if x IS NOT NULL], ';') AS reasons FROM rag_documents WHERE trim(title) = '' OR id % 5 = 0 OR category NOT IN ('src1', 'src2') OR id % 7 = 0 OR id % 11 = 0""", "rag_documents")
def s3_validate_import(spark, d):
    given = lambda n, bad, good: F.when(F.col("id") % n == 0, bad).when(F.col("id") % n > 1, good)
    rows = A.rag_documents(spark, d).withColumns({"description": F.when(F.col("id") % 5 != 0, "given"), "priority": given(7, "medium", "low"), "status": given(11, "deleted", "draft")})
    return files.validate_import(rows, categories=("src1", "src2"))[1].select("id", F.array_join("reasons", ";").alias("reasons"))


ROUND_TRIP = "SELECT id, title, category, views, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM notices"


def round_trip(spark, d, fmt):
    rows = A.notices(spark, d)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    path = shared_folder(spark)
    files.export_table(rows, path, fmt)
    return files.read_notices(spark, path, fmt, schema).select("id", "title", "category", "views", day("published_at"))


@query(ROUND_TRIP, "notices")
def s1_s2_json_round_trip(spark, d):
    return round_trip(spark, d, "json")


@query(ROUND_TRIP, "notices")
def s1_s2_csv_round_trip(spark, d):
    return round_trip(spark, d, "csv")


@query(ROUND_TRIP, "notices")
def s7_backup_restore(spark, d):
    path = shared_folder(spark)
    files.backup({"notices": A.notices(spark, d)}, path)
    return files.restore(spark, path, ["notices"])["notices"].select("id", "title", "category", "views", day("published_at"))


VERSIONS = "SELECT id, user_id, type, related_id, \"timestamp\" + to_microseconds(id) AS ts FROM activities"


def versions(spark, d):
    return A.activities(spark, d).withColumn("ts", F.timestamp_micros(F.unix_micros("timestamp") + F.col("id")))


@query(f"SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS k FROM ({VERSIONS})) WHERE k = 1", "activities")
def w1_latest_version(spark, d):
    return I.latest_version(versions(spark, d), "user_id", "ts", "id").select("user_id", "id")


@query(f"""SELECT id, CAST(row_number() OVER w AS BIGINT) AS version, coalesce(lead(id) OVER w, -1) AS next_id, CASE WHEN row_number() OVER w = 1 THEN '' ELSE concat_ws(',', CASE WHEN type IS DISTINCT FROM lag(type) OVER w THEN 'type' END, CASE WHEN related_id IS DISTINCT FROM lag(related_id) OVER w THEN 'related_id' END) END AS changed
    FROM ({VERSIONS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)""", "activities")
def w3_edit_history(spark, d):
    from pyspark.sql import Window

    out = I.edit_history(versions(spark, d), "user_id", "ts", ("type", "related_id"))
    return out.withColumn("next_id", F.lead("id").over(Window.partitionBy("user_id").orderBy("ts"))).select("id", F.col("version").cast("long"), F.coalesce("next_id", F.lit(-1)).alias("next_id"), F.array_join("changed", ",").alias("changed"))


@query(f"SELECT user_id, arg_max(id, ts) AS id FROM ({VERSIONS}) WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1", "activities")
def j17_as_of(spark, d):
    v = versions(spark, d)
    wanted = v.select("user_id").distinct().withColumn("t", F.lit("2024-01-15").cast("timestamp"))
    return I.notice_as_of(I.edit_history(v, "user_id", "ts", ("type",)), wanted, "user_id").select("user_id", "id")


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN concat(title, '!') ELSE title END AS title, CASE WHEN id % 3 = 0 THEN NOT is_ocr ELSE is_ocr END AS enabled FROM notices WHERE id % 5 <> 0""", "notices")
def w2_apply_changes(spark, d):
    base = A.notices(spark, d).select("id", "title", F.col("is_ocr").alias("enabled"))
    none = lambda t: F.lit(None).cast(t)
    patch = base.filter("id % 7 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), none("boolean").alias("enabled"), F.lit("patch").alias("op"), F.lit(1).alias("seq"))
    toggle = base.filter("id % 3 = 0").select("id", none("string").alias("title"), none("boolean").alias("enabled"), F.lit("toggle").alias("op"), F.lit(2).alias("seq"))
    delete = base.filter("id % 5 = 0").select("id", none("string").alias("title"), none("boolean").alias("enabled"), F.lit("delete").alias("op"), F.lit(3).alias("seq"))
    return I.apply_changes(base, patch.unionByName(toggle).unionByName(delete))


@query("SELECT id, CASE WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE status END AS status, category FROM moderation_queue", "moderation_queue")
def j13_apply_decisions(spark, d):
    q = A.moderation_queue(spark, d)
    decisions = q.filter("quality is not null").select("id", F.when(F.col("quality") == 0, "rejected").otherwise("approved").alias("status"), F.lit(None).cast("string").alias("category"))
    return I.apply_decisions(q, decisions).select("id", "status", "category")


@query("SELECT id, CASE category WHEN 'exams' THEN 'policy' WHEN 'tenders' THEN 'vacancies' ELSE category END AS category FROM notices", "notices")
def j14_reassign_category(spark, d):
    mapping = spark.createDataFrame([("exams", "policy"), ("tenders", "vacancies")], "old string, new string")
    return I.reassign_category(A.notices(spark, d), mapping).select("id", "category")


@query("SELECT n.id, coalesce(CAST(a.l_linenumber AS BIGINT), -1) AS attachment_id, 'file' || a.l_partkey || '.pdf' AS filename FROM notices n LEFT JOIN lineitem a ON a.l_orderkey = n.id AND a.l_quantity > 45", "notices")
def j18_notice_documents(spark, d):
    l = A.table(spark, d, "lineitem").filter("l_quantity > 45")
    attachments = l.select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").cast("long").alias("id"), F.concat(F.lit("file"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("filename"), F.col("l_extendedprice").alias("size_bytes"))
    return I.notice_documents(A.notices(spark, d), attachments).select("id", F.coalesce("attachment_id", F.lit(-1)).alias("attachment_id"), "filename")


@query("""WITH a AS (SELECT id, role, status FROM users WHERE id % 10 <> 1), b AS (SELECT id, role, CASE WHEN id % 4 = 0 THEN 'inactive' ELSE status END AS status FROM users WHERE id % 10 <> 2)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' WHEN a.status <> b.status THEN 'changed' ELSE 'same' END AS state, CASE WHEN a.status <> b.status THEN 'status' ELSE '' END AS changed FROM a FULL JOIN b ON a.id = b.id""", "users")
def j19_reconcile(spark, d):
    u = A.users(spark, d)
    b = u.filter("id % 10 <> 2").withColumn("status", F.when(F.col("id") % 4 == 0, "inactive").otherwise(F.col("status")))
    return I.reconcile(u.filter("id % 10 <> 1"), b, "id", ("role", "status"))


@query("SELECT id, CASE category WHEN 'exams' THEN 'Examens' WHEN 'policy' THEN 'Politique' ELSE category END AS label FROM notices", "notices")
def j10_localize(spark, d):
    words = spark.createDataFrame([("fr", "exams", "Examens"), ("fr", "policy", "Politique"), ("fr", "tenders", ""), ("de", "vacancies", "Stellen")], "lang string, key string, value string")
    return I.localize(A.notices(spark, d), "category", "fr", words).select("id", "label")
