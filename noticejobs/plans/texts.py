"""Queries that apply the text functions to columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticejobs.functions import scalars as S
from noticejobs.plans.registry import query
from noticejobs.sources import adapters as A
from noticejobs.sources.adapters import NOTICES_AS_OF

CLOCK = f"TIMESTAMP '{NOTICES_AS_OF}'"
DAYS = f"CAST(ceil((epoch_ms(deadline) - epoch_ms({CLOCK})) / 86400000.0) AS BIGINT)"


@query("SELECT id, concat(organization, '|', category, '||', priority) AS conditions, concat(organization, ', ', category, ', , +1 more') AS preview FROM notices", "notices")
def f6_f7_conditions(spark, d):
    text = F.concat(F.lit(" "), "organization", F.lit(" ,\t"), "category", F.lit(",,"), "priority", F.lit("\n"))
    rows = A.notices(spark, d).select("id", S.parse_conditions(text).alias("c"))
    return rows.select("id", F.array_join("c", "|").alias("conditions"), S.condition_preview("c").alias("preview"))


@query("SELECT id, CAST(round((views % 1000) / 10.0 * 1048576) AS BIGINT) AS bytes, (views % 100) / 10.0 AS seconds, id % 3 + 1 AS attempt, 3 AS max_attempts, CASE id % 3 WHEN 0 THEN 24 WHEN 1 THEN views % 20 + 2 ELSE 168 END AS hours FROM notices", "notices")
def f9_f12_parsed_texts(spark, d):
    tenths = lambda m: (F.col("views") % m / 10).cast("decimal(10,1)").cast("string")
    retry = S.parse_retry(F.concat(F.lit("Timeout (retry "), (F.col("id") % 3 + 1).cast("string"), F.lit("/3)")))
    frequency = F.when(F.col("id") % 3 == 0, "Daily").when(F.col("id") % 3 == 1, F.concat(F.lit("Every "), (F.col("views") % 20 + 2).cast("string"), F.lit(" hours"))).otherwise("Weekly")
    return A.notices(spark, d).select(
        "id", S.parse_size(F.concat(tenths(1000), F.lit(" MB"))).alias("bytes"), S.parse_duration(F.concat(tenths(100), F.lit("s"))).alias("seconds"),
        retry["attempt"].cast("long").alias("attempt"), retry["max_attempts"].alias("max_attempts"), S.frequency_hours(frequency).cast("long").alias("hours"),
    )


@query("SELECT id, url LIKE '%://_%' AS good, false AS bad FROM scraped_pages", "scraped_pages")
def f14_valid_url(spark, d):
    return A.scraped_pages(spark, d).select("id", S.valid_url("url").alias("good"), S.valid_url(F.concat(F.lit("no url "), F.col("id").cast("string"))).alias("bad"))


@query(f"""SELECT id, 'Open to ' || organization || ' — Qualification ' || category AS lead, CASE WHEN contains('is the fee high?', 'fee') THEN 'Fee ' || priority END AS fact FROM notices""", "notices")
def f15_f16_facts(spark, d):
    return with_facts(spark, d).select("id", S.lead_facts("key_facts").alias("lead"), S.first_matching_fact(F.slice("key_facts", 2, 2), F.lit("Is the FEE high?")).alias("fact"))


def with_facts(spark, d):
    fact = lambda prefix, c: F.concat(F.lit(prefix), c)
    return A.notices(spark, d).withColumns({"key_facts": F.array(fact("Open to ", "organization"), fact("Qualification ", "category"), fact("Fee ", "priority")), "source_url": F.lit(None).cast("string"), "ai_summary": F.lit(None).cast("string"), "description": F.lit("See below")})


@query(f"""SELECT id, CASE id % 5 WHEN 0 THEN CASE WHEN deadline IS NULL THEN 'No deadline is given.' ELSE 'Deadline: ' || strftime(deadline, '%b ') || day(deadline) || strftime(deadline, ', %Y') || '; ' || CASE WHEN {DAYS} > 0 THEN {DAYS} || ' days left' ELSE 'already passed' END || '.' END
    WHEN 1 THEN 'Eligibility: Qualification ' || category || '.' WHEN 2 THEN 'Apply to ' || organization || ' at ' || source_portal || '. Open to ' || organization || ' — Qualification ' || category WHEN 3 THEN 'Contact: ' || source_portal || '.' ELSE organization || ': ' || title || '. See below' END AS answer FROM notices""", "notices")
def f20_answers(spark, d):
    questions = F.array(*map(F.lit, ("When is the last date?", "Who is eligible?", "What is the process?", "Which phone number?", "???")))
    rows = with_facts(spark, d).withColumn("q", F.get(questions, (F.col("id") % 5).cast("int")))
    return rows.select("id", S.answer_notice_question(F.col("q"), NOTICES_AS_OF).alias("answer"))


@query("SELECT id, CASE type WHEN 'view' THEN 'Viewed' WHEN 'save' THEN 'Saved' WHEN 'alert' THEN 'Alerted' ELSE 'Other' END AS label FROM activities", "activities")
def f21_activity_label(spark, d):
    return A.activities(spark, d).select("id", S.label("type", {"view": "Viewed", "save": "Saved", "alert": "Alerted"}, "Other").alias("label"))


@query("SELECT id, concat(organization, '.v', id) AS title, category AS term FROM notices", "notices")
def f22_f23_quoted_term_and_file_title(spark, d):
    name = F.concat("organization", F.lit(".v"), F.col("id").cast("string"), F.lit(".pdf"))
    return A.notices(spark, d).select("id", S.title_from_filename(name).alias("title"), S.search_term(F.concat(F.lit("Searched for '"), "category", F.lit("'"))).alias("term"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE title END AS question, 'host=' || organization || ';port=9' AS fields FROM notices", "notices")
def f24_f25_nested_field_and_body(spark, d):
    body = F.when(F.col("id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("title").alias("question"))))
    fields = F.array(F.struct(F.lit("host").alias("key"), F.col("organization").alias("value")), F.struct(F.lit("port").alias("key"), F.lit("1").alias("value")))
    shown = F.array_join(F.transform(S.update_nested_field(fields, "port", "9"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return A.notices(spark, d).select("id", S.parse_body(body).alias("question"), shown.alias("fields"))
