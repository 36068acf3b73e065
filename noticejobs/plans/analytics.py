"""Queries over activities, users and scraping logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticejobs.operators import activity as Y
from noticejobs.operators import admin as M
from noticejobs.operators import recommend as R
from noticejobs.plans.registry import query
from noticejobs.sources import adapters as A
from noticejobs.sources.adapters import EVENTS_AS_OF

CLOCK = f"TIMESTAMP '{EVENTS_AS_OF}'"
SAVED = "SELECT user_id, related_id AS notice_id FROM activities WHERE type = 'save' GROUP BY 1, 2 HAVING count(*) % 2 = 1"
MONTH = f"\"timestamp\" >= date_trunc('month', {CLOCK}) AND \"timestamp\" <= {CLOCK}"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"SELECT * FROM ({SAVED})", "activities")
def a15_current_saved(spark, d):
    return Y.current_saved(A.activities(spark, d))


@query("SELECT user_id, related_id AS notice_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, related_id ORDER BY \"timestamp\" DESC, id DESC) AS k FROM activities WHERE type IN ('save', 'view')) WHERE k = 1 AND type = 'save'", "activities")
def a15_last_event_wins(spark, d):
    return Y.last_state_saved(A.activities(spark, d).filter("type in ('save', 'view')"))


@query(f"SELECT n.id, n.title FROM notices n JOIN ({SAVED}) s ON s.notice_id = n.id AND s.user_id = (SELECT min(user_id) FROM activities)", "notices", "activities")
def j6_saved_notices(spark, d):
    acts = A.activities(spark, d)
    return Y.saved_notices(A.notices(spark, d), acts, acts.agg(F.min("user_id")).first()[0]).select("id", "title")


@query(f"""WITH s AS (SELECT DISTINCT user_id, related_id FROM activities WHERE type IN ('view', 'save')), c AS (SELECT DISTINCT x.user_id, n.category FROM ({SAVED}) x JOIN notices n ON n.id = x.notice_id WHERE x.user_id % 20 = 0)
    SELECT c.user_id, count(*) AS unseen, CAST(sum(n.id) AS BIGINT) AS ids FROM c JOIN notices n ON n.category = c.category WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c.user_id AND s.related_id = n.id) GROUP BY 1""", "activities", "notices")
def j7_unseen_notices(spark, d):
    """Candidates of every twentieth user: all notices of the categories that they saved in."""
    acts, notices = A.activities(spark, d), A.notices(spark, d).select(F.col("id").alias("notice_id"), "category")
    liked = Y.current_saved(acts).filter("user_id % 20 = 0").join(notices, "notice_id").select("user_id", "category").distinct()
    return Y.unseen_totals(liked, notices, acts)


@query("""WITH s AS (SELECT DISTINCT a.user_id, a.related_id, n.category FROM activities a JOIN notices n ON n.id = a.related_id WHERE a.type IN ('view', 'save')), t AS (SELECT category, count(*) AS total FROM notices GROUP BY 1)
    SELECT u.user_id, t.category, t.total - (SELECT count(*) FROM s WHERE s.user_id = u.user_id AND s.category = t.category) AS unseen FROM (SELECT DISTINCT user_id FROM activities) u, t""", "activities", "notices")
def j7_unseen_counts(spark, d):
    return Y.unseen_counts(A.notices(spark, d), A.activities(spark, d))


@query("""SELECT a.id, a.type, coalesce(n.title, r.name, t.title) AS target FROM activities a LEFT JOIN notices n ON a.type IN ('view', 'save') AND n.id = a.related_id
    LEFT JOIN alert_rules r ON a.type = 'alert' AND r.id = a.related_id LEFT JOIN rag_documents t ON a.type = 'document' AND t.id = a.related_id""", "activities", "notices", "alert_rules", "rag_documents")
def j8_activity_targets(spark, d):
    return Y.activity_with_target(A.activities(spark, d), A.notices(spark, d), A.alert_rules(spark, d), A.rag_documents(spark, d)).select("id", "type", "target")


@query(f"""SELECT u.id AS user_id, coalesce(a.viewed_month, 0) AS viewed_month, coalesce(a.alerts, 0) AS alerts, coalesce(s.saved, 0) AS saved, coalesce(r.active_alerts, 0) AS active_alerts FROM users u
    LEFT JOIN (SELECT user_id, count(*) FILTER (type = 'view' AND {MONTH}) AS viewed_month, count(*) FILTER (type = 'alert') AS alerts FROM activities GROUP BY 1) a ON a.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS saved FROM ({SAVED}) GROUP BY 1) s ON s.user_id = u.id LEFT JOIN (SELECT user_id, count(*) FILTER (enabled) AS active_alerts FROM alert_rules GROUP BY 1) r ON r.user_id = u.id""", "users", "activities", "alert_rules")
def a11_user_stats(spark, d):
    return Y.user_stats(A.users(spark, d), A.activities(spark, d), A.alert_rules(spark, d), EVENTS_AS_OF)


@query(f"""SELECT u.id AS user_id, CAST(date_diff('day', DATE '2020-01-01' + CAST(u.id % 1000 AS INT), DATE '{EVENTS_AS_OF[:10]}') AS BIGINT) AS account_days, coalesce(m.n, 0) AS total_matches FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT rule_id, user_id, notice_id FROM matches) GROUP BY 1) m ON m.user_id = u.id""", "users", "matches")
def a11_account_and_matches(spark, d):
    from noticejobs.operators.alerts import counts_of_groups
    from noticejobs.plans.alerting import groups

    users = A.users(spark, d).withColumn("created_at", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1000).cast("int")))
    rules = A.alert_rules(spark, d)
    return Y.user_stats(users, A.activities(spark, d), rules, EVENTS_AS_OF, counts_of_groups(*groups(spark, d), rules)).select("user_id", "account_days", "total_matches")


@query("SELECT u.id AS user_id, count(*) FILTER (a.\"timestamp\" > TIMESTAMP '2024-01-15') AS unread FROM users u LEFT JOIN activities a ON a.user_id = u.id AND a.type = 'alert' GROUP BY 1", "users", "activities")
def a11_unread_alerts(spark, d):
    return Y.unread_alerts(A.users(spark, d).withColumn("last_login", F.lit("2024-01-15").cast("timestamp")), A.activities(spark, d))


@query(f"SELECT user_id, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'document') AS documents, count(*) FILTER (type = 'alert') AS alerts FROM activities WHERE {MONTH} GROUP BY 1", "activities")
def a12_engagement_month(spark, d):
    return Y.engagement_month(A.activities(spark, d), EVENTS_AS_OF)


@query("""WITH c AS (SELECT date_trunc('week', "timestamp") AS period, count(*) AS n FROM activities GROUP BY 1), p AS (SELECT *, coalesce(lag(n) OVER (ORDER BY period), 0) AS previous FROM c)
    SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, n, CAST(previous AS BIGINT) AS previous, CAST(n - previous AS BIGINT) AS delta, CASE WHEN n > previous THEN 'up' WHEN n < previous THEN 'down' ELSE 'flat' END AS direction FROM p""", "activities")
def a13_period_trend(spark, d):
    return Y.period_trend(A.activities(spark, d), "timestamp", "week").select(stamp("period"), "n", "previous", "delta", "direction")


@query(f"SELECT related_id AS notice_id, count(*) AS views FROM activities WHERE type = 'view' AND \"timestamp\" > {CLOCK} - INTERVAL 7 DAY AND \"timestamp\" <= {CLOCK} GROUP BY 1 ORDER BY views DESC, notice_id LIMIT 10", "activities")
def a22_trending(spark, d):
    return Y.popular_notices(A.activities(spark, d), 10, EVENTS_AS_OF, 7)


@query("SELECT related_id AS notice_id, count(*) AS views FROM activities WHERE type = 'view' GROUP BY 1 ORDER BY views DESC, notice_id LIMIT 10", "activities")
def a22_popular(spark, d):
    return Y.popular_notices(A.activities(spark, d), 10)


@query("SELECT concat('topic ', related_id) AS term, count(*) AS n, count(DISTINCT user_id) AS users FROM activities WHERE type = 'search' GROUP BY 1", "activities")
def a23_search_analytics(spark, d):
    acts = A.activities(spark, d).withColumn("description", F.concat(F.lit("Searched for 'Topic "), F.col("related_id").cast("string"), F.lit("'")))
    return Y.search_analytics(acts)


@query("""WITH f AS (SELECT user_id, min("timestamp") FILTER (type = 'view') AS v, min("timestamp") FILTER (type = 'save') AS s, min("timestamp") FILTER (type = 'alert') AS a FROM activities GROUP BY 1),
    c AS (SELECT count(v) AS viewed, count(*) FILTER (s > v) AS saved, count(*) FILTER (s > v AND a > s) AS alerted FROM f)
    SELECT viewed, saved, alerted, round(CASE WHEN viewed > 0 THEN saved / viewed ELSE 0.0 END, 6) AS save_rate, round(CASE WHEN saved > 0 THEN alerted / saved ELSE 0.0 END, 6) AS alert_rate FROM c""", "activities")
def a24_conversion_funnel(spark, d):
    return Y.conversion_funnel(A.activities(spark, d))


@query("SELECT message_id_count AS rated, up_rate FROM (SELECT count(*) AS message_id_count, round(avg(CASE WHEN rating = 'up' THEN 1.0 ELSE 0.0 END), 6) AS up_rate FROM (SELECT related_id, CASE WHEN arg_max(type, (\"timestamp\", id)) IN ('view', 'save') THEN 'up' ELSE 'down' END AS rating FROM activities GROUP BY 1))", "activities")
def a25_answer_quality(spark, d):
    from noticejobs.operators.chat import answer_quality

    ratings = A.activities(spark, d).select(F.col("related_id").alias("message_id"), F.when(F.col("type").isin("view", "save"), "up").otherwise("down").alias("rating"), F.struct("timestamp", "id").alias("ts"))
    return answer_quality(ratings)


@query("SELECT strftime(date_trunc('day', \"timestamp\"), '%Y-%m-%d %H:%M:%S') AS day, count(DISTINCT user_id) AS users FROM activities GROUP BY 1", "activities")
def a29_users_by_day(spark, d):
    return Y.distinct_users_by_day(A.activities(spark, d)).select(stamp("day"), "users")


PERIODS = " UNION ALL ".join(f"SELECT '{p}' AS kind, date_trunc('{p}', \"timestamp\") AS period, count(DISTINCT user_id) AS users FROM activities GROUP BY 1, 2" for p in ("day", "week", "month"))


@query(f"SELECT kind, strftime(period, '%Y-%m-%d %H:%M:%S') AS period, users, true AS within FROM ({PERIODS})", "activities")
def a29_user_sketches(spark, d):
    """Users of days, weeks and months by unions of one HLL sketch a day, beside exact counts: within 5 % of them."""
    acts = A.activities(spark, d)
    sketches = Y.user_sketches(acts)
    rows = []
    for period in ("day", "week", "month"):
        exact = acts.groupBy(F.date_trunc(period, "timestamp").alias("period")).agg(F.count_distinct("user_id").alias("users"))
        near = Y.distinct_users(sketches, period).withColumnRenamed("users", "estimate")
        rows.append(exact.join(near, "period").select(F.lit(period).alias("kind"), stamp("period"), "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users")).alias("within")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH v AS (SELECT DISTINCT n.source_portal AS p, a.user_id FROM activities a JOIN notices n ON n.id = a.related_id WHERE a.type = 'view'), x AS (SELECT DISTINCT p FROM v)
    SELECT x.p AS a, y.p AS b, (SELECT count(*) FROM v JOIN v w ON w.user_id = v.user_id WHERE v.p = x.p AND w.p = y.p) AS users, true AS within FROM x JOIN x y ON x.p < y.p""", "activities", "notices")
def a3_shared_users(spark, d):
    """Users that two portals have in common, by theta sketches, beside exact counts: within 5 % of the users of either."""
    acts, notices = A.activities(spark, d), A.notices(spark, d)
    near = Y.shared_users(Y.portal_users(acts, notices)).withColumnRenamed("users", "estimate")
    seen = acts.filter("type = 'view'").join(notices.select(F.col("id").alias("related_id"), "source_portal"), "related_id").select("source_portal", "user_id").distinct()
    both = seen.select("user_id", F.col("source_portal").alias("a")).join(seen.select("user_id", F.col("source_portal").alias("b")), "user_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("users"))
    return near.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("users", F.lit(0)).alias("users"), (F.abs(F.col("estimate") - F.coalesce("users", F.lit(0))) <= 5 + 0.05 * F.coalesce("users", F.lit(0))).alias("within"))


@query("SELECT user_id, id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY \"timestamp\" DESC, id DESC) AS rank FROM activities) WHERE rank <= 6", "activities")
def w8_recent_activity(spark, d):
    return Y.recent_activity(A.activities(spark, d)).select("user_id", "id", F.col("rank").cast("long"))


@query("""WITH l AS (SELECT user_id, related_id AS term, max("timestamp") AS last FROM activities WHERE type = 'search' GROUP BY 1, 2)
    SELECT user_id, term, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, term) AS rank FROM l) WHERE rank <= 3""", "activities")
def w8_recent_searches(spark, d):
    return Y.recent_searches(A.activities(spark, d), 3).select("user_id", "term", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT related_id AS notice_id, CAST(date_diff('day', DATE '1970-01-01', CAST("timestamp" AS DATE)) AS BIGINT) AS day, count(*) AS n FROM activities WHERE type = 'view' GROUP BY 1, 2)
    SELECT notice_id, day, n, CAST(sum(n) OVER (PARTITION BY notice_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM c""", "activities")
def w13_moving_activity(spark, d):
    return Y.moving_activity(A.activities(spark, d)).select("notice_id", F.col("day").cast("long"), "n", "moving")


@query(f"""WITH s AS ({SAVED}), m AS (SELECT DISTINCT user_id, notice_id FROM matches) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM s INTERSECT SELECT * FROM m) UNION ALL SELECT 'saved only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM m)""", "matches", "activities")
def u5_saved_and_alerted(spark, d):
    from noticejobs.operators.alerts import matches_among
    from noticejobs.plans.alerting import groups

    saved = Y.current_saved(A.activities(spark, d))
    hit, miss = Y.saved_and_alerted(saved, matches_among(*groups(spark, d), saved))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(hit, "both").unionByName(count(miss, "saved only"))


@query(f"SELECT s.user_id, n.id, n.priority FROM ({SAVED}) s JOIN notices n ON n.id = s.notice_id ORDER BY CASE n.priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, n.id, s.user_id", "notices", "activities")
def t4_sort_saved(spark, d):
    saved = Y.current_saved(A.activities(spark, d)).join(A.notices(spark, d).select("id", "priority"), F.col("notice_id") == F.col("id"))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    return saved.orderBy(rank, "id", "user_id").select("user_id", "id", "priority")


@query(f"""WITH seen AS (SELECT DISTINCT user_id, related_id AS notice_id FROM activities WHERE type IN ('view', 'save')), v AS (SELECT a.user_id, n.category, count(*) AS views_in FROM activities a JOIN notices n ON n.id = a.related_id WHERE a.type = 'view' GROUP BY 1, 2),
    s AS (SELECT x.user_id, n.category, count(*) AS saves_in FROM ({SAVED}) x JOIN notices n ON n.id = x.notice_id GROUP BY 1, 2), t AS (SELECT coalesce(v.user_id, s.user_id) AS user_id, coalesce(v.category, s.category) AS category, coalesce(views_in, 0) AS views_in, coalesce(saves_in, 0) AS saves_in FROM v FULL JOIN s ON v.user_id = s.user_id AND v.category = s.category),
    published AS (SELECT * FROM notices WHERE status = 'published'),
    hot AS (SELECT related_id, count(*) AS views FROM activities WHERE type = 'view' AND "timestamp" > {CLOCK} - INTERVAL 7 DAY AND "timestamp" <= {CLOCK} GROUP BY 1),
    trend AS (SELECT related_id FROM (SELECT h.related_id, row_number() OVER (PARTITION BY n.category ORDER BY h.views DESC, h.related_id) AS k FROM hot h JOIN notices n ON n.id = h.related_id) WHERE k <= 10), ruled AS (SELECT DISTINCT user_id, condition AS category FROM alert_rules WHERE enabled AND type = 'category'),
    wide AS (SELECT user_id, category FROM t UNION SELECT user_id, category FROM ruled), cand AS (SELECT w.user_id, n.id AS notice_id, n.category, n.priority FROM wide w JOIN published n ON n.category = w.category UNION SELECT u.id, n.id, n.category, n.priority FROM users u JOIN trend ON true JOIN published n ON n.id = trend.related_id),
    p AS (SELECT k.user_id, k.notice_id, least(coalesce(views_in, 0), 10) AS a, 3 * least(coalesce(saves_in, 0), 10) AS b, CASE WHEN r.user_id IS NULL THEN 0 ELSE 20 END AS c, CASE WHEN k.priority = 'high' THEN 5 ELSE 0 END AS e, CASE WHEN tr.related_id IS NULL THEN 0 ELSE 1 END AS f
      FROM cand k JOIN users u ON u.id = k.user_id LEFT JOIN t ON t.user_id = k.user_id AND t.category = k.category LEFT JOIN ruled r ON r.user_id = k.user_id AND r.category = k.category LEFT JOIN trend tr ON tr.related_id = k.notice_id
      WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = k.user_id AND seen.notice_id = k.notice_id)),
    q AS (SELECT *, a + b + c + e + f AS score, greatest(a, b, c, e, f) AS m FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, notice_id) AS rank FROM q)
    SELECT user_id, CAST(rank AS BIGINT) AS rank, notice_id, CAST(score AS BIGINT) AS score, CASE WHEN a = m THEN 'viewed' WHEN b = m THEN 'saved' WHEN c = m THEN 'rule' WHEN e = m THEN 'priority' ELSE 'trending' END AS reason FROM z WHERE rank <= 5""", "notices", "activities", "users", "alert_rules")
def j12_recommend(spark, d):
    return R.recommend(A.users(spark, d), A.notices(spark, d), A.activities(spark, d), A.alert_rules(spark, d), 5, EVENTS_AS_OF).select("user_id", F.col("rank").cast("long"), "notice_id", "score", "reason")


@query("SELECT id, username FROM users WHERE contains(lower(username), '00000001') AND role = 'user' AND status = 'active'", "users")
def p10_search_users(spark, d):
    return M.search_users(A.users(spark, d), "00000001", "user", "active").select("id", "username")


@query("SELECT id, role, status FROM users ORDER BY CASE WHEN status = 'active' AND role = 'admin' THEN 0 WHEN status = 'active' THEN 1 ELSE 2 END, id LIMIT 1", "users")
def p11_pick_user(spark, d):
    return M.pick_user_by_role(A.users(spark, d), "admin").select("id", "role", "status")


@query("SELECT role, status, count(*) AS n, CAST(grouping(role, status) AS BIGINT) AS level FROM users GROUP BY CUBE (role, status)", "users")
def a21_user_counts(spark, d):
    return M.user_counts(A.users(spark, d))


@query("""SELECT n.notices, u.active_users, t.documents, q.pending_items, s.* FROM (SELECT count(*) AS notices FROM notices) n, (SELECT count(*) AS pending_items FROM moderation_queue WHERE id % 3 > 0) q, (SELECT count(*) FILTER (status = 'active') AS active_users FROM users) u, (SELECT count(*) AS documents FROM rag_documents) t,
    (SELECT count(*) FILTER (status = 'active') AS active_sources, count(*) FILTER (status = 'error') AS failing_sources, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (status = 'error'), '') AS failing_names, count(*) FILTER (status = 'error') = 0 AS healthy
     FROM (SELECT source AS name, CASE WHEN sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) % 2 = 1 THEN 'error' ELSE 'active' END AS status FROM scrape_logs GROUP BY 1)) s""", "notices", "users", "rag_documents", "scrape_logs", "moderation_queue")
def a5_admin_overview(spark, d):
    queue = A.moderation_queue(spark, d).withColumn("status", F.when(F.col("id") % 3 > 0, F.col("status")).otherwise("approved"))
    return M.admin_overview(A.notices(spark, d), A.users(spark, d), A.rag_documents(spark, d), sources(spark, d), queue)


def sources(spark, d):
    odd = F.count_if(F.col("status") == "error") % 2 == 1
    return A.scrape_logs(spark, d).groupBy(F.col("source").alias("name")).agg(F.when(odd, "error").otherwise("active").alias("status"), F.sum("items").alias("items_scraped"), F.max("time").alias("last_run"))


SOURCES = "SELECT source AS name, CASE WHEN count(*) FILTER (status = 'error') % 2 = 1 THEN 'error' ELSE 'active' END AS status, CAST(sum(items) AS BIGINT) AS items_scraped, max(\"time\") AS last_run FROM scrape_logs GROUP BY 1"


@query(f"WITH s AS ({SOURCES}) SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'error') AS errors, CAST(sum(items_scraped) AS BIGINT) AS items FROM s", "scrape_logs")
def a6_scraping_stats(spark, d):
    return M.scraping_stats(sources(spark, d))


@query(f"WITH s AS ({SOURCES}) SELECT name FROM s WHERE status <> 'inactive'", "scrape_logs")
def p14_scrapable_sources(spark, d):
    return M.scrapable_sources(sources(spark, d)).select("name")


@query(f"""WITH s AS (SELECT *, CASE CAST(substr(name, 7) AS INT) % 4 WHEN 0 THEN 24 WHEN 1 THEN 6 WHEN 2 THEN 168 END AS h FROM ({SOURCES}))
    SELECT name, strftime(last_run + to_hours(h), '%Y-%m-%d %H:%M:%S') AS next_run, (status = 'active' AND h IS NOT NULL AND last_run + to_hours(h) <= {CLOCK}) AS due FROM s""", "scrape_logs")
def f13_due_sources(spark, d):
    kind = F.substring("name", 7, 9).cast("int") % 4
    rows = sources(spark, d).withColumn("frequency", F.when(kind == 0, "Daily").when(kind == 1, "Every 6 hours").when(kind == 2, "Weekly").otherwise("Manual"))
    return M.due_sources(rows, EVENTS_AS_OF).select("name", stamp("next_run"), F.coalesce("due", F.lit(False)).alias("due"))


@query("SELECT source_portal, count(*) AS n, round(avg(CASE WHEN is_ocr THEN 1.0 ELSE 0.0 END), 6) AS ocr_share, round(avg(CASE WHEN is_ocr THEN 80 + id % 20 END), 6) AS mean_confidence, CAST(min(CASE WHEN is_ocr THEN 80 + id % 20 END) AS BIGINT) AS min_confidence FROM notices GROUP BY 1", "notices")
def a16_ocr_stats(spark, d):
    return M.ocr_stats(A.notices(spark, d).withColumn("ocr_confidence", F.when(F.col("is_ocr"), 80 + F.col("id") % 20)))


@query("SELECT source_portal, round(avg(5 + id % 26), 6) AS mean_minutes, CAST(quantile_disc(5 + id % 26, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(5 + id % 26, 0.95) AS DOUBLE) AS p95 FROM notices GROUP BY 1", "notices")
def a17_scrape_latency(spark, d):
    return M.scrape_latency(scraped(spark, d, 26))


def scraped(spark, d, minutes):
    return A.notices(spark, d).withColumn("scraped_at", F.col("published_at") + F.make_dt_interval(F.lit(0), F.lit(0), (5 + F.col("id") % minutes).cast("int")))


@query("SELECT source_portal, CAST(year(published_at) AS BIGINT) AS year, count(*) AS n, true AS p50_within, true AS p95_within FROM notices GROUP BY 1, 2", "notices")
def a17_latency_sketches(spark, d):
    """Median and p95 by portal and year from KLL sketches of days, held against exact ranks: both within two hundredths of the rank."""
    rows = scraped(spark, d, 1009)
    near = M.latency_quantiles(M.scrape_latency_sketches(rows).withColumn("year", F.year("day").cast("long")), "source_portal", "year")
    minutes = (F.unix_millis("scraped_at") - F.unix_millis("published_at")) / 60_000
    ranks = rows.select("source_portal", F.year("published_at").cast("long").alias("year"), minutes.alias("m")).join(near, ["source_portal", "year"]).groupBy("source_portal", "year", "n").agg(
        *[F.avg((F.col("m") < F.col(p)).cast("int")).alias(f"{p}_below") for p in ("p50", "p95")], *[F.avg((F.col("m") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in ("p50", "p95")])
    within = lambda p, q: ((F.col(f"{p}_below") <= q + 0.02) & (F.col(f"{p}_upto") >= q - 0.02)).alias(f"{p}_within")
    return ranks.select("source_portal", "year", "n", within("p50", 0.5), within("p95", 0.95))


@query("SELECT source, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'warning') AS retries, CAST(sum(items) AS BIGINT) AS items, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate FROM scrape_logs GROUP BY 1", "scrape_logs")
def a18_source_run_stats(spark, d):
    return M.source_run_stats(A.scrape_logs(spark, d)).drop("mean_seconds")


@query("SELECT source AS module, status AS level, count(*) AS n, CAST(grouping(source, status) AS BIGINT) AS subtotal FROM scrape_logs GROUP BY CUBE (source, status)", "scrape_logs")
def a19_log_summary(spark, d):
    return M.log_summary(A.scrape_logs(spark, d).select(F.col("source").alias("module"), F.col("status").alias("level")))


@query("SELECT category AS format, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files, CAST(grouping(category) AS BIGINT) AS total FROM rag_documents GROUP BY ROLLUP (category)", "rag_documents")
def a20_storage_usage(spark, d):
    return M.storage_usage(A.rag_documents(spark, d), "category", "size").select(F.col("category").alias("format"), "bytes", "files", F.col("total").cast("long"))


@query("SELECT id, source FROM scrape_logs WHERE status = 'error' AND source = 'source7'", "scrape_logs")
def p18_filter_logs(spark, d):
    return M.filter_logs(A.scrape_logs(spark, d), status="error", source="source7", level=None).select("id", "source")


@query("SELECT id, source, status FROM scrape_logs ORDER BY \"time\" DESC, id DESC LIMIT 15", "scrape_logs")
def t6_logs_desc(spark, d):
    return M.logs_desc(A.scrape_logs(spark, d), 15).select("id", "source", "status")


@query("""WITH c AS (SELECT source, date_trunc('day', "time") AS x, count(*) AS v FROM scrape_logs GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x) AS k, count(*) OVER (PARTITION BY source) AS n, min(v) OVER (PARTITION BY source) AS lo, max(v) OVER (PARTITION BY source) AS hi FROM c)
    SELECT source, strftime(x, '%Y-%m-%d %H:%M:%S') AS x, round(CASE WHEN n > 1 THEN (k - 1) / (n - 1) ELSE 0.0 END, 6) AS px, round((v - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 6) AS py FROM w""", "scrape_logs")
def w6_normalize_series(spark, d):
    daily = A.scrape_logs(spark, d).groupBy("source", F.date_trunc("day", "time").alias("x")).agg(F.count("*").alias("v"))
    return M.normalize_series(daily, "source", "x", "v").select("source", stamp("x"), "px", "py")


@query("""WITH w AS (SELECT *, last_value(CASE WHEN status = 'info' THEN "time" END IGNORE NULLS) OVER (PARTITION BY source ORDER BY "time", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM scrape_logs)
    SELECT id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, CAST(epoch(date_trunc('second', "time")) - epoch(date_trunc('second', started)) AS BIGINT) AS wall_seconds FROM w WHERE status IN ('success', 'error') AND started IS NOT NULL""", "scrape_logs")
def j16_pair_runs(spark, d):
    return M.pair_scrape_runs(A.scrape_logs(spark, d), "day").filter("started is not null").select("id", stamp("started"), "wall_seconds")


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source, date_trunc('day', \"time\") ORDER BY \"time\", id) AS k FROM scrape_logs) WHERE k <= 5", "scrape_logs")
def w5_cap_items(spark, d):
    return M.cap_items_per_run(A.scrape_logs(spark, d).withColumn("run_id", F.date_trunc("day", "time")), ("source", "run_id"), ("time", "id"), 5).select("id")


@query("""WITH c AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY "time", id ROWS UNBOUNDED PRECEDING) AS chain FROM scrape_logs), e AS (SELECT source, chain - 1 AS chain, "time" AS t FROM c WHERE status = 'success'),
    i AS (SELECT source, chain, count(*) AS events, min("time") AS began_at FROM c WHERE status IN ('warning', 'error') GROUP BY 1, 2)
    SELECT i.source, CAST(i.chain AS BIGINT) AS chain, i.events, strftime(i.began_at, '%Y-%m-%d %H:%M:%S') AS began_at, strftime(e.t, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM i LEFT JOIN e ON e.source = i.source AND e.chain = i.chain""", "scrape_logs")
def w7_retry_chains(spark, d):
    return M.retry_chains(A.scrape_logs(spark, d), "day").select("source", "chain", "events", stamp("began_at"), stamp("resolved_at"))


@query("SELECT id, CAST(sum(items) OVER (PARTITION BY source ORDER BY \"time\", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM scrape_logs", "scrape_logs")
def w11_running_items(spark, d):
    return M.running_items(A.scrape_logs(spark, d), "day").select("id", "running")


