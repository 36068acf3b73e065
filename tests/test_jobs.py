import datetime as dt

from pyspark.sql import functions as F

from noticejobs.operators import activity, admin, alerts, ingest, nearest, notices, rag, recommend
from noticejobs.sources import files
from noticejobs.streaming import jobs

RULES = "id int, user_id int, type string, conditions array<string>, enabled boolean"
NOTICES = "id int, title string, category string, organization string, status string, published_at timestamp, source_portal string, tags array<string>"


def some_notices(spark):
    at = dt.datetime(2026, 6, 1)
    rows = [
        (1, "NPSC exam notice", "exams", "Public Service", "published", at, "a", ["psc"]), (2, "Road tender 10%", "tenders", "Roads", "published", at, None, None), (3, None, "tenders", None, "draft", None, "a", []),
        (4, "Teacher vacancy", "vacancies", "Ministry of Education", "published", at, "b", ["school"]), (4, "Teacher vacancy", "vacancies", "Ministry of Education", "published", at, "b", ["school"]),
    ]
    return spark.createDataFrame(rows, NOTICES)


def test_search_is_literal_and_null_safe(spark):
    n = some_notices(spark)
    ids = lambda q: sorted(r.id for r in notices.search_notices(n, q).select("id").collect())
    assert ids("psc") == [1] and ids("10%") == [2] and ids("1_%") == [] and ids("SCHOOL") == [4, 4] and len(ids("")) == 5


def test_facets_count_the_missing_portal_once(spark):
    n = some_notices(spark)
    assert notices.count_portals(n).first()[0] == 3
    assert {r.category: r.n for r in notices.facet_counts(n).collect()} == {"all": 4, "exams": 1, "tenders": 1, "vacancies": 2}


def test_alerts(spark):
    rules = spark.createDataFrame([(1, 7, "keyword", ["PSC", "", "nothing"], True), (2, 7, "category", ["exams", "vacancies"], True), (3, 8, "organization", [" roads "], True), (4, 8, "keyword", ["tender"], False)], RULES)
    found = alerts.match_alerts(some_notices(spark), rules)
    assert sorted((r.rule_id, r.notice_id, tuple(r.matched_conditions)) for r in found.collect()) == [(1, 1, ("psc",)), (2, 1, ("exams",)), (2, 4, ("vacancies",)), (3, 2, ("roads",))]
    assert {r.rule_id: r.match_count for r in alerts.match_counts(found, rules).collect()} == {1: 1, 2: 2, 3: 1, 4: 0}
    both = spark.createDataFrame([(1, 7, "keyword", ["npsc", "exam"], True), (2, 7, "keyword", ["npsc", "road"], True)], RULES)
    assert {r.rule_id for r in alerts.match_keyword_rules(some_notices(spark), both, "all").collect()} == {1}


def test_saved_is_odd_number_of_toggles(spark):
    rows = [(1, 5, "save", 9), (2, 5, "save", 9), (3, 5, "save", 8), (4, 6, "view", 9), (5, 6, "save", 9)]
    got = activity.current_saved(spark.createDataFrame(rows, "id int, user_id int, type string, related_id int"))
    assert sorted(map(tuple, got.collect())) == [(5, 8), (6, 9)]


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "id int, name string, enabled boolean")
    changes = spark.createDataFrame([(1, None, None, "toggle", 1), (2, "B", None, "patch", 1), (3, None, None, "delete", 1), (4, "d", True, "add", 1), (4, None, None, "toggle", 2), (4, None, None, "toggle", 3)], "id int, name string, enabled boolean, op string, seq int")
    assert sorted(map(tuple, ingest.apply_changes(base, changes).collect())) == [(1, "a", False), (2, "B", False), (4, "d", True)]


def test_rows_without_a_key_do_not_collapse(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("u", 1), ("u", 2)], "source_url string, scraped_at int")
    assert ingest.latest_version(rows, "source_url", "scraped_at").count() == 3


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(1203))
    got = rag.chunk_documents(spark.createDataFrame([(1, text), (2, ""), (3, "short")], "id int, content string"), 500, 50).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, len(r.text)) for r in got] == [(1, 0, 500), (1, 1, 500), (1, 2, 303), (3, 0, 5)]
    assert got[0].text + got[1].text[50:] + got[2].text[50:] == text


def test_retry_chains(spark):
    rows = [(k, "s", dt.datetime(2026, 1, 1, k), status) for k, status in enumerate(["info", "warning", "error", "success", "warning"])]
    got = admin.retry_chains(spark.createDataFrame(rows, "id int, source string, time timestamp, status string")).orderBy("chain").collect()
    assert [(r.events, r.resolved_at and r.resolved_at.hour) for r in got] == [(2, 3), (1, None)]


def test_corrupt_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"id": "1", "title": "t"}\n{broken\n')
    good, bad = files.split_corrupt(files.read_notices(spark, str(tmp_path / "n.json")).cache())
    assert (good.count(), bad.count()) == (1, 1)
    export = good.withColumn("tags", F.array(F.lit("a,b"), F.lit('"q"')))
    files.export_table(export, str(tmp_path / "csv"), "csv")
    assert files.read_notices(spark, str(tmp_path / "csv"), "csv").first().tags == ["a,b", '"q"']


def test_equal_vectors_rank_by_id(spark):
    chunks = spark.createDataFrame([(k, [1.0, 2.0]) for k in reversed(range(3000))], "chunk_id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [2.0, 4.0])], "query_id long, vector array<double>")
    got = nearest.vector_topk(queries, chunks, 10).orderBy("rank").collect()
    assert [(r["rank"], r.chunk_id) for r in got] == [(k + 1, k) for k in range(10)]


def test_recommendations_reach_beyond_the_newest(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(k, "exams" if k % 2 else "tenders", "high" if k in (3, 90) else "normal", "published", start + dt.timedelta(hours=k), "o") for k in range(1, 101)]
    table = spark.createDataFrame(rows, "id int, category string, priority string, status string, published_at timestamp, organization string")
    users = spark.createDataFrame([(1,), (2,)], "id int")
    late = start + dt.timedelta(days=5)
    events = [(k, 1, "view", k, late) for k in range(55, 101)] + [(k, 1, "view", k, late) for k in (3, 5)] + [(200, 2, "view", 99, late), (201, 2, "view", 98, late)]
    acts = spark.createDataFrame(events, "id int, user_id int, type string, related_id int, timestamp timestamp")
    rules = spark.createDataFrame([(1, 2, "category", ["tenders"], True)], "id int, user_id int, type string, conditions array<string>, enabled boolean")
    got = {}
    for r in recommend.recommend(users, table, acts, rules, 5, "2026-01-06 12:00:00").collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.notice_id, r.score))
    views = {}
    for _, _, _, n, _ in events:
        views[n] = views.get(n, 0) + 1
    category = {n: c for n, c, *_ in rows}
    trending = [n for c in ("exams", "tenders") for n in sorted((n for n in views if category[n] == c), key=lambda n: (-views[n], n))[:10]]
    for user in (1, 2):
        saw = {n for _, u, _, n, _ in events if u == user}
        mine = [c for n, c, *_ in rows if n in saw]
        scores = {n: min(mine.count(c), 10) + 20 * (user == 2 and c == "tenders") + 5 * (p == "high") + (n in trending) for n, c, p, *_ in rows if n not in saw and c in mine}
        best = sorted(scores, key=lambda n: (-scores[n], n))[:5]
        assert sorted(got[user]) == [(j + 1, n, scores[n]) for j, n in enumerate(best)]


def test_rules_with_several_keywords_are_gathered(spark):
    rows = [(1, "Urgent road tender", "Roads"), (2, "School exam", "Urgent board"), (3, "Nothing", None)]
    table = spark.createDataFrame(rows, "id int, title string, organization string").withColumns({"category": F.lit("exams"), "published_at": F.lit("2026-01-01").cast("timestamp")})
    rules = spark.createDataFrame([(1, 7, "keyword", ["urgent", " ROAD ", ""], True), (2, 7, "keyword", ["Road"], True), (3, 8, "category", ["exams", "Exams"], True), (4, 8, "keyword", ["road"], False), (5, 8, "organization", ["roads"], True)], "id int, user_id int, type string, conditions array<string>, enabled boolean")
    got = sorted((r.rule_id, r.notice_id, r.matched_conditions) for r in alerts.match_alerts(table, rules).collect())
    assert got == [(1, 1, ["road", "urgent"]), (1, 2, ["urgent"]), (2, 1, ["road"]), (3, 1, ["exams"]), (3, 2, ["exams"]), (3, 3, ["exams"]), (5, 1, ["roads"])]


def test_more_keywords_than_are_broadcast(spark, monkeypatch):
    table = some_notices(spark)
    rules = spark.createDataFrame([(k, 1, "keyword", [w], True) for k, w in enumerate(["a", "e", "tender", "exam", "zzz"])], "id int, user_id int, type string, conditions array<string>, enabled boolean")
    expected = sorted(map(tuple, alerts.match_keyword_rules(table, rules).collect()))
    monkeypatch.setattr(alerts, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(alerts, "KEYWORDS_PER_ARRAY", 2)
    assert expected and sorted(map(tuple, alerts.match_keyword_rules(table, rules).collect())) == expected


def test_a_repeated_batch_leaves_its_matches_as_they_were(spark, tmp_path):
    some_notices(spark).write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(1, 1, "keyword", ["e"], True)], "id int, user_id int, type string, conditions array<string>, enabled boolean")
    counts = []
    for k in range(2):  # a lost checkpoint makes the stream send its first batch again
        stream = jobs.read_stream(spark, str(tmp_path / "in"), some_notices(spark).schema)
        jobs.write_matches(stream, lambda: rules, str(tmp_path / "out"), str(tmp_path / f"checkpoint{k}")).awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out" / "epoch=*")).count())
    assert counts[0] == counts[1] > 0


def test_a_tag_that_all_share_still_suggests(spark):
    rows = [(k, "o" + str(k % 3), "c", ["all", f"t{k % 25}"]) for k in range(100)] + [(100, "o9", None, None), (101, "o9", None, [])]
    table = spark.createDataFrame(rows, "id int, organization string, category string, tags array<string>")
    got = {}
    for r in recommend.related_notices(table, 3, table.filter("id % 20 = 0")).collect():
        got.setdefault(r.id, []).append((r["rank"], r.related_id, r.score))
    for a, o, c, t in rows:
        if a % 20 == 0:
            scores = {}
            for b, p, d, u in rows:
                shared, same = len(set(t or []) & set(u or [])), o == p
                if a != b and (shared or same):
                    scores[b] = 2 * same + (c is not None and c == d) + shared
            assert sorted(got[a]) == [(j + 1, b, scores[b]) for j, b in enumerate(sorted(scores, key=lambda b: (-scores[b], b))[:3])]


def test_unseen_totals_equal_unseen_rows(spark):
    notices_ = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(30)] + [(4, "b"), (5, None)], "notice_id long, category string")
    acts = spark.createDataFrame([(u, ["view", "save", "search"][k % 3], k * u % 33) for u in range(4) for k in range(20)], "user_id long, type string, related_id long")
    liked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "a"), (3, "none")], "user_id long, category string")
    expected = activity.unseen_notices(liked.join(notices_, "category"), acts).groupBy("user_id").agg(F.count("*").alias("unseen"), F.sum("notice_id").alias("ids"))
    got = activity.unseen_totals(liked, notices_, acts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 3
