"""Keyword search by posting lists, keyword rules by an index of 3-grams, near-equal documents by bands: against brute force."""

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticejobs.operators import alerts, search, similar


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_bm25(chunks, queries, k):
    held = {i: words(t) for i, t in chunks if t is not None}
    n, mean = len(chunks), sum(map(len, held.values())) / len(held)
    df = Counter(w for x in held.values() for w in set(x))
    out = []
    for q, text in queries:
        score = {}
        for w in set(words(text)):
            for i, x in held.items():
                if tf := x.count(w):
                    score[i] = score.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        rounded = {i: round(s, 6) for i, s in score.items()}
        best = sorted(rounded, key=lambda i: (-rounded[i], i))[:k]
        out += [(q, r + 1, i, rounded[i]) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("shard_postings", "batch_bytes"), [(1 << 20, 1 << 20), (150, 200)])
def test_search_equals_every_pair_scored(spark, shard_postings, batch_bytes):
    """Zipfian words, so that a few stand in nearly every chunk; ties, repeated chunks, nulls, empty texts and queries."""
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, n))
    chunks = [(k, say(rng.integers(1, 60))) for k in range(200)] + [(200 + k, "w1 w2 same words") for k in range(15)] + [(300, ""), (301, None)]
    queries = [(k, say(rng.integers(1, 30))) for k in range(40)] + [(50, "w1"), (51, "same"), (52, ""), (53, None), (54, "unheard"), (55, "W1 w1, W2")]
    index = search.build_index(spark.createDataFrame(chunks, "id long, content string"), shard_postings=shard_postings)
    got = search.search(index, spark.createDataFrame(queries, "query_id long, query string"), 7, batch_bytes).collect()
    expected = plain_bm25(chunks, queries, 7)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [x[:3] for x in expected]
    scores = {x[:2]: x[3] for x in expected}
    assert all(abs(r.score - scores[r.query_id, r["rank"]]) < 2e-6 for r in got)
    index.discard()


def test_a_frequent_term_brings_up_no_chunk_alone():
    """Once rare terms fill the best k, chunks that have frequent terms only are not scored."""
    ids = np.arange(10_000)
    postings = {"the": (ids, np.full(10_000, 1.0), 1.0), "rare": (ids[::100], np.full(100, 1.0), 1.0)}
    scored = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            scored.append(len(np.atleast_1d(super().__getitem__(at))))
            return super().__getitem__(at)

    postings["the"] = (ids, postings["the"][1].view(Spy), 1.0)
    (query, places, score), = search.best_in_shard(postings, ids, [(1, [("the", 0.01), ("rare", 5.0)])], 10)
    assert query == 1 and places.tolist() == list(range(0, 1000, 100)) and np.allclose(score, 5.01) and max(scored) <= 100


RULES = "id long, user_id long, type string, conditions array<string>, enabled boolean"


def test_very_many_keywords_equal_brute_force(spark, monkeypatch):
    """200,000 keywords: hits inside words, one and two characters, letters beyond ASCII, repeated notices; broadcast and shuffled."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijkl ")
    texts = ["NPSC exam, ÉTÉ 日本", "", None, "road tender 10%", "road tender 10%"] + ["".join(rng.choice(letters, 120)) for _ in range(40)]
    table = spark.createDataFrame([(min(k, 43), t) for k, t in enumerate(texts)], "id long, title string").withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    keys = {"psc", "été", "日", "a", "zz", "10%", "é", "x"} | {"".join(rng.choice(letters[:12], rng.integers(3, 9))) for _ in range(300_000)}
    keys = sorted(keys)[:200_000] + ["psc", "été", "日", "10%", "zz"]
    rules = spark.createDataFrame([(k, 1, "keyword", [w], True) for k, w in enumerate(keys)], RULES)
    expected = sorted((k, min(j, 43)) for j, t in enumerate(texts) for k, w in enumerate(keys) if t and w in t.lower())
    got = sorted((r.rule_id, r.notice_id) for r in alerts.match_keyword_rules(table, rules).collect())
    assert got == expected and len(expected) > 100
    few = rules.filter("id % 50 = 0 or id >= 200000")
    expected = [x for x in expected if x[0] % 50 == 0 or x[0] >= 200_000]
    for limit, index_from in ((1 << 30, 10**9), (1 << 30, 0), (0, 0)):
        monkeypatch.setattr(alerts, "BROADCAST_BYTES", limit)
        assert sorted((r.rule_id, r.notice_id) for r in alerts.match_keyword_rules(table, few, index_from=index_from).collect()) == expected


def test_rules_match_what_is_published_after_them(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    table = spark.createDataFrame([(1, "exam", "exams", "Roads", day(1)), (2, "exam", "exams", "Roads", day(5)), (3, "exam", "exams", "Roads", None)], "id long, title string, category string, organization string, published_at timestamp")
    rows = [(1, 1, "category", ["exams"], True, day(5)), (2, 1, "organization", ["roads"], True, day(6)), (3, 1, "keyword", ["exam"], True, day(1)), (4, 1, "keyword", ["exam"], True, None)]
    rules = spark.createDataFrame(rows, RULES + ", created_at timestamp")
    pairs = lambda **x: sorted((r.rule_id, r.notice_id) for r in alerts.match_alerts(table, rules, **x).collect())
    assert pairs() == [(1, 2), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]
    assert pairs(backfill=True) == [(r, n) for r in (1, 2, 3, 4) for n in (1, 2, 3)]


def test_conditions_too_large_to_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(k, f"t{k}", "exams", "Roads") for k in range(50)], "id long, title string, category string, organization string").withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    rules = spark.createDataFrame([(k, 1, "category", ["exams"], True) for k in range(20)], RULES)
    expected = sorted(map(tuple, alerts.match_category_rules(table, rules).collect()))
    monkeypatch.setattr(alerts, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, alerts.match_category_rules(table, rules).collect())) == expected and len(expected) == 1000


def near_texts(rng, families, size):
    """Families of texts at many similarities, groups of copies, clean texts."""
    stock = [f"w{k}" for k in range(2000)]
    texts = []
    for _ in range(families):
        base = rng.choice(stock, size)
        for changes in (0, 0, 1, 2, 3, 4, 6, 10, 30):
            other = base.copy()
            other[rng.integers(0, size, changes)] = rng.choice(stock, changes)
            texts.append(" ".join(other))
    return texts + [" ".join(rng.choice(stock, size)) for _ in range(5 * families)] + ["one two", "", None]


def test_near_documents_miss_no_pair_that_comparison_finds(spark):
    texts = near_texts(np.random.default_rng(2), 12, 160)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    exact = {tuple(r) for r in similar.compare_documents(docs).collect()}
    for bucket in (256, 2):  # as it is, and with every bucket dealt to parts
        got = [tuple(r) for r in similar.near_documents(docs, bucket=bucket).collect()]
        assert set(got) <= exact and len(got) == len(set(got)) and len(set(got)) >= 0.9 * len(exact)
    assert len(exact) > 50


def test_candidates_grow_with_the_input(spark, monkeypatch):
    """Rows of the bucket join for clean texts and small families: twice the input, about twice the rows."""
    rows = []
    real = similar.verified

    def counted(pairs, sets, threshold):
        rows.append(pairs.count())
        return real(pairs, sets, threshold)

    monkeypatch.setattr(similar, "verified", counted)
    for families in (10, 20):
        similar.near_documents(spark.createDataFrame(list(enumerate(near_texts(np.random.default_rng(3), families, 100))), "id long, content string")).count()
    assert 1.5 < rows[1] / rows[0] < 2.5 and rows[0] < 60 * 10


def test_a_hot_key_meets_every_pair_once(spark):
    entries = spark.createDataFrame([(1, k, 10) for k in range(60)] + [(2, k, 10) for k in range(0, 60, 2)] + [(3, 99, 10)], "key long, id long, n int")
    got = sorted(map(tuple, similar.sharing_pairs(entries, similar.sizes_allow(0.8), 7).collect()))
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_counts_without_pairs_equal_counted_pairs(spark):
    """All kinds of rules, several conditions, times of rules and none, undated and repeated notices."""
    rng = np.random.default_rng(6)
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=int(d))
    words_ = ["road", "exam", "tender", "school", "bridge"]
    rows = [(k if k < 70 else 3, " ".join(rng.choice(words_, 2)), str(rng.choice(["exams", "tenders", "policy"])), [None, "Roads", " Schools "][rng.integers(3)], None if k % 11 == 0 else day(rng.integers(90))) for k in range(72)]
    table = spark.createDataFrame(rows, "id long, title string, category string, organization string, published_at timestamp")
    kinds = {"category": ["exams", "tenders", "other"], "organization": ["roads", "schools"], "keyword": [*words_, "oa", ""]}
    held = [(k, 1, kind, [str(x) for x in rng.choice(kinds[kind], rng.integers(1, 3))], k % 7 > 0, [None, day(rng.integers(90)), rows[20][4]][k % 3]) for k, kind in enumerate(rng.choice(list(kinds), 60))]
    rules = spark.createDataFrame([(a, b, str(c), d, e, f) for a, b, c, d, e, f in held], RULES + ", created_at timestamp")
    for backfill in (False, True):
        expected = alerts.match_counts(alerts.match_alerts(table, rules, backfill), rules).collect()
        got = alerts.counts_without_pairs(table, rules, backfill).collect()
        assert sorted(map(str, got)) == sorted(map(str, expected)) and sum(r.match_count for r in got) > 300


def test_groups_give_what_pairs_give(spark):
    """All kinds of rules, several conditions, times of rules and none, undated and repeated notices; no row for each rule and notice."""
    rng = np.random.default_rng(8)
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=int(d))
    words_ = ["road", "exam", "tender", "school", "bridge"]
    rows = [(k if k < 70 else 3, " ".join(rng.choice(words_, 2)), str(rng.choice(["exams", "tenders", "policy"])), [None, "Roads", " Schools "][rng.integers(3)], None if k % 11 == 0 else day(rng.integers(90))) for k in range(72)]
    table = spark.createDataFrame(rows, "id long, title string, category string, organization string, published_at timestamp")
    kinds = {"category": ["exams", "tenders", "other"], "organization": ["roads", "schools"], "keyword": [*words_, "oa", ""]}
    held = [(k, k % 5, kind, [str(x) for x in rng.choice(kinds[kind], rng.integers(1, 3))], k % 7 > 0, [None, day(rng.integers(90)), rows[20][4]][k % 3]) for k, kind in enumerate(rng.choice(list(kinds), 90))]
    rules = spark.createDataFrame([(a, b, str(c), d, e, f) for a, b, c, d, e, f in held], RULES + ", created_at timestamp")
    pairs = alerts.match_alerts(table, rules).cache()
    groups, members = alerts.match_groups(table, rules)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    twice = rules.unionByName(rules.withColumn("id", F.col("id") + 1000))
    assert alerts.match_groups(table, twice)[0].count() == groups.count() == groups.select("profile", "notice_id").distinct().count() < pairs.count()
    assert same(alerts.counts_of_groups(groups, members, rules), alerts.match_counts(pairs, rules))
    assert same(alerts.periods_of_groups(groups, members, "2026-02-20 12:00:00"), alerts.matches_by_period(pairs, "2026-02-20 12:00:00"))
    one_row = table.dropDuplicates(["id"])
    assert same(alerts.newest_of_groups(groups, members, one_row, 4), alerts.matched_notices(pairs, one_row, 4))
    prefs = spark.createDataFrame([(u, c, u != 2 or c == "a") for u in range(5) for c in "ab"], "user_id long, channel string, enabled boolean")
    channels = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "channel string, enabled boolean")
    routed = alerts.route_notifications(pairs, prefs, channels).groupBy("rule_id", "channel").agg(F.count("*").alias("n"))
    assert same(alerts.route_counts(alerts.rule_totals(groups, members), prefs, channels), routed)
    asked = spark.createDataFrame([(u, n) for u in range(5) for n in range(0, 70, 3)], "user_id long, notice_id long")
    assert same(alerts.matches_among(groups, members, asked), pairs.join(asked, ["user_id", "notice_id"], "left_semi").select("rule_id", "user_id", "notice_id", "matched_at"))
    every, now = (alerts.match_category_rules(table, rules, backfill=x) for x in (True, False))
    added = every.join(now, ["rule_id", "notice_id"], "left_anti").groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("notice_id").alias("ids"))
    assert same(alerts.backfill_of_groups(*alerts.match_groups(table, rules, kinds=("category",))), added) and added.count() > 3
    pairs.unpersist()
