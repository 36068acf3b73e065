"""What the findings of round 3 are about."""

import datetime as dt
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticejobs.operators import activity, alerts, nearest, recommend, search, similar
from noticejobs.plans import QUERIES


def test_only_classes_that_can_win_make_candidates(spark):
    table = spark.createDataFrame([(i, "abc"[i % 3], "high" if i % 2 else "low", 0) for i in range(120)], "notice_id long, category string, priority string, trending int")
    classed = recommend.class_rows(table)
    score = {"a": 9, "b": 4, "c": 1}
    asked = classed.select("category", "high", "class").distinct().collect()
    asked = spark.createDataFrame([(u, r["class"], score[r["category"]] + 5 * r["high"]) for u in (1, 2) for r in asked], "user_id long, class string, score long")
    acts = spark.createDataFrame([(1, "view", i) for i in range(3, 120, 6)], "user_id long, type string, related_id long")  # all of a, high
    found = recommend.best_candidates(asked, classed, acts, 5).collect()
    kept = {u: {(r["score"], r["notice_id"]) for r in found if r["user_id"] == u} for u in (1, 2)}
    assert {s for s, _ in kept[2]} == {14} and sorted(i for _, i in kept[2]) == [3, 9, 15, 21, 27]
    assert {s for s, _ in kept[1]} == {14, 9} and len([1 for s, _ in kept[1] if s == 9]) == 10  # a, low and b, high


def test_index_seeks_keywords_in_pieces_of_texts(spark):
    texts = [(1, "the lathe, other"), (1, "the lathe, other"), (2, "a-b ab\nx1 ünder"), (3, "breathe the"), (4, ""), (5, "über x 1")]
    words = ["the", "athe", "a", "b", "x1", "ünd", "absent", "r", "lathe", "ab"]
    table = spark.createDataFrame(texts, "notice_id long, searched string").withColumn("published_at", F.lit(None).cast("timestamp"))
    for asked in (words, [*words, "e, o", "b\nx"]):
        keywords = spark.createDataFrame([(w,) for w in asked], "condition string")
        for arrays_to in (0, 100):
            got = sorted((r.notice_id, r.condition) for r in alerts.hits_by_index(table, keywords, arrays_to).collect())
            assert got == sorted((i, w) for i, t in texts for w in asked if w in t)
    places = alerts.cut_where(spark.createDataFrame([("a1",), ("b",)], "condition string"))
    assert spark.range(1).select(F.split(F.lit("a1b,  a\nü"), places)).first()[0] == ["a1b", "a", "ü"]  # texts are cut, no whole text is moved


def test_category_rules_make_no_pair(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("pairs of rules and notices")

    monkeypatch.setattr(alerts, "match_category_rules", pairs)
    assert QUERIES["j1_category_rules"](spark, "/root/testdata/sf0.001").count() > 0


def test_targets_are_met_in_many_tasks(spark):
    rows = spark.range(4000).selectExpr("id", "case when id % 2 = 0 then 'view' else 'search' end as type", "7L as related_id")
    rows = rows.unionByName(spark.createDataFrame([(9000, "alert", 7), (9001, "document", 7), (9002, None, 7), (9003, "save", None), (9004, "save", 8)], "id long, type string, related_id long"))
    named = lambda title, c: spark.createDataFrame([(7, title)], f"id long, {c} string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(c, v)
    try:
        got = activity.activity_with_target(rows, named("n", "title"), named("r", "name"), named("d", "title")).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    expected = {i: "n" if i % 2 == 0 else None for i in range(4000)} | {9000: "r", 9001: "d", 9002: None, 9003: None, 9004: None}
    assert len(got) == len(expected) and {r.id: r.target for r in got} == expected
    assert max(Counter(r.p for r in got if r.type == "view").values()) < 1000


def test_a_block_of_cells_meets_few_queries_at_a_time():
    rng = np.random.default_rng(1)
    asked, held = rng.normal(size=(8000, 8)), rng.normal(size=(2048, 8))
    best = nearest.Best(8000, 3)
    tracemalloc.start()
    best.add_block(np.arange(0, 8000, 2), asked, held, np.arange(2048))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6  # all scores at once have 66 MB, and are copied
    near = np.round(asked @ held.T, 9)
    for q in (0, 500, 7998):
        assert best.id[q].tolist() == np.lexsort((np.arange(2048), -near[q]))[:3].tolist()
    assert np.isinf(best.score[1::2]).all()


def test_rules_with_all_keywords_and_repeated_notices(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    notices = [(1, "road tender", day(5)), (2, "road", day(5)), (3, "old road tender", day(1)), (4, "road x", day(2)), (4, "tender y", day(6))]
    rules = [(1, 7, "keyword", ["Road", "tender"], True, day(2)), (2, 8, "keyword", ["tender", "road"], True, None), (3, 9, "keyword", ["road"], True, day(3)), (4, 9, "keyword", ["road", "ROAD"], True, None)]
    table = spark.createDataFrame(notices, "id long, title string, published_at timestamp").withColumns({"category": F.lit("c"), "organization": F.lit("o")})
    rules = spark.createDataFrame(rules, "id long, user_id long, type string, conditions array<string>, enabled boolean, created_at timestamp")
    got = alerts.match_all_keywords(table, rules)
    assert sorted((r.rule_id, r.notice_id) for r in got.collect()) == [(1, 1), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)]


def test_pairs_are_made_on_all_cores(spark):
    rows = spark.range(0, 100, 1, 1).selectExpr("id as notice_id", "'c' as condition", "timestamp'2026-01-01' as published_at")
    rules = spark.createDataFrame([(k, 1, 1, None, "c") for k in range(50)], "rule_id long, user_id long, wanted int, since timestamp, condition string")
    got = alerts.joined(rows, rules)
    assert got.count() == 5000 and got.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


def test_only_sets_of_candidates_are_moved(spark):
    texts = [(1, "a b c d"), (2, "a b c d"), (3, "x y z"), (4, "a b c d e")]
    found = similar.classes_of(spark.createDataFrame(texts, "id long, content string"), 2)
    assert sorted(r.id for r in found.first.collect()) == [1, 3, 4] and found.first.columns == ["id"]
    pairs = spark.createDataFrame([(1, 4)], "a long, b long")
    assert [tuple(r) for r in similar.verified(pairs, found.stored, 0.5).collect()] == [(1, 4, 0.75)]


def spoken(rng, n, most=400):
    """Zipfian words: a few stand in nearly every text."""
    return " ".join(f"w{min(int(x), most)}" for x in rng.zipf(1.3, n))


def test_few_pairs_are_summed_one_by_one():
    """Queries meet rows in blocks; after the first rows, hardly a pair is summed by itself, and the best are those of all pairs."""
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.zipf(1.3, 25) % 500).tolist() for _ in range(6000)]
    words = [[f"w{x}" for x in one] for one in lists]
    weight = rng.random(500) * 3 + 0.1
    table = pa.table({"id": pa.array(range(0, 6000, 20), pa.int64()), "words": words[::20], "weights": [weight[x].tolist() for x in lists[::20]]})
    summed = []

    def score(product, _, __):
        summed.append(product.size)
        return np.where(product > 0, np.round(product, 6), -np.inf)

    scores = nearest.Scores(score, lambda s, _, __: np.maximum(s - 1e-6, 0), False, 1e-6)
    vocabulary, share, blocks = nearest.asked_blocks(table, 5)
    held, ids = nearest.Held(pa.array(words), vocabulary), np.arange(6000)
    for first in range(0, 6000, 500):
        block = held.block(first, first + 500, np.ones(len(held.keys)))
        column, spread = block.spread(share)
        assert 0 < len(spread) < len(vocabulary)  # both ways are taken
        before = len(summed)
        for asked in blocks:
            asked.meet(block, column, spread, ids[first : first + 500], scores)
        if first >= 3000:
            assert sum(summed[before:]) < 0.05 * 500 * 300
    for q in (0, 7, 299):
        total = np.array([sum(weight[x] for x in set(lists[20 * q]) & set(one)) for one in lists])
        total[20 * q] = -1  # the query itself
        assert blocks[0].best.id[q].tolist() == np.lexsort((ids, -np.round(total, 6)))[:5].tolist()


def test_searches_of_many_queries_need_no_index(spark, monkeypatch):
    def indexed(*_, **__):
        raise AssertionError("an index for one call")

    rng = np.random.default_rng(1)
    chunks = [(k, spoken(rng, rng.integers(1, 60))) for k in range(200)] + [(200 + k, "w1 w2 same words") for k in range(15)] + [(300, ""), (301, None), (None, "w1 same")]
    queries = [(k, spoken(rng, rng.integers(1, 30))) for k in range(40)] + [(50, "w1"), (51, "same"), (52, ""), (53, None), (54, "unheard"), (55, "W1 w1, W2"), (None, "w1")]
    table, asked = spark.createDataFrame(chunks, "id long, content string"), spark.createDataFrame(queries, "query_id long, query string")
    expected = sorted(map(tuple, search.search(search.build_index(table), asked, 7).select("query_id", "rank", "chunk_id", F.round("score", 5)).collect()))
    monkeypatch.setattr(search, "build_index", indexed)
    got = search.keyword_retrieve(table, asked, 7).select("query_id", "rank", "chunk_id", F.round("score", 5)).collect()
    assert sorted(map(tuple, got)) == expected and len(expected) > 200


def test_only_shared_ngrams_are_ranked(spark):
    """Sets that share too few n-grams drop out before any is ranked."""
    rng = np.random.default_rng(4)
    pool = [sorted({int(x) for x in rng.integers(0, 60, 12)}) for _ in range(40)]
    texts = pool + [sorted({*one[1:], 1000 + i}) for i, one in enumerate(pool[:20])] + [[2000 + 9 * i + j for j in range(9)] for i in range(20)]
    sets = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(texts)], "id long, s array<long>, n int")
    found = similar.shared_prefixes(sets, 0.8)
    df = Counter(g for s in texts for g in s)
    expected = []
    for i, s in enumerate(texts):
        rarest = sorted(s, key=lambda g: (df[g], g))[: len(s) - int(np.ceil(0.8 * len(s))) + 1]
        expected += [(g, i, len(s)) for g in rarest if df[g] > 1]
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 50
    assert similar.shared_prefixes(sets.filter("id >= 60"), 0.8).count() == 0  # nothing shared, nothing ranked
    grams = {g for g, _, _ in expected}
    assert all(sum(df[g] > 1 for g in texts[i]) >= 0.8 * n for _, i, n in expected) and grams <= {g for g in df if df[g] > 1}


def test_related_notices_by_blocks_equal_all_pairs(spark, monkeypatch):
    """Ties, a category alone, nulls, and words that look like labels; no row is sorted for a pair that a smaller id beats."""
    rng = np.random.default_rng(6)
    pick = lambda x: None if x == 3 else f"v{x}"
    rows = [(i, pick(rng.integers(4)), pick(rng.integers(4)), [f"v{x}" for x in np.unique(rng.integers(0, 12, rng.integers(0, 5)))]) for i in range(300)] + [(300, "v1", "v2", None), (301, None, "v2", [])]
    table = spark.createDataFrame(rows, "id long, organization string, category string, tags array<string>")
    expected = []
    for a, o, c, t in rows[::20]:
        score = {}
        for b, o2, c2, t2 in rows:
            shared, same = len(set(t or []) & set(t2 or [])), o is not None and o == o2
            if a != b and (shared or same):
                score[b] = 2 * same + (c is not None and c == c2) + shared
        expected += [(a, r + 1, b, score[b]) for r, b in enumerate(sorted(score, key=lambda b: (-score[b], b))[:3])]
    got = recommend.related_notices(table, 3, table.filter("id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 40
    table = pa.table({"id": pa.array([0], pa.int64()), "words": [["t1"]], "weights": [[1.0]]})
    vocabulary, share, (asked,) = nearest.asked_blocks(table, 3)
    block = nearest.Held(pa.array([["t1"]] * 50), vocabulary).block(0, 50, np.ones(50))
    scores, merged = nearest.Scores(lambda c, _, __: c, lambda s, _, __: s), []
    monkeypatch.setattr(nearest.Best, "merge", lambda self, query, *x, own=nearest.Best.merge: (merged.append(len(query)), own(self, query, *x)))
    for first in (1, 51):
        asked.meet(block, *block.spread(share), np.arange(first, first + 50), scores)
    assert merged == [50, 0] and asked.best.id.tolist() == [[1, 2, 3]]


def test_related_questions_by_blocks_equal_all_pairs():
    """Jaccard: what a pair must share depends on both sizes; later rows are looked at one by one only where they may win."""
    rng = np.random.default_rng(7)
    lists = [np.unique(rng.zipf(1.4, rng.integers(1, 30)) % 200).tolist() for _ in range(4000)]
    words = [[f"w{x}" for x in one] for one in lists]
    asked_for = []

    def score(shared, q, r):
        asked_for.append(shared.size)
        value = np.round(shared / np.maximum(q + r - shared, 1), 6)
        return np.where(value > 0, value, -np.inf)

    def least(value, q, r):
        value = np.maximum(value - 1e-6, 0)
        return value / (1 + value) * (q + r) - 1e-3

    table = pa.table({"id": pa.array(range(0, 4000, 40), pa.int64()), "words": words[::40], "weights": [[1.0] * len(x) for x in words[::40]]})
    vocabulary, share, (asked,) = nearest.asked_blocks(table, 3)
    held, ids = nearest.Held(pa.array(words), vocabulary), np.arange(4000)
    for first in range(0, 4000, 500):
        block, before = held.block(first, first + 500, np.ones(len(held.keys))), len(asked_for)
        asked.meet(block, *block.spread(share), ids[first : first + 500], nearest.Scores(score, least, step=1e-6))
    assert sum(asked_for[before:]) < 0.2 * 500 * 100
    for q in range(0, 100, 9):
        mine = set(lists[40 * q])
        value = np.array([round(len(mine & set(x)) / len(mine | set(x)), 6) for x in lists])
        value[40 * q] = -1
        assert asked.best.id[q].tolist() == np.lexsort((ids, -value))[:3].tolist()
