"""What the findings of round 4 are about."""

import datetime as dt
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from noticejobs.llm import trie_join
from noticejobs.operators import alerts
from noticejobs.plans import QUERIES
from noticejobs.sources import adapters
from noticejobs.streaming import jobs

DAY = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=int(n))
RULES = "id long, user_id long, type string, conditions array<string>, enabled boolean, created_at timestamp"


def many(spark, kind):
    """4,000 notices of ten days with two organizations, and 500 rules of their days."""
    rng = np.random.default_rng(8)
    notices = [(int(i), "road tender" if i % 3 else "road", "news", f"o{i % 2}", DAY(rng.integers(10))) for i in rng.permutation(4000)]
    asked = {"organization": lambda k: [f"O{k % 2}"], "keyword": lambda k: [("Road", "tender")[k % 2]], "all": lambda k: ["road", "tender"][: 1 + k % 2]}[kind]
    rules = [(k, k % 7, "organization" if kind == "organization" else "keyword", asked(k), True, DAY(rng.integers(10))) for k in range(500)]
    return spark.createDataFrame(notices, "id long, title string, category string, organization string, published_at timestamp"), spark.createDataFrame(rules, RULES)


def written(spark, pairs, path):
    """Rows, and bytes of a row as they lie in Parquet."""
    pairs.write.parquet(str(path))
    n = spark.read.parquet(str(path)).count()
    return n, sum(p.stat().st_size for p in Path(path).glob("*.parquet")) / n


def by_hand(notices, rules, meets):
    """(rule_id, notice_id) of all pairs that meet in time."""
    rows = notices.collect()
    return sorted((r.id, n.id) for r in rules.collect() for n in rows if n.published_at >= r.created_at and meets(n, {c.lower() for c in r.conditions}))


def test_keyword_pairs_take_little_room(spark, tmp_path):
    notices, rules = many(spark, "keyword")
    found = alerts.match_keyword_rules(notices, rules).select("rule_id", "notice_id")
    n, size = written(spark, found, tmp_path / "out")
    assert n > 500_000 and size < 0.5  # a pair in the order of notices takes over a byte
    few = notices.filter("id < 200")
    got = alerts.match_keyword_rules(few, rules).select("rule_id", "notice_id").collect()
    assert sorted(map(tuple, got)) == by_hand(few, rules, lambda n, asked: any(c in n.title for c in asked))


def test_all_keywords_pairs_take_little_room(spark, tmp_path):
    notices, rules = many(spark, "all")
    found = alerts.match_all_keywords(notices, rules).select("rule_id", "notice_id")
    n, size = written(spark, found, tmp_path / "out")
    assert n > 500_000 and size < 0.5
    few = notices.filter("id < 200")
    got = alerts.match_all_keywords(few, rules).select("rule_id", "notice_id").collect()
    assert sorted(map(tuple, got)) == by_hand(few, rules, lambda n, asked: all(c in n.title for c in asked))


def test_organization_pairs_take_little_room(spark, tmp_path):
    notices, rules = many(spark, "organization")
    found = alerts.match_organization_rules(notices, rules).select("rule_id", "notice_id")
    n, size = written(spark, found, tmp_path / "out")
    assert n > 500_000 and size < 0.5


@pytest.mark.parametrize("broadcast_bytes", [alerts.BROADCAST_BYTES, 0])
def test_alike_notices_of_any_number_make_all_pairs(spark, monkeypatch, broadcast_bytes):
    """Arrays of all lengths, those that are dealt to several, null ids and times, and notices of which there are several rows."""
    for name, value in (("IDS", 16), ("GATHERED_IDS", 40), ("GATHERED_RULES", 3), ("BROADCAST_BYTES", broadcast_bytes)):
        monkeypatch.setattr(alerts, name, value)
    sizes = [1, 7, 8, 9, 15, 16, 17, 24, 31, 150]
    rows = [(1000 * k + i, f"o{k % 2}", None if k == 3 else DAY(k)) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(None, "o1", DAY(3))] * 3 + [(None, "o0", None), (5, None, DAY(1)), *rows[:20]]
    asked = [(k, k, "organization", [f"o{k % 2}", "none"], k != 4, None if k in (2, 3) else DAY(k)) for k in range(12)]
    notices = spark.createDataFrame(rows, "id long, organization string, published_at timestamp")
    got = alerts.match_organization_rules(notices, spark.createDataFrame(asked, RULES)).select("rule_id", "user_id", "notice_id", "published_at", "condition")
    expected = [(k, u, i, t, o) for k, u, _, c, on, since in asked for i, o, t in rows if on and o == c[0] and (since is None or (t is not None and t >= since))]
    order = lambda found: sorted(map(tuple, found), key=str)
    assert order(got.collect()) == order(expected) and len(expected) > 1000


def test_alert_pairs_are_found_for_alike_notices_at_once(spark, tmp_path):
    notices, rules = many(spark, "keyword")
    found = alerts.match_alerts(notices, rules)
    n, size = written(spark, found, tmp_path / "out")
    assert n > 500_000 and size < 0.5
    assert alerts.alerts_alike(notices, rules).count() < n / 30  # times and conditions are made once for all of an array


def test_stored_matches_are_found_for_alike_notices_at_once(spark, tmp_path):
    notices, rules = many(spark, "keyword")
    notices.write.parquet(str(tmp_path / "in"))
    jobs.write_moments(jobs.read_stream(spark, str(tmp_path / "in"), notices.schema), lambda: rules, str(tmp_path / "kept"), str(tmp_path / "checkpoint")).awaitTermination()
    n, size = written(spark, jobs.stored_matches(spark, str(tmp_path / "kept")), tmp_path / "out")
    assert n > 500_000 and size < 0.5
    assert jobs.stored_alike(spark, str(tmp_path / "kept")).count() < n / 30


def test_every_question_asks_for_related_ones(spark):
    """Not only the first of a conversation: ids divisible by 20 are those of turn 0."""
    data = "/root/testdata/sf0.001"
    asked = {r.id: set(re.findall("[a-z0-9]+", r.content.lower())) for r in adapters.chat_messages(spark, data).filter("role = 'user' and content is not null").collect()}
    expected = {a for a, words in asked.items() if any(b != a and words & others for b, others in asked.items())}
    got = QUERIES["j21_related_questions"](spark, data).collect()
    assert {r.id for r in got} == expected and any(i % 20 for i in expected)
    assert {r.related_id for r in got} <= set(asked)


def test_driver_keeps_little_of_the_sketch_of_ngrams(spark):
    """What ranks of n-grams are made of, 8 MB a copy, is not held in several copies."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 50}" for j in range(40))) for i in range(50)], "doc_id long, text string")
    expected = trie_join.frequency_ranks(docs, 3)
    tracemalloc.start()
    got = trie_join.frequency_ranks(docs, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == expected).all() and got.max() > 0 and peak < 24e6
