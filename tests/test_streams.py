"""Stateful streams over several arrivals: late, repeated and out-of-order rows, sources that fall silent."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from noticejobs.operators import alerts
from noticejobs.streaming import jobs

LOGS = "id long, source string, time timestamp, status string"


def arrivals(spark, tmp_path, parts, schema, stream, mode="append"):
    """New rows of each arrival."""
    out, seen = [], 0
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = stream(jobs.read_stream(spark, str(tmp_path / "in"), schema))

        def batch(df, epoch):
            df.write.mode("append").parquet(str(tmp_path / f"out{k}"))  # noqa: B023

        with jobs.rocksdb_state(spark):
            rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(map(tuple, spark.read.schema(rows.schema).parquet(str(tmp_path / f"out{k}*")).collect()))[seen:] if (tmp_path / f"out{k}").exists() else [])
    return out


def test_retry_state_in_event_time(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h, minutes=m)
    parts = [
        [(1, "s", at(1), "error"), (2, "s", at(2), "warning"), (4, "s", at(4), "error"), (50, "t", at(1), "error"), (51, "t", at(1, 30), "info")],
        [(3, "s", at(3, 30), "success"), (9, "s", at(0, 30), "success")],  # in order behind row 4, and behind the watermark
        [(5, "s", at(5), "error"), (60, "u", at(40), "success")],
        [(6, "s", at(41), "error"), (52, "t", at(41), "error"), (61, "u", at(43), "error"), (62, "u", at(46), "info")],
    ]
    got = arrivals(spark, tmp_path, parts, LOGS, lambda rows: jobs.retry_state(rows, limit=2, expiry_seconds=24 * 3600))
    assert got[0] == [("s", 1, 1, False), ("s", 2, 2, True), ("t", 50, 1, False)]  # the watermark is at 3
    assert got[1] == []
    assert got[2] == [("s", 3, 0, False), ("s", 4, 1, False), ("s", 5, 2, True)]
    assert got[3] == [("s", 6, 1, False), ("t", 52, 1, False), ("u", 60, 0, False), ("u", 61, 1, False)]  # s and t were silent for a day


class Handle:
    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    exists = property(lambda self: lambda: self.value is not None)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    registerTimer = property(lambda self: self.timers.add)
    deleteTimer = property(lambda self: self.timers.discard)


class Timers:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_silent_source_leaves_no_state():
    handle, counter = Handle(), jobs.RetryCounter(3, 60)
    counter.init(handle)
    frame = pd.DataFrame({"time": pd.to_datetime([1_000_000_000], unit="us"), "id": [1], "status": ["error"]})
    assert len(next(counter.handleInputRows(("s",), iter([frame]), Timers(0)))) == 0 and handle.timers == {1_000_000}
    handle.timers.clear()
    assert next(counter.handleExpiredTimer(("s",), Timers(1_000_000), None))["attempts"].tolist() == [1] and handle.timers == {1_060_000}
    handle.timers.clear()
    assert len(next(counter.handleExpiredTimer(("s",), Timers(1_060_000), None))) == 0
    assert handle.value is None and not handle.timers


def test_running_counts_equal_batch_counts_after_a_replay(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    names = ["road tender", "school exam road", "exam", "nothing"]
    rows = [(k, names[k % 4], ["exams", "tenders"][k % 2], ["Roads", "Schools", None][k % 3], day + dt.timedelta(days=k % 9)) for k in range(40)]
    schema = "id long, title string, category string, organization string, published_at timestamp"
    rules = spark.createDataFrame([(1, 1, "keyword", ["road", "exam"], True, day + dt.timedelta(days=3)), (2, 1, "keyword", ["ten"], True, None), (3, 1, "category", ["exams"], True, None), (4, 1, "organization", ["roads", "schools"], True, None), (5, 1, "keyword", ["road"], False, None)], "id long, user_id long, type string, conditions array<string>, enabled boolean, created_at timestamp")
    got = arrivals(spark, tmp_path, [rows[:25], rows[10:]], schema, lambda df: jobs.stream_match_counts(df, rules), "complete")
    table = spark.createDataFrame(rows, schema)
    expected = alerts.match_counts(alerts.match_alerts(table, rules), rules).filter("match_count > 0")
    assert set(got[-1]) == set(map(tuple, expected.collect())) and len(got[-1]) == 4


def test_pages_repeat_within_and_beyond_the_horizon(spark, tmp_path):
    at = lambda d: dt.datetime(2026, 1, d)
    parts = [[("a", at(1)), ("b", at(1))], [("a", at(2)), ("c", at(2))], [("b", at(3))], [("a", at(4)), ("c", at(4))], [("c", at(5))]]
    got = arrivals(spark, tmp_path, parts, "source_url string, scraped_at timestamp", jobs.dedupe_scraped)
    assert [[(u, t.day) for u, t in x] for x in got] == [[("a", 1), ("b", 1)], [("c", 2)], [], [("a", 4)], [("c", 5)]]


def test_running_groups_hold_no_row_for_a_rule(spark, tmp_path):
    """A hundred rules of three profiles; a part of the notices arrives again."""
    day = dt.datetime(2026, 1, 1)
    rows = [(k, ["road tender", "school exam road"][k % 2], ["exams", "tenders"][k % 2], "Roads", day + dt.timedelta(days=k % 9)) for k in range(30)]
    schema = "id long, title string, category string, organization string, published_at timestamp"
    asked = [("keyword", ["road", "exam"]), ("category", ["exams"]), ("organization", ["roads"])]
    rules = spark.createDataFrame([(k, 1, *asked[k % 3], True, day + dt.timedelta(days=k % 10) if k % 4 else None) for k in range(100)], "id long, user_id long, type string, conditions array<string>, enabled boolean, created_at timestamp")
    members = alerts.rule_profiles(rules).cache()
    state = arrivals(spark, tmp_path, [rows[:20], rows[10:]], schema, lambda df: jobs.running_groups(jobs.stream_hits(df, members)), "complete")[-1]
    assert len(state) == 30 + 15 + 30
    groups = spark.createDataFrame(state, "profile string, notice_id long, matched_at timestamp")
    got = alerts.rule_totals(groups, members).filter("n > 0").select("rule_id", F.col("n").alias("match_count"), "last_matched_at")
    expected = alerts.match_counts(alerts.match_alerts(spark.createDataFrame(rows, schema), rules), rules).filter("match_count > 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    hits = arrivals(spark, tmp_path / "b", [rows], schema, lambda df: jobs.running_hits(jobs.stream_hits(df, members)), "complete")[-1]
    assert sum(x[2] for x in hits) == 15 + 30 + 15 + 30


def test_stream_stores_no_pairs(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    notices = [(1, "Road bridge", "c", day(5)), (2, "road", "d", None), (3, "bridge", "c", day(2)), (3, "road", "d", day(4)), (4, "x", "e", day(9))]
    rules = [(k, 7, "keyword", ["road", "Bridge"], True, day(3)) for k in range(40)] + [(50, 8, "category", ["c"], True, day(5)), (51, 8, "category", ["C", "d"], True, None), (52, 9, "organization", [" O "], True, day(9)), (53, 9, "keyword", ["road"], False, None)]
    rules = spark.createDataFrame(rules, "id long, user_id long, type string, conditions array<string>, enabled boolean, created_at timestamp")
    table = spark.createDataFrame(notices, "id long, title string, category string, published_at timestamp").withColumn("organization", F.lit("o"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), table.schema)
    jobs.write_moments(stream, lambda: rules, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got, expected = (sorted(map(tuple, df.collect()), key=str) for df in (jobs.stored_matches(spark, str(tmp_path / "out")), alerts.match_alerts(table, rules)))
    assert got == expected and len(got) > 80
    stored = spark.read.parquet(str(tmp_path / "out" / "moments"))
    assert stored.count() == 3 + 2 + 3 + 4  # a row for a notice and profile: keywords, c, c or d, organization
