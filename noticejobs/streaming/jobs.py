"""Streams of notices, activities and scrape logs. Event time is checked by a watermark of one hour by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noticejobs.operators.alerts import match_alerts, match_category_rules, match_keyword_rules, match_organization_rules, matches_of_moments, moments_of_hits, pairs_of, profile_hits, rule_profiles
from noticejobs.sources.epochs import EpochSource

WATERMARK = "1 hour"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of what ``write_moments`` stores.
STORED = {
    "members": "profile string, rule_id long, user_id long, wanted int, since timestamp",
    "moments": "profile string, notice_id long, moments array<struct<published_at: timestamp, conditions: array<string>>>",
}


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def write_matches(stream: DataFrame, rules: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Match arriving notices; rules are read anew for every batch, a repeated batch overwrites its own folder."""
    def batch(notices: DataFrame, epoch: int) -> None:
        match_alerts(notices, rules()).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_moments(stream: DataFrame, rules: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """As ``write_matches``, but a batch stores what its notices meet of the profiles of rules, and the rules as it read them, so what is
    stored grows with notices and rules and not with their pairs; ``stored_matches`` makes these."""
    def batch(notices: DataFrame, epoch: int) -> None:
        members = rule_profiles(rules())
        members.write.mode("overwrite").parquet(f"{out}/members/epoch={epoch}")
        members = stream.sparkSession.read.schema(members.schema).parquet(f"{out}/members/epoch={epoch}")
        moments_of_hits(profile_hits(notices, members)).write.mode("overwrite").parquet(f"{out}/moments/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_matches(spark: SparkSession, out: str) -> DataFrame:
    """The matches (as ``match_alerts``) of all batches of ``write_moments``; a notice of a batch meets the rules of that batch."""
    return pairs_of(stored_alike(spark, out)).select("rule_id", "user_id", "notice_id", "matched_at", "matched_conditions")


def stored_alike(spark: SparkSession, out: str) -> DataFrame:
    """``stored_matches`` with arrays ``ids`` of notices that are alike."""
    held = {name: spark.read.schema(f"{columns}, epoch long").parquet(f"{out}/{name}").withColumn("profile", F.concat_ws(" ", "epoch", "profile")) for name, columns in STORED.items()}
    return matches_of_moments(held["moments"], held["members"])


def stream_pairs(notices: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, notice_id, published_at) of arriving notices, a row for each condition that is met."""
    kinds = (match_category_rules, match_organization_rules, match_keyword_rules)
    return reduce(DataFrame.unionByName, [f(notices, rules).select("rule_id", "notice_id", "published_at") for f in kinds])


def sink_epochs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table of epochs: all rows of a batch, or none, and once."""
    stream.sparkSession.dataSource.register(EpochSource)
    return stream.writeStream.format("epochs").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table of epochs, as a stream."""
    spark.dataSource.register(EpochSource)
    return spark.readStream.format("epochs").schema(schema).load(path)


def stream_match_counts(notices: DataFrame, rules: DataFrame) -> DataFrame:
    """Running count and last match of every kind of rule. The state holds each (rule, notice) once, so neither a notice that
    arrives again nor a second keyword of a rule counts twice, and a row for each rule."""
    once = stream_pairs(notices, rules).dropDuplicates(["rule_id", "notice_id"])
    return once.groupBy("rule_id").agg(F.count("*").alias("match_count"), F.max("published_at").alias("last_matched_at"))


def stream_hits(notices: DataFrame, members: DataFrame) -> DataFrame:
    """(profile, notice_id, published_at) of arriving notices, a row for each condition that is met; ``members`` from ``rule_profiles``. Rules of
    one profile share these rows, so they grow with the notices and not with the rules."""
    return profile_hits(notices, members).select("profile", "notice_id", "published_at")


def running_hits(hits: DataFrame) -> DataFrame:
    """(profile, matched_at, n, ids): running number and sum of ids of the hits of a profile and time, for ``rule_totals``."""
    return hits.groupBy("profile", F.col("published_at").alias("matched_at")).agg(F.count("*").alias("n"), F.sum("notice_id").alias("ids"))


def running_groups(hits: DataFrame) -> DataFrame:
    """(profile, notice_id, matched_at), for ``rule_totals``. The state holds each notice once for a profile, so neither a notice that arrives again
    nor a second keyword counts twice."""
    return hits.groupBy("profile", "notice_id").agg(F.max("published_at").alias("matched_at"))


def digest(matches: DataFrame, window: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """One digest per user and tumbling window."""
    return matches.withWatermark("matched_at", watermark).groupBy(F.window("matched_at", window), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def scrape_errors(logs: DataFrame, window: str = "1 hour", slide: str = "15 minutes", watermark: str = WATERMARK) -> DataFrame:
    bad = logs.filter(F.col("status").isin("error", "warning")).withWatermark("time", watermark)
    return bad.groupBy(F.window("time", window, slide), "source").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source", "n")


def activity_sessions(activities: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return activities.withWatermark("timestamp", watermark).groupBy(F.session_window("timestamp", gap).alias("s"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def dedupe_scraped(pages: DataFrame, horizon: str = "1 day") -> DataFrame:
    """The first scrape of a source_url within the horizon."""
    return pages.withWatermark("scraped_at", horizon).dropDuplicatesWithinWatermark(["source_url"])


def live_counters(notices: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return notices.withWatermark("published_at", watermark).groupBy(F.window("published_at", "1 hour"), "category").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "category", "n")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class RetryCounter(StatefulProcessor):
    """Consecutive failures of a source in the order of event time.

    Rows wait in the state until the watermark has passed them, so rows that arrive out of order count in order, and a timer
    at the earliest of them folds them, one by one. A source without rows for ``expiry`` begins anew; another
    timer then clears its state. Times are microseconds.
    """

    BAD, GOOD = ("error", "warning"), "success"
    STATE = "attempts int, last long, timer long, times array<long>, ids array<long>, kinds array<int>"

    def __init__(self, limit: int, expiry_seconds: int):
        self.limit, self.expiry = limit, expiry_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retries", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            kinds = [1 if x in self.BAD else 2 if x == self.GOOD else 0 for x in frame["status"]]
            fresh += zip((frame["time"].astype("datetime64[us]").astype("int64")).tolist(), frame["id"].tolist(), kinds, strict=True)
        yield self.fold(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.fold(key, [], timerValues, fired=True)

    def fold(self, key, fresh: list, timerValues, fired: bool = False) -> pd.DataFrame:
        attempts, last, timer, *waiting = self.state.get() if self.state.exists() else (0, 0, 0, [], [], [])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pending = sorted([*zip(*waiting, strict=True), *fresh])
        out, done = [], 0
        for at, row, kind in pending:
            if at > passed:
                break
            attempts = 0 if last and at - last > self.expiry else attempts
            attempts = attempts + 1 if kind == 1 else 0 if kind == 2 else attempts
            last, done = at, done + 1
            if kind:
                out.append((key[0], row, attempts, attempts >= self.limit))
        pending = pending[done:]
        if timer and not fired:
            self.handle.deleteTimer(timer)
        if not pending and last + self.expiry <= passed:
            self.state.clear()
        else:
            timer = max(-(-(pending[0][0] if pending else last + self.expiry) // 1000), passed // 1000 + 1)
            self.handle.registerTimer(timer)
            self.state.update((attempts, last, timer, *map(list, zip(*pending, strict=True))) if pending else (attempts, last, timer, [], [], []))
        return pd.DataFrame({"source": pd.Series([x[0] for x in out], dtype="str"), "id": pd.Series([x[1] for x in out], dtype="int64"), "attempts": pd.Series([x[2] for x in out], dtype="int32"), "failed": pd.Series([x[3] for x in out], dtype="bool")})


def retry_state(logs: DataFrame, limit: int = 3, watermark: str = WATERMARK, expiry_seconds: int = 7 * 86_400) -> DataFrame:
    """(source, id, attempts, failed) for every failure and success, once the watermark has passed it: consecutive failures
    of the source up to it; failed from ``limit`` on. Start the query inside ``rocksdb_state``."""
    rows = logs.select("source", "id", "time", "status").withWatermark("time", watermark)
    return rows.groupBy("source").transformWithStateInPandas(RetryCounter(limit, expiry_seconds), "source string, id long, attempts int, failed boolean", "append", "EventTime")
