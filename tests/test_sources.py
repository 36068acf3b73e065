"""The table of epochs, and running figures of sources by segments."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticejobs.operators import activity, admin, notices
from noticejobs.sources import epochs, files
from noticejobs.streaming import jobs

ROW = "id long, name string"


def batch(*ids):
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "name": [f"n{k}" for k in ids]})


def ids_of(spark, path):
    spark.dataSource.register(epochs.EpochSource)
    return sorted(r.id for r in spark.read.format("epochs").schema(ROW).load(path).collect())


def test_epochs_are_whole_and_count_once(spark, tmp_path):
    writer, path = epochs.EpochWriter(str(tmp_path)), str(tmp_path)
    assert ids_of(spark, path) == []
    first = [writer.write(iter([batch(1, 2)])), writer.write(iter([batch(3)])), writer.write(iter([]))]
    assert ids_of(spark, path) == []  # not committed yet
    writer.commit(first, 0)
    assert ids_of(spark, path) == [1, 2, 3]
    files_then = sorted(x.name for x in (tmp_path / "data").iterdir())
    writer.commit([writer.write(iter([batch(1, 2)])), writer.write(iter([batch(3)])), None], 0)  # the same epoch again
    writer.abort([writer.write(iter([batch(4)])), None], 1)
    assert ids_of(spark, path) == [1, 2, 3] and sorted(x.name for x in (tmp_path / "data").iterdir()) == files_then

    def failing():
        yield batch(5)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(failing())
    assert sorted(x.name for x in (tmp_path / "data").iterdir()) == files_then
    writer.commit([writer.write(iter([batch(6)]))], 1)
    assert ids_of(spark, path) == [1, 2, 3, 6]


def test_streams_write_and_read_epochs(spark, tmp_path):
    """Two runs of a writing stream, a lost checkpoint, and a reading stream that goes on where it stopped."""
    source, table, out = (str(tmp_path / x) for x in ("in", "table", "out"))
    counts = []
    for k, ids in enumerate([range(10), range(10, 15)]):
        spark.createDataFrame([(i, f"n{i}") for i in ids], ROW).coalesce(2).write.mode("append").parquet(source)
        jobs.sink_epochs(jobs.read_stream(spark, source, ROW), table, str(tmp_path / "c1")).awaitTermination()
        reader = jobs.read_epochs(spark, table, ROW)
        reader.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(out).awaitTermination()
        counts.append(sorted(r.id for r in spark.read.schema(ROW).parquet(out).collect()))
    assert counts == [list(range(10)), list(range(15))]
    jobs.sink_epochs(jobs.read_stream(spark, source, ROW), table, str(tmp_path / "c3")).awaitTermination()  # sends everything as epoch 0
    assert ids_of(spark, table) == list(range(15))


@pytest.fixture(scope="module")
def logs(spark):
    rng = np.random.default_rng(3)
    status = ["info", "success", "error", "warning"]
    rows = [(k, f"s{rng.integers(3)}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 120))), status[rng.integers(4)], int(rng.integers(9)) if k % 7 else None) for k in range(600)]
    rows += [(700, "quiet", dt.datetime(2026, 1, 5), "success", None), (701, None, dt.datetime(2026, 3, 5), "error", 2), (702, None, dt.datetime(2026, 1, 5), "info", 1), (703, "s0", None, "error", 4)]
    return spark.createDataFrame(rows, "id long, source string, time timestamp, status string, items long")


@pytest.mark.parametrize("segment", ["month", "day", "year"])
def test_segments_give_what_one_window_gives(logs, segment):
    w = Window.partitionBy("source").orderBy("time", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(admin.running_items(logs, segment)) == rows(logs.withColumn("running", F.sum("items").over(upto)))
    started = F.last(F.when(F.col("status") == "info", F.col("time")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    paired = logs.withColumn("started", started).filter("status in ('success', 'error')").withColumn("wall_seconds", F.unix_timestamp("time") - F.unix_timestamp("started"))
    assert rows(admin.pair_scrape_runs(logs, segment)) == rows(paired)
    chained = logs.withColumn("chain", F.sum((F.col("status") == "success").cast("long")).over(upto))
    expected = chained.filter("status in ('error', 'warning')").groupBy("source", "chain").agg(F.count("*").alias("events"), F.min("time").alias("began_at"))
    assert rows(admin.retry_chains(logs, segment).drop("resolved_at")) == rows(expected)


def test_the_window_of_a_source_is_never_sorted_whole(logs):
    plan = admin.running_items(logs)._jdf.queryExecution().executedPlan().toString()
    assert "_segment" in plan and plan.count("Window [") == 2


def test_sketches_merge_and_estimate(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(k, k % 997, "view", k % 50, start + dt.timedelta(hours=k % 900)) for k in range(20_000)]
    acts = spark.createDataFrame(rows, "id long, user_id long, type string, related_id long, timestamp timestamp")
    sketches = activity.user_sketches(acts)
    assert sketches.count() == len({r[4].date() for r in rows})  # a row a day
    for period in ("day", "month"):
        exact = {r.p: r.n for r in acts.groupBy(F.date_trunc(period, "timestamp").alias("p")).agg(F.count_distinct("user_id").alias("n")).collect()}
        assert all(abs(r.users - exact[r.period]) <= 0.05 * exact[r.period] for r in activity.distinct_users(sketches, period).collect())
    near = activity.distinct_users_by_day(acts, approx=True).collect()
    exact = {r.day: r.users for r in activity.distinct_users_by_day(acts).collect()}
    assert all(abs(r.users - exact[r.day]) <= 0.15 * exact[r.day] for r in near)
    portals = spark.createDataFrame([(k, f"p{k % 3}") for k in range(50)], "id long, source_portal string")
    users = {p: {u for _, u, _, n, _ in rows if n % 3 == p} for p in range(3)}
    for r in activity.shared_users(activity.portal_users(acts, portals)).collect():
        both = len(users[int(r.a[1])] & users[int(r.b[1])])
        assert abs(r.users - both) <= 0.05 * both + 1


def test_latency_quantiles_of_merged_days(spark):
    rng = np.random.default_rng(1)
    minutes = rng.exponential(40, 6000)
    start = dt.datetime(2026, 1, 1)
    rows = [("p", start + dt.timedelta(days=k % 30), start + dt.timedelta(days=k % 30, minutes=float(m))) for k, m in enumerate(minutes)] + [("p", None, start), ("q", start, None)]
    days = admin.scrape_latency_sketches(spark.createDataFrame(rows, "source_portal string, published_at timestamp, scraped_at timestamp"))
    (got,) = admin.latency_quantiles(days, "source_portal").collect()
    assert days.count() == 30 and got.n == 6000
    for q, value in ((0.5, got.p50), (0.95, got.p95)):
        assert abs((minutes <= value).mean() - q) < 0.01


def test_unknown_values_are_rejected(spark):
    rows = spark.createDataFrame([(1, "t", "d", "exams", "o", "high", "draft"), (2, "t", "d", "exams", "o", "medium", "draft"), (3, "t", "d", "exams", "o", "low", "gone"), (4, "t", "d", "exams", "o", None, None)], "id int, title string, description string, category string, organization string, priority string, status string")
    good, bad = files.validate_import(rows)
    assert sorted(r.id for r in good.collect()) == [1, 4] and {r.id: r.reasons for r in bad.collect()} == {2: ["unknown priority"], 3: ["unknown status"]}
    assert files.validate_import(rows.drop("priority", "status"))[0].count() == 4


def test_ranks_by_bands_equal_ranks_of_whole_categories(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [None, "a", "b"][k % 3], None if k % 17 == 0 else int(rng.choice([0, 0, 1, 2, 7, rng.integers(-50, 100_000)]))) for k in range(400)] + [(500, "one", 5)]
    df = spark.createDataFrame(rows, "id long, category string, views long")
    w = Window.partitionBy("category").orderBy(F.desc("views"))
    expected = df.withColumns({"views_rank": F.rank().over(w).cast("long"), "views_percent": F.percent_rank().over(w)})
    assert sorted(map(str, notices.views_rank(df).collect())) == sorted(map(str, expected.collect()))
