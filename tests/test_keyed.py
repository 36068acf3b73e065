"""Upserts into a stored table: results, plan and files."""

import random

import pytest

from noticejobs.sources.keyed import KeyedTable

SCHEMA = "url string, at long, id long, title string, removed boolean"


def newest(rows):
    best = {}
    for url, at, key, title, removed in rows:
        rank = (at is not None, at or 0, key)
        if url is not None and (url not in best or rank >= best[url][0]):
            best[url] = (rank, title, removed)
    return sorted((u, t) for u, (_, t, removed) in best.items() if not removed)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"u{k}", 10, k, f"t{k}", False) for k in range(300)]
    name = f"keyed_{tmp_path.name.replace('-', '_')}"
    held = KeyedTable.create(spark.createDataFrame(rows, SCHEMA), name, "url", ("at", "id"), str(tmp_path / "base"), parts=16, buckets=4)
    yield rows, held, tmp_path / "base"
    spark.sql(f"DROP TABLE {name}")


def content(held):
    return sorted((r.url, r.title) for r in held.rows().collect())


def test_upserts_keep_the_newest_row(spark, table):
    """New keys, newer and older rows, equal ranks, several rows of a key, null keys and times, deletes that older rows do not undo."""
    rows, held, _ = table
    rng = random.Random(4)
    assert content(held) == newest(rows)
    for step in range(4):
        more = [(f"u{rng.randrange(330)}" if rng.random() > 0.05 else None, rng.choice([None, 5, 10, 11 + step]), 1000 * step + k, f"s{step}-{k}", rng.random() < 0.2) for k in range(60)]
        held.upsert(spark.createDataFrame(more, SCHEMA).repartition(3), delete="removed")
        rows = rows + more
        assert content(held) == newest(rows)
    held.upsert(spark.createDataFrame([], SCHEMA))
    assert content(held) == newest(rows)


def test_only_touched_partitions_change(spark, table):
    _, held, path = table
    files = lambda: {x: x.stat().st_mtime_ns for x in path.rglob("*.parquet")}
    before = files()
    change = spark.createDataFrame([("u7", 20, 1, "new", False)], SCHEMA)
    part = change.select(held.part_of().alias("p")).first().p
    held.upsert(change)
    after = files()
    assert {x: t for x, t in before.items() if f"_part={part}" not in str(x)} == {x: t for x, t in after.items() if f"_part={part}" not in str(x)}
    assert len({x.parent for x in before}) > 5 and set(after) != set(before) and dict(content(held))["u7"] == "new"


def test_the_base_is_not_shuffled(spark, table):
    _, held, _ = table
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = held.merged(spark.createDataFrame([(f"u{k}", 20, k, "new", False) for k in range(50)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join = plan.split("SortMergeJoin", 1)[1]
    base = join[: join.index("FileScan")]  # the path from the join down to the scan of the base
    assert "Bucketed: true" in plan and "Exchange" not in base and "PartitionFilters: [_part" in plan
