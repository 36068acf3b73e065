"""Administration: overviews, logs, users, sources, scraping runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S


def admin_overview(notices: DataFrame, users: DataFrame, docs: DataFrame, sources: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """One row of totals, with the items of the moderation queue that still wait; the parts are one-row aggregates."""
    n = notices.agg(F.count("*").alias("notices"))
    u = users.agg(F.count_if(F.col("status") == "active").alias("active_users"))
    d = docs.agg(F.count("*").alias("documents"))
    failing = F.col("status") == "error"
    s = sources.agg(F.count_if(F.col("status") == "active").alias("active_sources"), F.count_if(failing).alias("failing_sources"), F.array_join(F.sort_array(F.collect_list(F.when(failing, F.col("name")))), ", ").alias("failing_names"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    parts = [n, u, d, s] + ([queue.agg(F.count_if(F.col("status") == "pending").alias("pending_items"))] if queue is not None else [])
    return reduce(lambda a, b: a.join(b, "_one"), map(one, parts)).drop("_one").withColumn("healthy", F.col("failing_sources") == 0)


def scraping_stats(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("items_scraped"), F.lit(0)).alias("items"))


def scrapable_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status") != "inactive")


def due_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Next run of each source, minutes to it and whether it is due."""
    now, hours = S.moment(as_of), S.frequency_hours("frequency")
    next_run = F.col("last_run") + F.make_dt_interval(F.lit(0), hours)
    due = (F.col("status") == "active") & hours.isNotNull() & (F.col("last_run").isNull() | (next_run <= now))
    return sources.withColumns({"next_run": next_run, "due": due, "minutes_to_next": F.timestamp_diff("MINUTE", now, next_run)})


def search_users(users: DataFrame, q: str, role: str | None = None, status: str | None = None) -> DataFrame:
    fields = [c for c in ("username", "email") if c in users.columns]
    out = users.filter(S.any_of([S.holds(c, q) for c in fields])) if q else users
    for column, value in (("role", role), ("status", status)):
        out = out.filter(F.col(column) == value) if value else out
    return out


def pick_user_by_role(users: DataFrame, role: str) -> DataFrame:
    """First active user of the role, else the first active one, else the first."""
    active = F.col("status") == "active"
    rank = F.when(active & (F.col("role") == role), 0).when(active, 1).otherwise(2)
    return users.orderBy(rank, "id").limit(1)


def user_counts(users: DataFrame) -> DataFrame:
    """Users by role and status with subtotals."""
    return users.cube("role", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def ocr_stats(notices: DataFrame) -> DataFrame:
    ocr = F.coalesce("is_ocr", F.lit(False))
    return notices.groupBy("source_portal").agg(F.count("*").alias("n"), F.round(F.avg(ocr.cast("int")), 6).alias("ocr_share"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"), F.min("ocr_confidence").alias("min_confidence"))


def scrape_latency_sketches(notices: DataFrame, k: int = 800) -> DataFrame:
    """(source_portal, day, sketch, n): a KLL sketch of the minutes from publication to scrape; days are merged by
    ``latency_quantiles``, so a new day adds a row a portal and reads no old ones."""
    minutes = (F.unix_millis("scraped_at") - F.unix_millis("published_at")) / 60_000
    rows = notices.withColumn("_m", minutes).filter("_m is not null")
    return rows.groupBy("source_portal", F.to_date("published_at").alias("day")).agg(F.kll_sketch_agg_double("_m", k).alias("sketch"), F.count("*").alias("n"))


def latency_quantiles(sketches: DataFrame, *by: str, k: int = 800) -> DataFrame:
    """p50 and p95 of the merged sketches of each group, and how many minutes they stand for."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.select(*by, "n", quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))


def scrape_latency(notices: DataFrame) -> DataFrame:
    """Minutes from publication to scrape per portal."""
    minutes = (F.unix_millis("scraped_at") - F.unix_millis("published_at")) / 60_000
    rows = notices.withColumn("_m", minutes).filter("_m is not null")
    return rows.groupBy("source_portal").agg(F.round(F.avg("_m"), 6).alias("mean_minutes"), F.percentile_approx("_m", 0.5, 10_000).alias("p50"), F.percentile_approx("_m", 0.95, 10_000).alias("p95"))


def source_run_stats(logs: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    out = logs.groupBy("source").agg(F.count("*").alias("runs"), status("success").alias("successes"), status("error").alias("errors"), status("warning").alias("retries"), F.sum("items").alias("items"), F.round(F.avg("seconds"), 6).alias("mean_seconds") if "seconds" in logs.columns else F.lit(None).cast("double").alias("mean_seconds"))
    return out.withColumn("error_rate", F.round(F.col("errors") / F.col("runs"), 6))


def filter_logs(logs: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        logs = logs.filter(F.col(column) == value) if value is not None else logs
    return logs


def log_summary(logs: DataFrame, a: str = "module", b: str = "level") -> DataFrame:
    return logs.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("subtotal"))


def logs_desc(logs: DataFrame, n: int) -> DataFrame:
    return logs.orderBy(F.desc("time"), F.desc("id")).limit(n)


def storage_usage(files: DataFrame, fmt: str = "format", size: str = "size_bytes") -> DataFrame:
    return files.rollup(fmt).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"), F.grouping(fmt).alias("total"))


def normalize_series(df: DataFrame, key: str, x: str, v: str) -> DataFrame:
    """Points of a sparkline: x from 0 to 1 by order, y from the smallest to the largest value."""
    whole = Window.partitionBy(key)
    n, lo, hi = F.count("*").over(whole), F.min(v).over(whole), F.max(v).over(whole)
    k = F.row_number().over(whole.orderBy(x))
    span = F.when(hi == lo, F.lit(1)).otherwise(hi - lo)
    return df.withColumns({"px": F.round(F.when(n > 1, (k - 1) / (n - 1)).otherwise(0.0), 6), "py": F.round((F.col(v) - lo) / span, 6)})


def with_carry(logs: DataFrame, values: dict[str, Column], segment: str = "month") -> tuple[DataFrame, WindowSpec]:
    """``logs`` cut into segments of a source and a period, with what earlier segments of the source leave to each.

    ``values`` are aggregates of a segment that can be folded: sums (of counts and numbers), which are added up, and maxima of times,
    of which the latest counts. The rows of a source are never sorted in one place: each segment by itself, and one row a
    segment to fold what is carried. Returns the rows with ``_segment`` and a column for each value, and the window of a segment.
    """
    cut = logs.withColumn("_segment", F.date_trunc(segment, "time"))
    each = cut.groupBy("source", "_segment").agg(*[v.alias(k) for k, v in values.items()])
    before = Window.partitionBy("source").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    fold = {f.name: F.max if f.dataType.typeName().startswith("timestamp") else F.sum for f in each.schema}
    carried = each.select("source", "_segment", *[fold[k](k).over(before).alias(k) for k in values])
    rows = cut.join(carried.select(F.col("source").alias("_source"), F.col("_segment").alias("_of"), *values), F.col("source").eqNullSafe(F.col("_source")) & F.col("_segment").eqNullSafe(F.col("_of")), "left").drop("_source", "_of")
    return rows, Window.partitionBy("source", "_segment").orderBy("time", "id")


def pair_scrape_runs(logs: DataFrame, segment: str = "month") -> DataFrame:
    """Every finished row with the time of the latest start before it of the same source."""
    start = F.when(F.col("status") == "info", F.col("time"))
    rows, w = with_carry(logs, {"_started": F.max(start)}, segment)
    here = F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    paired = rows.withColumn("started", F.coalesce(here, "_started")).filter(F.col("status").isin("success", "error"))
    return paired.drop("_segment", "_started").withColumn("wall_seconds", F.unix_timestamp("time") - F.unix_timestamp("started"))


def cap_items_per_run(items: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int = 100) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def retry_chains(logs: DataFrame, segment: str = "month") -> DataFrame:
    """Runs of warnings and errors between successes of a source as one incident, with the success that ended it."""
    success = F.col("status") == "success"
    rows, w = with_carry(logs, {"_before": F.count_if(success)}, segment)
    here = F.sum(F.coalesce(success, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = rows.withColumn("chain", here + F.coalesce("_before", F.lit(0)))
    bad = F.col("status").isin("warning", "error")
    # The success that closes chain c opens chain c + 1.
    ends = chained.filter(success).select("source", (F.col("chain") - 1).alias("chain"), F.col("time").alias("resolved_at"))
    incidents = chained.filter(bad).groupBy("source", "chain").agg(F.count("*").alias("events"), F.min("time").alias("began_at"))
    return incidents.join(ends, ["source", "chain"], "left")


def running_items(logs: DataFrame, segment: str = "month") -> DataFrame:
    """Running total of the items of a source."""
    rows, w = with_carry(logs, {"_before": F.sum("items")}, segment)
    here = F.sum("items").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("running", F.coalesce(here + F.coalesce("_before", F.lit(0)), "_before")).drop("_segment", "_before")
