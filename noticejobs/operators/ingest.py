"""Feeds into one table: union, upserts, change feeds, versions, decisions, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S


def unified_feed(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def latest_version(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key; rows without a key are each kept."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    w = Window.partitionBy("_key").orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_key", own).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def upsert_scraped(existing: DataFrame, scraped: DataFrame) -> DataFrame:
    """One row per source_url, that of the newest scrape."""
    return latest_version(unified_feed(existing, scraped), "source_url", "scraped_at", "id")


def new_since(existing: DataFrame, scraped: DataFrame, key: str = "source_url") -> DataFrame:
    return scraped.join(existing.select(key).distinct(), key, "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """changes: op (add, patch, delete, toggle), seq and the columns of base (null: unchanged). A toggle flips
    ``enabled``. Changes of a key apply in order of seq; adds and patches set what they carry."""
    columns = [c for c in base.columns if c != key]
    feed = base.withColumns({"op": F.lit("add"), "seq": F.lit(-1).cast("long")}).unionByName(changes.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    # What came before the last delete of a key is gone.
    cut = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(key))
    feed = feed.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull() & (F.col("op") != "toggle"), F.col("seq"))).alias(c)
    if "enabled" not in columns:
        return feed.groupBy(key).agg(F.count_if(F.col("op") != "toggle").alias("_set"), *map(last, columns)).filter("_set > 0").drop("_set").select(*base.columns)
    set_at = F.max(F.when(F.col("enabled").isNotNull() & (F.col("op") != "toggle"), F.col("seq"))).over(Window.partitionBy(key))
    feed = feed.withColumn("_flip", (F.col("op") == "toggle") & (F.col("seq") > F.coalesce(set_at, F.lit(-1))))
    out = feed.groupBy(key).agg(F.count_if(F.col("op") != "toggle").alias("_set"), F.count_if("_flip").alias("_flips"), *map(last, columns)).filter("_set > 0")
    flipped = F.when(F.col("_flips") % 2 == 1, ~F.col("enabled")).otherwise(F.col("enabled"))
    return out.withColumn("enabled", flipped).select(*base.columns)


def edit_history(versions: DataFrame, key: str, ts: str, tracked: tuple[str, ...]) -> DataFrame:
    """Number, validity and changed columns of every version."""
    w = Window.partitionBy(key).orderBy(ts)
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), c) for c in tracked]))
    number = F.row_number().over(w)
    return versions.withColumns({"version": number, "valid_from": F.col(ts), "valid_to": F.lead(ts).over(w), "changed": F.when(number == 1, F.array().cast("array<string>")).otherwise(changed)})


def notice_as_of(history: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The version of edit_history that is valid at each wanted (key, t)."""
    h = history.withColumnRenamed(key, "_k")
    valid = (wanted[key] == h["_k"]) & (h["valid_from"] <= wanted["t"]) & (h["valid_to"].isNull() | (wanted["t"] < h["valid_to"]))
    return wanted.join(h, valid).drop("_k")


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Moderation in bulk: the decision's status and category replace the item's."""
    d = decisions.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("category").alias("_category"))
    out = queue.join(d, F.col("id") == F.col("_id"), "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "category": F.coalesce("_category", "category")}).drop("_id", "_status", "_category")


def reassign_category(df: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, F.col("category") == F.col("_old"), "left").withColumn("category", F.coalesce("_new", "category")).drop("_old", "_new")


def map_source_category(scraped: DataFrame, sources: DataFrame) -> DataFrame:
    """A scraped row takes category and portal name of the source with its host."""
    s = sources.select(S.source_portal("url").alias("_host"), F.col("category").alias("source_category"), F.col("name").alias("source_name"))
    return scraped.join(s, S.source_portal("source_url") == F.col("_host"), "left").drop("_host")


def notice_documents(notices: DataFrame, attachments: DataFrame) -> DataFrame:
    a = attachments.select(F.col("notice_id").alias("_n"), F.col("id").alias("attachment_id"), "filename", "size_bytes")
    return notices.join(a, F.col("id") == F.col("_n"), "left").drop("_n")


def reconcile(a: DataFrame, b: DataFrame, key: str, compared: tuple[str, ...]) -> DataFrame:
    """Rows of two registries: same, changed (with the columns), only in a, only in b."""
    left, right = a.select(F.col(key).alias("_l"), F.struct(*compared).alias("l")), b.select(F.col(key).alias("_r"), F.struct(*compared).alias("r"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in compared]))
    state = F.when(F.col("_r").isNull(), "only_a").when(F.col("_l").isNull(), "only_b").when(F.size(differs) > 0, "changed").otherwise("same")
    out = left.join(right, F.col("_l") == F.col("_r"), "full_outer")
    return out.select(F.coalesce("_l", "_r").alias(key), state.alias("state"), F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.array_join(differs, ",")).otherwise("").alias("changed"))


def localize(df: DataFrame, key_col: str, lang: str, translations: DataFrame) -> DataFrame:
    """Label of a key in a language, else the key itself; an empty label counts as none."""
    t = translations.filter(F.col("lang") == lang).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return df.join(t, F.col(key_col) == F.col("_key"), "left").withColumn("label", F.coalesce(F.nullif("_value", F.lit("")), key_col)).drop("_key", "_value")
