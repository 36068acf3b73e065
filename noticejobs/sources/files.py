"""Reading, validating, exporting and backing up the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticejobs.functions import scalars as S
from noticejobs.sources.schemas import CATEGORIES, NOTICE, PRIORITIES, STATUSES

CORRUPT = "_corrupt_record"


def read_notices(spark: SparkSession, path: str, fmt: str = "json", schema: str = NOTICE) -> DataFrame:
    """Notices with a fixed schema; for text formats, rows that do not parse carry their text in ``_corrupt_record``."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    wanted = T.StructType.fromDDL(schema)
    if fmt == "csv":  # arrays are JSON text in CSV
        flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in wanted])
        rows = spark.read.schema(flat.add(CORRUPT, T.StringType())).option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)
        return rows.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in wanted], CORRUPT)
    return spark.read.schema(wanted.add(CORRUPT, T.StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull())


def export_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Export as JSON, CSV (arrays as JSON text) or Parquet."""
    if fmt == "csv":
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else f.name for f in df.schema])
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def import_reasons(url: str | None = None, dates: tuple[str, ...] = (), categories: tuple[str, ...] = CATEGORIES, columns: list[str] | None = None) -> Column:
    """Why a row cannot be imported, as an array; empty for a valid row. Of the closed sets of values those of ``columns`` are checked."""
    missing = [F.when(F.coalesce(S.trimmed(c), F.lit("")) == "", f"missing {c}") for c in ("title", "description", "category", "organization")]
    enums = {"category": categories, "priority": PRIORITIES, "status": STATUSES}
    tests = [*missing, *[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*held), f"unknown {c}") for c, held in enums.items() if columns is None or c in columns]]
    if url:
        tests.append(F.when(F.col(url).isNotNull() & ~S.valid_url(url), f"bad {url}"))
    tests += [F.when(F.col(c).isNotNull() & F.col(c).try_cast("timestamp").isNull(), f"bad {c}") for c in dates]
    return F.array_compact(F.array(*tests))


def validate_import(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reasons", import_reasons(columns=df.columns, **rules))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def read_scraped_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path).withColumnRenamed("page_id", "id")


def extract_notice_fields(pages: DataFrame) -> DataFrame:
    """Raw pages as (id, source_url, source_portal, title, body): markup is dropped by a chain of expressions."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?is)<title[^>]*>.*?</title\s*>", " "), r"<[^>]*>", " "), r"\s+", " ")
    return pages.select("id", F.col("url").alias("source_url"), S.source_portal("url").alias("source_portal"), F.trim(title).alias("title"), F.trim(body).alias("body"))


def backup(tables: dict[str, DataFrame], path: str, date: dict[str, str] | None = None) -> None:
    """Write each table as Parquet; those with a timestamp named in ``date`` are partitioned by its day."""
    for name, df in tables.items():
        if date and name in date:
            df.withColumn("backup_day", F.to_date(date[name])).write.mode("overwrite").partitionBy("backup_day").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("backup_day") for n in names}
