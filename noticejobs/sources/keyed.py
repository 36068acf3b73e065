"""A stored table with one row a key: upserts rewrite the partitions that they touch, and shuffle the changes alone.

Rows are dealt by a hash of the key to partitions (folders), and within a partition to buckets, each sorted by key. Changes are dealt
likewise, so base and changes are joined bucket by bucket without an exchange of the base. Only the partitions of
changed keys are read, and dynamic partition overwrite replaces only these; the new files appear when the job commits. A deleted key
stays as a row that is marked, so that an older change which arrives late does not bring it back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, GONE = "_part", "_gone"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


@dataclass
class KeyedTable:
    spark: SparkSession
    #: Name in the session's catalog.
    name: str
    key: str
    #: The newest row of a key is the one with the largest values of these columns, nulls least.
    order: tuple[str, ...]
    parts: int = 16
    buckets: int = 8

    @classmethod
    def create(cls, rows: DataFrame, name: str, key: str, order: tuple[str, ...], path: str, parts: int = 16, buckets: int = 8) -> KeyedTable:
        """Store the newest row of each key of ``rows`` at ``path``; rows without a key are left out."""
        table = cls(rows.sparkSession, name, key, order, parts, buckets)
        dealt = table.newest(rows).withColumn(GONE, F.lit(False)).withColumn(PART, table.part_of()).repartition(buckets, key)
        dealt.write.format("parquet").partitionBy(PART).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        return table

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(*[F.desc_nulls_last(c) for c in self.order])
        return rows.filter(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).filter(~F.col(GONE)).drop(GONE, PART)

    def merged(self, changes: DataFrame, delete: str | None = None) -> DataFrame:
        """The rows of the touched partitions as they shall be. A change whose column ``delete`` is true takes its key away."""
        columns = self.spark.table(self.name).columns
        gone = F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False)
        fresh = self.newest(changes).withColumn(GONE, gone).withColumn(PART, self.part_of())
        touched = [r[0] for r in fresh.select(PART).distinct().collect()]  # numbers below ``parts``
        new = fresh.select(F.struct(*columns).alias("new"), F.col(self.key).alias("_new")).repartition(self.buckets, "_new")
        base = self.spark.table(self.name).filter(F.col(PART).isin(touched) if touched else F.lit(False))
        base = base.select(F.struct(*columns).alias("old"), F.col(self.key).alias("_old"))
        rank = lambda side: F.struct(*[x for c in self.order for x in (F.col(f"{side}.{c}").isNotNull(), F.col(f"{side}.{c}"))])
        both = base.join(new, F.col("_old") == F.col("_new"), "full_outer")
        wins = F.col("_new").isNotNull() & (F.col("_old").isNull() | (rank("new") >= rank("old")))
        return both.select(F.when(wins, F.col("new")).otherwise(F.col("old")).alias("row")).select("row.*")

    def upsert(self, changes: DataFrame, delete: str | None = None) -> None:
        """Changes with the columns of the table; of a key's rows, old and new, the newest stays."""
        rows, conf = self.merged(changes, delete), self.spark.conf
        before = conf.get(OVERWRITE)
        conf.set(OVERWRITE, "dynamic")  # an option of the writer would not do for a table that the rows are read from
        try:
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(OVERWRITE, before)
        self.spark.catalog.refreshTable(self.name)
