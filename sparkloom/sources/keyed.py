"""Tables that are changed by rewriting the buckets that a change touches, and tables that are joined without a shuffle.

A keyed table is a folder of Parquet with a folder for each bucket of its key.
Upserts and deletes read and write the buckets of the keys that they name;
other buckets' files stay as they are. A change that is run twice, or again
after it broke off, leaves what one run leaves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import small
from .scratch import stored

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: str

    def bucket_of(self, key: Column) -> Column:
        return F.coalesce(F.crc32(key.cast("string").cast("binary")) % self.buckets, F.lit(0)).cast("int")

    def files(self, buckets: list[int] | None = None) -> DataFrame:
        """The table with its bucket column; of some buckets only, if they are named."""
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def read(self) -> DataFrame:
        return self.files().drop(BUCKET)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys(key)``, from their buckets only."""
        wanted = keys.select(self.key).distinct()
        named = wanted.withColumnRenamed(self.key, "_wanted")
        return self.files(self._touched(wanted)).join(small(named), F.col(self.key).eqNullSafe(F.col("_wanted")), "left_semi").drop(BUCKET)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())  # as many as there are buckets

    def _put(self, rows: DataFrame, mode: str) -> None:
        placed = rows.withColumn(BUCKET, self.bucket_of(F.col(self.key)))
        writer = placed.repartition(BUCKET).write.mode(mode).partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Rows as they are, whether their keys are there or not."""
        self._put(rows.select(*self.read().columns), "append")

    def upsert(self, rows: DataFrame) -> list[int]:
        """``rows`` in place of the rows of their keys; the buckets that were written."""
        return self._change(rows.select(self.key), rows.select(*self.read().columns))

    def delete(self, keys: DataFrame) -> list[int]:
        """Without the rows of ``keys(key)``; the buckets that were written: those that held any of them."""
        held = self.of(keys).select(self.key)
        return self._change(held, None)

    def _change(self, keys: DataFrame, rows: DataFrame | None) -> list[int]:
        gone = stored(keys.distinct())
        buckets = self._touched(gone)
        if not buckets:
            return []
        # what stays is written beside the table first, so that an overwrite never reads what it replaces
        named = gone.withColumnRenamed(self.key, "_gone")
        left = self.files(buckets).join(small(named), F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti").drop(BUCKET)
        whole = stored(left if rows is None else left.unionByName(rows))
        self._put(whole, "overwrite")
        self._clear(buckets, whole)
        return buckets

    def _clear(self, buckets: list[int], whole: DataFrame) -> None:
        """Buckets of which nothing is left: a dynamic overwrite does not see them, so their folders go."""
        full = {r[0] for r in whole.select(self.bucket_of(F.col(self.key))).distinct().collect()}
        for bucket in set(buckets) - full:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
    """A keyed table of ``rows`` in a folder; null keys have a bucket too."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = KeyedTable(rows.sparkSession, path, key, buckets, schema)
    made._put(rows, "overwrite")
    told = json.dumps({"key": key, "buckets": buckets, "schema": schema})
    rows.sparkSession.range(1).select(F.lit(told)).coalesce(1).write.mode("overwrite").text(f"{path}/_about")
    return made


def open_table(spark: SparkSession, path: str) -> KeyedTable:
    told = json.loads(spark.read.text(f"{path}/_about").first()[0])
    return KeyedTable(spark, path, told["key"], told["buckets"], told["schema"])


def cascade(tables: dict[str, KeyedTable], keys: DataFrame, column: str) -> dict[str, list[int]]:
    """A delete of ``keys(column)`` over several tables, in their order; the buckets that were written of each."""
    return {name: t.delete(keys.select(F.col(column).alias(t.key))) for name, t in tables.items()}


def bucketed(rows: DataFrame, name: str, key: str, path: str, buckets: int = 64) -> DataFrame:
    """``rows`` as a table of the catalog in sorted buckets of ``key``: two of them with as many buckets are joined on it without a shuffle."""
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)
