"""Keyed parquet tables in hash buckets, changed bucket by bucket.

A row lives in the folder of its key's hash bucket. An upsert reads, joins and overwrites only the buckets that hold changed keys
(dynamic partition overwrite), so a small batch costs a small part of the table. The number of buckets stands in the name of the
partition column; a batch that touches every bucket costs one rewrite, as without buckets.

New files are staged and moved in when all tasks are done, so a lost executor only repeats its tasks. Applying the same batch again
gives the same table: repeat the call when a driver died while moving.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyhouse.operators import merge


@dataclass(frozen=True)
class BucketTable:
    """Table at ``path`` with the columns of ``schema``, one row per ``key``. Choose ``buckets`` so that one holds about a gigabyte."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64

    @property
    def column(self) -> str:
        return f"bucket_of_{self.buckets}"

    def _bucket(self) -> Column:
        # The hash depends on the type, so a batch's keys are taken in the type of the table.
        keys = [F.col(k).cast(self.schema[k].dataType) for k in self.key]
        return F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, self._bucket())

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Rebalancing gathers a bucket's rows, and cuts a bucket that is too large for one file.
        writer = rows.hint("rebalance", F.col(self.column)).write.mode(mode).partitionBy(self.column)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, df: DataFrame) -> BucketTable:
        """Store the first rows; the path must be new. No rows give an empty table."""
        self._write(self._placed(df.select(*self.schema.fieldNames())), "error")
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(self.column)

    def touched(self, batch: DataFrame) -> list[int]:
        """Numbers of the buckets a batch changes: at most ``buckets`` of them."""
        return sorted(r[0] for r in self._placed(batch).select(self.column).distinct().collect())

    def of(self, spark: SparkSession, numbers: Sequence[int]) -> DataFrame:
        """Rows of some buckets; the scan opens no other folder."""
        return self._stored(spark).filter(F.col(self.column).isin(list(numbers)))

    def upsert(self, batch: DataFrame, columns: Sequence[str]) -> BucketTable:
        """Insert unseen keys, and for known keys take ``columns`` from the batch, which holds one row per key and gives the
        same rows whenever it is read. Buckets without a key of the batch stay as they are."""
        spark = batch.sparkSession
        numbers = self.touched(batch)
        if numbers:
            changes = self._placed(batch.select(*self.key, *columns))
            self._write(merge.upsert(self.of(spark, numbers), changes, [self.column, *self.key], columns), "overwrite")
        return self

    def insert_new(self, source: DataFrame, order: Sequence[str]) -> BucketTable:
        """Append the rows whose key the table lacks, the first along ``order`` for each; stored files stay untouched."""
        spark = source.sparkSession
        numbers = self.touched(source)
        if numbers:
            rows = self._placed(source.select(*self.schema.fieldNames()))
            self._write(merge.new_rows(self.of(spark, numbers), rows, [self.column, *self.key], order), "append")
        return self
