"""Reading and writing relational tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def export_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_relational(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch: int = 5000) -> None:
    """Create the table from the schema if needed, empty it and load it over JDBC.

    ``truncate`` keeps the table with its grants and indexes; each partition is one connection.
    """
    df.write.mode("overwrite").option("truncate", "true").option("batchsize", str(batch)).jdbc(
        url, table, properties=properties or {}
    )


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a parquet table and read it back with the same schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one per line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
