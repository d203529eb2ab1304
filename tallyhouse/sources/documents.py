"""JSON document collections: (id, partition_key, data) rows, NDJSON export and import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyhouse.operators import merge
from tallyhouse.sources.buckets import BucketTable

# Fields that can name the partition of a document, the first present one wins.
PARTITION_FIELDS = ("customerId", "cartId", "orderId", "order_id", "sku", "customer_id", "id")


def partition_key(data: str = "data") -> Column:
    found = [F.get_json_object(data, f"$.{name}") for name in PARTITION_FIELDS]
    return F.coalesce(*found, F.lit(""))


def to_documents(df: DataFrame, id_column: str) -> DataFrame:
    """Rows as documents: the whole row becomes the JSON, its id and partition stay beside it."""
    body = F.to_json(F.struct(*df.columns))
    rows = df.select(F.col(id_column).cast("string").alias("id"), body.alias("data"))
    return rows.select("id", partition_key().alias("partition_key"), "data")


def read_documents(collection: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Documents with a declared schema as columns."""
    return collection.select("id", F.from_json("data", schema).alias("d")).select("id", "d.*")


def document_query(collection: DataFrame, where: dict[str, str], select: list[str]) -> DataFrame:
    """Documents whose fields equal the given texts; an absent field compares as empty text and
    comes out as NULL."""
    tests = [F.coalesce(F.get_json_object("data", f"$.{f}"), F.lit("")) == F.lit(v) for f, v in where.items()]
    kept = collection.filter(reduce(lambda a, b: a & b, tests)) if tests else collection
    return kept.select(*[F.get_json_object("data", f"$.{f}").alias(f.replace(".", "_")) for f in select])


def _member(name: str) -> Column:
    """``"name":"value"`` of a column, unless the document already has the field."""
    text = F.to_json(F.struct(name))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(F.get_json_object("data", f"$.{name}").isNull(), inner)


def json_lines(collection: DataFrame) -> DataFrame:
    """Documents with their id and partition put back at the top level, one JSON text per row."""
    body = F.nullif(F.regexp_replace("data", r"^\s*\{\s*|\s*\}\s*$", ""), F.lit(""))
    members = F.concat_ws(",", _member("id"), _member("partition_key"), body)
    return collection.select(F.concat(F.lit("{"), members, F.lit("}")).alias("value"))


def export_documents(collection: DataFrame, path: str) -> None:
    json_lines(collection).write.mode("overwrite").text(path)


def import_ndjson(spark: SparkSession, path: str, target: DataFrame | None = None) -> DataFrame:
    """Upsert NDJSON lines into a collection; blank and unparsable lines are skipped.

    Every line is kept as text; only id and partition are taken out of it. Of several lines with one
    id the greatest text wins, which makes the result independent of the order of the files.
    """
    rows = ndjson_rows(spark, path)
    return rows if target is None else merge.upsert(target, rows, ["id"], ["partition_key", "data"])


def import_into(table: BucketTable, spark: SparkSession, path: str) -> BucketTable:
    """The same into a stored collection: only the hash buckets of the imported ids are read and written."""
    return table.upsert(ndjson_rows(spark, path), ["partition_key", "data"])


def ndjson_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, partition_key, data) of NDJSON lines, one row per id."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("data"))
    rows = parsed.filter("id IS NOT NULL").select("id", partition_key().alias("partition_key"), "data")
    return merge.last_per_key(rows, ["id"], ["data"])
