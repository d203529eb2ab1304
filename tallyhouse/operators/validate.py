"""Checks of stored tables: schema, counts, key uniqueness, parity of two results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyhouse.functions.exprs import count_rows


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column listing: (table_name, column_name, data_type, nullable)."""
    rows = [
        (name, field.name, field.dataType.simpleString(), field.nullable)
        for name, df in tables.items()
        for field in df.schema.fields
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def column_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """Column listing with the NULLs found: (table_name, column_name, data_type, nullable, null_count).

    One aggregation per table counts the NULLs of all its columns.
    """
    parts = []
    for name, df in tables.items():
        counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
        listed = F.array(*[
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"), F.col(f"n{i}").alias("null_count"))
            for i, f in enumerate(df.schema.fields)
        ])
        parts.append(counted.select(F.lit(name).alias("table_name"), F.inline(listed)))
    return reduce(DataFrame.unionByName, parts)


def validate_table(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, keys that occur more than once, and rows with a NULL in the key."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per_key = df.groupBy(*key).agg(count_rows().alias("__n"), F.count_if(missing).alias("__null"))
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        count_rows().alias("distinct_keys"),
        F.count_if(F.col("__n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("__null"), F.lit(0)).alias("null_keys"),
    ).select(F.lit(name).alias("table_name"), "row_count", "distinct_keys", "duplicate_keys", "null_keys")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(count_rows().alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def compare_counts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Row counts of two sides over all table names; a missing table counts 0."""
    a = row_counts(left).withColumnRenamed("n", "left_rows")
    b = row_counts(right).withColumnRenamed("n", "right_rows")
    both = a.join(b, "table_name", "full").select(
        "table_name",
        F.coalesce("left_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
    )
    return both.withColumn("differs", F.col("left_rows") != F.col("right_rows"))


def result_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Compare a value by key: equal within the relative tolerance, NULL equals NULL."""
    left = a.select(*keys, F.col(value).cast("double").alias("left_value"), F.lit(True).alias("__l"))
    right = b.select(*keys, F.col(value).cast("double").alias("right_value"), F.lit(True).alias("__r"))
    joined = left.join(right, list(keys), "full")
    x, y = F.col("left_value"), F.col("right_value")
    gap = F.when(x == 0, F.abs(y)).otherwise(F.abs(x - y) / F.abs(x))
    found = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    same = found & F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(gap <= tolerance)
    return joined.select(*keys, "left_value", "right_value", same.alias("matches"))


def _without_decimal(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_decimal(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_without_decimal(kind.keyType), _without_decimal(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_decimal(f.dataType), f.nullable) for f in kind])
    return kind


def decimal_to_double(df: DataFrame) -> DataFrame:
    """Every DECIMAL, also inside arrays, maps and structs, as DOUBLE."""
    return df.select(*[F.col(f.name).cast(_without_decimal(f.dataType)).alias(f.name) for f in df.schema.fields])


def sample_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows, along an order if one is given."""
    return (df.orderBy(*order) if order else df).limit(n)
