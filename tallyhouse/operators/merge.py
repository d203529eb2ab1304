"""Merging and upserting tables. Results are new DataFrames: write them to a new path and swap, never
over a path the same plan reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions import ordered
from tallyhouse.functions.exprs import count_rows, only_value


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first along ``order``; copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def new_rows(target: DataFrame | None, source: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks; of several with one key the first loaded wins."""
    deduplicated = first_per_key(source, key, order)
    return deduplicated if target is None else deduplicated.join(target.select(*key), list(key), "left_anti")


def merge_insert_new(
    target: DataFrame | None, source: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Target plus the new rows of the source; without a target the source creates the table."""
    added = new_rows(target, source, key, order)
    return added if target is None else target.unionByName(added.select(*target.columns))


def merge_counts(target: DataFrame, source: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What a merge would do, without doing it."""
    return (
        target.agg(count_rows().alias("target_rows"))
        .withColumn("source_rows", only_value(source.agg(count_rows())))
        .withColumn("new_rows", only_value(new_rows(target, source, key, order).agg(count_rows())))
    )


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Insert unseen keys, and for known keys take the chosen columns from the source (NULLs too).

    The source holds one row per key (see ``last_per_key``).
    """
    present = source.select(*key, *[F.col(c).alias(f"__s_{c}") for c in columns], F.lit(True).alias("__new"))
    kept = target.select(*key, *[F.col(c).alias(f"__t_{c}") for c in target.columns if c not in key])
    joined = kept.join(present, list(key), "full")
    fresh = F.coalesce("__new", F.lit(False))
    return joined.select(
        *[
            F.col(c)
            if c in key
            else F.when(fresh, F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}")).alias(c)
            if c in columns
            else F.col(f"__t_{c}").alias(c)
            for c in target.columns
        ]
    )


def next_ids(existing: DataFrame, id_column: str, rows: DataFrame, order: str, start: int = 10_000) -> DataFrame:
    """Ids above every existing one (and above ``start``), consecutive along a numeric ``order`` column.

    Rows are numbered in ranges of the order column, so no task sees the whole table.
    """
    top = existing.agg(F.greatest(F.coalesce(F.max(id_column), F.lit(0)), F.lit(start)).alias("__top"))
    numbered = ordered.row_numbers(rows, [], [order], "__n")
    return numbered.withColumn("new_id", only_value(top) + F.col("__n")).drop("__n")


ORDER_ITEMS = "array<struct<sku:bigint,qty:int,price:double>>"


def complete_orders(batch: DataFrame) -> dict[str, DataFrame]:
    """Header, item and payment rows of a batch of orders, all under the id of the order."""
    parsed = batch.withColumn("__items", F.from_json("items", ORDER_ITEMS))
    lines = parsed.select("order_id", F.posexplode("__items").alias("__p", "__i")).select(
        "order_id",
        (F.col("__p") + 1).alias("line"),
        F.col("__i.sku").alias("sku"),
        F.coalesce("__i.qty", F.lit(1)).alias("quantity"),
        F.col("__i.price").alias("unit_price"),
        F.round(F.coalesce("__i.qty", F.lit(1)) * F.coalesce("__i.price", F.lit(0.0)), 4).alias("subtotal"),
    )
    # The total folds the array in place, so header and payment need no shuffle.
    amount = F.round(
        F.aggregate(
            "__items",
            F.lit(0.0),
            lambda acc, x: acc + F.coalesce(x["qty"], F.lit(1)) * F.coalesce(x["price"], F.lit(0.0)),
        ),
        2,
    )
    header = parsed.select("order_id", "customer_id", amount.alias("total_amount"), F.lit("pending").alias("status"))
    payment = parsed.select(
        "order_id", amount.alias("amount"), "payment_method", F.lit("authorized").alias("status")
    )
    return {"orders": header, "order_items": lines, "payments": payment}
