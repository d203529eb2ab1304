"""Ordered calculations that do not put a whole key into one task: parallel prefix scans.

A plain window over ``PARTITION BY key ORDER BY t`` sorts all rows of a key in a single task, so one key that holds a third of the
table stalls the job. Here rows are dealt by ranges of (key, order), so that a key takes as many partitions as it needs; work
inside a part of a key runs in parallel, one small row per part and key carries the result across parts, and a join puts both
together. The answer equals the plain window, only the parallelism differs.

Running sums deal only the keys that do not fit into one task (more than TASK_ROWS rows) this way. All other rows are exchanged once, in
as many partitions as their number asks for, and what is joined by the same keys meets them there. Rows per key are counted first.

The dealt rows are written to the shared folder once, when the calculation is asked for: the parts' totals and the rows must see the
same borders, which Spark samples anew for each plan, and a lost executor costs no recomputation. Rows that are equal in key and
order stay in one part, so an order without ties splits any key.

Key and part travel as one struct column: struct equality treats NULL fields as equal, and the window, the aggregation and the
join then share one hash partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyhouse.session import scratch_dir

PART, SLOT = "__part", "__slot"

#: Rows that one task sorts. A key with more of them is cut into parts.
TASK_ROWS = 500_000


def tasks(rows: int, most: int = TASK_ROWS) -> int:
    """Partitions that rows without larger keys need."""
    return max(1, -(-rows // most))


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows in ranges of (keys, order), with the number of their range: a higher number comes later."""
    rows = df.repartitionByRange(*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order])
    path = scratch_dir(df.sparkSession, "dealt")
    rows.withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path).withColumn(SLOT, F.struct(*keys, PART))


def _carry(per_part: DataFrame, keys: Sequence[str], before: Column) -> DataFrame:
    return per_part.select(F.struct(*keys, PART).alias(SLOT), before.alias("__before"))


def _earlier(keys: Sequence[str]):
    """Over the parts of a key: at most as many rows as there are partitions."""
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str) -> DataFrame:
    """Running total of ``value`` along ``order`` within ``keys``."""
    return running_sums(df, keys, order, {out: value})


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, str],
    beside: DataFrame | None = None, how: str = "left", most: int = TASK_ROWS,
) -> DataFrame:
    """Running totals (new column -> value) along ``order`` within ``keys``; then the rows of ``beside`` joined by ``keys``."""
    if not keys:
        return _scanned(df, keys, order, sums)
    slot = F.struct(*keys)
    counts = df.groupBy(slot.alias(SLOT)).agg(F.count(F.lit(1)).alias("__n"))
    # One row; the list has at most one key for each TASK_ROWS rows.
    found = counts.agg(
        F.sum(F.when(F.col("__n") <= most, F.col("__n"))).alias("rows"),
        F.collect_list(F.when(F.col("__n") > most, F.col(SLOT))).alias("large"),
    ).first()
    n = tasks(found["rows"] or 0, most)
    large = df.sparkSession.createDataFrame([(k,) for k in found["large"]], counts.select(SLOT).schema) if found["large"] else None
    rows = df.join(F.broadcast(large), slot == F.col(SLOT), "left_anti") if large is not None else df
    rows = rows.repartition(n, *keys)
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({out: F.coalesce(F.sum(value).over(inside), F.lit(0)) for out, value in sums.items()})
    if beside is not None:
        rows = rows.join(beside.repartition(n, *keys), list(keys), how)
    if large is None:
        return rows
    cut = _scanned(df.join(F.broadcast(large), slot == F.col(SLOT), "left_semi"), keys, order, sums)
    return rows.unionByName(cut if beside is None else cut.join(beside, list(keys), how))


def _scanned(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, str]) -> DataFrame:
    """Running totals of keys of any size, as prefix scans."""
    rows = _dealt(df, keys, order)
    parts = rows.groupBy(*keys, PART).agg(*(F.sum(value).alias(f"__s_{out}") for out, value in sums.items()))
    before = F.struct(*(F.coalesce(F.sum(f"__s_{out}").over(_earlier(keys)), F.lit(0)).alias(out) for out in sums))
    carry = _carry(parts, keys, before)
    inside = W.partitionBy(SLOT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__in_{out}": F.coalesce(F.sum(value).over(inside), F.lit(0)) for out, value in sums.items()})
    joined = rows.join(carry, SLOT).withColumns({out: F.col(f"__before.{out}") + F.col(f"__in_{out}") for out in sums})
    return joined.drop(PART, SLOT, "__before", *(f"__in_{out}" for out in sums))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """1, 2, 3, ... along ``order`` within ``keys``, or over the whole table without keys."""
    return running_sum(df.withColumn("__one", F.lit(1)), keys, order, "__one", out).drop("__one")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the row before, along ``order`` within ``keys`` (NULL for the first row)."""
    rows = _dealt(df, keys, order)
    # A struct keeps "no earlier part" apart from an earlier value that is NULL.
    last = rows.groupBy(*keys, PART).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    carry = _carry(last, keys, F.lag("__last").over(W.partitionBy(*keys).orderBy(PART)))
    inside = W.partitionBy(SLOT).orderBy(*order)
    rows = rows.withColumn("__prev", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    joined = rows.join(carry, SLOT).withColumn(out, F.when(F.col("__first"), F.col("__before.v")).otherwise(F.col("__prev")))
    return joined.drop(PART, SLOT, "__prev", "__first", "__before")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. Spark turns the filter on the rank into a group limit that
    every task applies before the shuffle, so a hot key sends at most tasks x n rows to one place
    (up to n = spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default)."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)
