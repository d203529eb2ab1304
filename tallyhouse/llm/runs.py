"""Work on all rows of a key by sorted streaming, and connected components of a graph in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.session import scratch_dir


def by_key(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """`run` over the rows of each key. Small keys cost no task or group of their own, as rows stream sorted by key."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            held.clear()
            if (found := run(table)) is not None and found.num_rows:
                yield from found.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
            if held:
                new[0] = any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
            cuts = np.flatnonzero(new).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and new[a]:
                    yield from flush()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()
        W.released()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def lean(run: Callable, tables: int = 1) -> Callable:
    """A function of a group (of one table, or two that meet) that leaves no memory behind."""

    def one(key, table):
        found = run(key, table)
        W.released()
        return found

    def two(key, left, right):
        found = run(key, left, right)
        W.released()
        return found

    return one if tables == 1 else two


def lean_stream(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a stream of batches that leaves no memory behind."""

    def stream(batches):
        yield from run(batches)
        W.released()

    return stream


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read again: no lineage, and nothing lost with an executor."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of links (a, b), the smallest node it is connected with. Alternates large and small stars."""
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.*").where("a <> b").distinct(), "links")
        if _mark(after) == _mark(edges):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = after


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())
