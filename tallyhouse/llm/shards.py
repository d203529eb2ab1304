"""Questions about keys that occur anywhere, asked by shards of documents.

Documents are dealt to shards of bounded text. A shard sorts its distinct 64-bit keys and cuts them at fixed borders into key
ranges; one row per shard and range crosses the shuffle. The task of a range merges the sorted keys of all shards and returns to
each shard one answer per key, in the shard's order. A key that a third of all documents holds is one entry per shard, so no range
grows with a group of copies, and neither keys nor answers ever pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import runs as R

#: Text bytes of a shard, about. A longer document has a shard to itself or shares one.
SHARD_BYTES = 8 << 20
ROWS = "range int, shard int, keys binary, extra binary"
ANSWERS = "shard int, range int, data binary"


def text_mark(text: str = "text") -> Column:
    """Tells apart texts under one doc_id, or under none: 128 bits of a cryptographic digest; no bytes for a null text."""
    return F.coalesce(F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16), F.lit(b""))


def sharded(docs: DataFrame, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, mark, text) and the columns to carry along, dealt by `shard`; and the number of shards."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("text"), F.count("*").alias("rows")).first()
    shards = max(1, -(-((size.text or 0) + 16 * size.rows) // shard_bytes))
    marked = docs.select("doc_id", text_mark().alias("mark"), "text", *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    return marked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(shards)).cast("int")).repartition(shards, "shard"), shards


def planes(values: np.ndarray, width: int | None = None) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, lowest bytes first, byte position by byte position."""
    values = np.ascontiguousarray(values, "<u8")
    width = width or max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    width, n = data[0], (len(data) - 1) // data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def packed(values: np.ndarray) -> bytes:
    """planes, compressed: for counts, most of which are small."""
    data = planes(values)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    return unplaned(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def borders(ranges: int) -> np.ndarray:
    """First key of each range but the first."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins and ends in sorted keys: ranges + 1 places, found by binary search."""
    return np.concatenate(([0], np.searchsorted(keys, borders(ranges)), [len(keys)])).astype(np.int64)


def question(shard: int, keys: np.ndarray, extra: Callable[[slice], bytes], ranges: int) -> pa.Table:
    """One row per key range in which the shard has keys."""
    at = cut(keys, ranges)
    found = [(k, slice(int(at[k]), int(at[k + 1]))) for k in range(ranges) if at[k + 1] > at[k]]
    return pa.table(
        {
            "range": pa.array([k for k, _ in found], pa.int32()),
            "shard": pa.array([shard] * len(found), pa.int32()),
            "keys": pa.array([deltas(keys[s]) for _, s in found], pa.binary()),
            "extra": pa.array([extra(s) for _, s in found], pa.binary()),
        }
    )


def answered(questions: DataFrame, answer: Callable[[list[np.ndarray], list[bytes]], list[np.ndarray]], write=planes) -> DataFrame:
    """ANSWERS rows: `answer` gets the sorted keys and extras of the shards in one range, by shard and so the same in a repeated task, and
    gives a whole number per key and shard, which `write` turns into bytes."""

    def run(key, table):
        order, keys, extras = np.argsort(table.column("shard").to_numpy()), table.column("keys"), table.column("extra")
        found = answer([undeltas(keys[k].as_py()) for k in order.tolist()], [extras[k].as_py() for k in order.tolist()])
        return pa.table({"shard": table.column("shard").take(pa.array(order)), "range": table.column("range"), "data": pa.array([write(a) for a in found], pa.binary())})

    return questions.groupBy("range").applyInArrow(R.lean(run), ANSWERS)


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the keys of all shards in a row: the place of each among the distinct keys; and the distinct keys."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return place, distinct


def parted(values: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(k) for k in keys])[:-1])


def gathered(table: pa.Table, keys: int, parts: int = 1, read=unplaned) -> np.ndarray:
    """The answers to all of a shard's keys, in order; where an answer has several parts, they are rows."""
    rows = sorted(zip(table.column("range").to_pylist(), table.column("data").to_pylist(), strict=True))
    out = np.concatenate([read(d).reshape(parts, -1) for _, d in rows], axis=1) if rows else np.zeros((parts, 0), np.uint64)
    if out.shape[1] != keys:
        raise ValueError(f"{out.shape[1]} answers to {keys} keys")
    return out[0] if parts == 1 else out
