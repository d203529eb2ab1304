"""Words of whole texts as numpy arrays, one Arrow batch at a time.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Codes of
distinct words are exact; hashes are 64 bits wide. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multiplier of polynomial hashes modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


class Words(NamedTuple):
    """Words of a batch: text i has codes[bounds[i]:bounds[i + 1]]; code k stands for distinct[k]."""

    bounds: np.ndarray
    codes: np.ndarray
    distinct: pa.Array


def released() -> None:
    """Give memory of finished work back to the system: a worker process outlives its tasks and waits beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and len(texts) + 1 offsets. Null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(texts: pa.Array) -> pa.Array:
    """A to Z in lower case, all else unchanged."""
    return pc.ascii_lower(texts)


def words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    values = lists.flatten()
    real = pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(real)))
    bounds = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = values.filter(pa.array(real)).dictionary_encode()
    return Words(bounds.astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def hashes(distinct: pa.Array) -> np.ndarray:
    """One 64-bit hash for each distinct word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` consecutive 64-bit values: equal windows have equal hashes."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, n - width + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64 bits over all of them; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of `width` words lies within one text."""
    n = int(bounds[-1])
    valid = np.ones(max(0, n - width + 1), bool)
    for cut in range(1, width):  # windows that begin before a boundary and end behind it
        at = bounds[1:-1] - cut
        valid[at[(at >= 0) & (at < len(valid))]] = False
    return np.flatnonzero(valid)


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22):
    """Slices of a batch with about `most` bytes of text each; one text is never cut."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    share = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def joined(found: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    at = np.concatenate(([0], np.cumsum(keep)))[found.bounds]
    kept = found.distinct.take(pa.array(found.codes[keep])).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), kept)
    return pc.binary_join(lists, " ")
