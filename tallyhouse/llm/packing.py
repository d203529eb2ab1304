"""Sum-of-squares packing of token sequences.

Documents become token ids and an end id; only longer ones are cut into pieces of the capacity. A piece goes where the sum of
the squared counts of open bins, by residual gap, becomes smallest; ties go to the smaller gap left. Pieces are dealt by hash to
groups that are packed independently, longest piece first; the gaps open at the end of a group (a few of some thousand
sequences) are the price of packing in parallel. Whole-capacity pieces are sequences by themselves.

Text is tokenised by distinct words: the tokenizer's rules never look across white space (tests compare with whole texts). This
holds for the named word vocabulary, which lower-cases and drops white space; it is the only kind that pieces() takes.

Defined cases: a null or empty text is the end id alone. Rows with equal or null doc_id are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W

CAPACITY = 2048
END_ID = 0
#: Documents whose pieces one group packs.
GROUP_DOCS = 8000
TOKENIZER = "word_bpe_49k.json"
_CACHE_WORDS, _CALL_WORDS = 200_000, 20_000


def vocabulary_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file is on the machine that asks: executors look it up for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_AS_TEXT = {bytes([b]).decode("latin-1"): c for b, c in _byte_letters().items()}


def _encoded(tokenizer, words_: list[str]) -> dict[str, list[int]]:
    """Ids of distinct words. A word of Latin letters is one unit of the vocabulary's rules and goes to the merges directly."""
    model, out, rest = tokenizer.model, {}, []
    for word in words_:
        if _LETTERS.fullmatch(word):
            unit = word.lower()
            if not unit.isascii():
                unit = "".join(map(_AS_TEXT.__getitem__, unit.encode().decode("latin-1")))
            out[word] = [t.id for t in model.tokenize(unit)]
        else:
            rest.append(word)
    for k in range(0, len(rest), _CALL_WORDS):
        part = rest[k : k + _CALL_WORDS]
        out.update(zip(part, (e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    return out


def _word_ids(path: str, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all distinct words in a row, and len(distinct) + 1 offsets."""
    tokenizer, cache = _tokenizer(path)
    got = _encoded(tokenizer, [w for w in distinct if w not in cache])
    ids = [got[w] if w in got else cache[w] for w in distinct]
    if len(cache) + len(got) > _CACHE_WORDS:
        cache.clear()
    if len(got) <= _CACHE_WORDS:
        cache.update(got)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(at[-1])), at


def _spaced(texts: pa.Array) -> pa.Array:
    """A to Z in lower case and a space between a Latin letter and a mark: the tokenizer cuts there anyway."""
    data, at = W.byte_view(W.lowered(texts))
    mark, letter, second = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    mark[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{}~")] = True  # without |, which stands in the names of special tokens
    letter[97:123] = True
    second[[b for b in range(128, 192) if b not in (0x97, 0xB7)]] = True  # of letters from U+00C0 to U+00FF
    marks = np.flatnonzero(mark[data])
    marks = marks[marks > 0]
    cut = np.zeros(len(data), bool)
    cut[marks] = letter[data[marks - 1]] | (second[data[marks - 1]] & (data[np.maximum(marks - 2, 0)] == 0xC3))
    cut[at[:-1][at[:-1] < len(data)]] = False
    moved = np.cumsum(cut)
    out = np.full(len(data) + int(moved[-1] if len(moved) else 0), 32, np.uint8)
    out[np.arange(len(data)) + moved] = data
    shift = np.concatenate(([0], moved))[at]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at + shift).tobytes()), pa.py_buffer(out.tobytes()))


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by end_id, in a row; and len(texts) + 1 offsets."""
    found = W.words(_spaced(texts))
    ids, at = _word_ids(path, found.distinct.to_pylist())
    size = np.diff(at)[found.codes]
    ends = np.cumsum(size)
    source = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - at[found.codes], size)
    tokens = ids[source]
    bounds = np.concatenate(([0], ends))[found.bounds]
    n = len(texts)
    out = np.full(len(tokens) + n, end_id, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(tokens)) + doc] = tokens
    return out, bounds + np.arange(n + 1)


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: Callable[[], str] = vocabulary_path, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches):
        for batch in batches:
            for part in W.parts(batch):
                ids, bounds = token_ids(part.column("text"), path(), end_id)
                size = np.diff(bounds)
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                first = bounds[:-1][row] + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([raw[a : a + n] for a, n in zip(first.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    schema = T.StructType([docs.schema["doc_id"]] + T.StructType.fromDDL(PIECE + (", ids array<int>" if keep_ids else "")).fields)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed longest first by the sum-of-squares rule."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    count[0] = count[capacity] = 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        if size == capacity:
            bins[k], used = used, used + 1
            continue
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            left = gaps - size
            change = 2 * (count[left] - count[gaps]) + 2
            change[left == 0] -= 2 * count[0] + 1
            best = int(change.argmin())
            gap = int(gaps[best])
        if not len(gaps):
            target, gap = used, capacity
            used += 1
        else:
            target = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = target, capacity - gap
        if gap > size:
            open_bins[gap - size].append(target)
            count[gap - size] += 1
    return bins, offsets


def pack(found: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() plus sequence_id and offset; sequences never mix groups."""

    def run(key, table):
        bins, offsets = place(table.column("length").to_numpy(), capacity)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array((key[0].as_py() << 40) + bins)).append_column("offset", pa.array(offsets))

    dealt = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, T.StructType([*found.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields]))


def groups_for(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // GROUP_DOCS))


def packed(docs: DataFrame, **how) -> DataFrame:
    return pack(pieces(docs, **how), groups_for(docs), how.get("capacity", CAPACITY))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
