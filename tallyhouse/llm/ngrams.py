"""Language-model scores by deleted interpolation.

P(w | v) = a * c(v w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1): maximum-likelihood estimates of bigrams and single tokens and
a uniform share, mixed with weights that depend on how often the context v occurs (one bucket per doubling of c(v)).

1. Shards ask for the training counts of their distinct tokens and bigrams. Counts come in two parts: those of training texts kept
   for estimates and those of one training text in FOLDS, held out for the weights.
2. Each held-out token's estimates, from the kept counts alone, go into a histogram by bucket and by the logarithms of its two
   estimates (STEPS classes per doubling), whose size does not depend on the corpus. Expectation-maximisation on these held-out counts
   gives the weights.
3. Every text is scored with the counts of all training texts.

Texts are read whole, A to Z in lower case; the tokens of a text are its words and one end token, before them stands a start mark
that is context only. Defined cases: a null text is the end token alone. Without training texts every token is unknown. Rows that
share a doc_id and a text are scored, and counted, each for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import runs as R
from tallyhouse.llm import shards as S
from tallyhouse.llm import words as W
from tallyhouse.llm.language import held_out

FOLDS = 10
STEPS = 8
BUCKETS = 65
ROUNDS = 60
#: Least weight of the uniform share: an unknown token has a probability in every bucket.
LEAST = 1e-6
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xDA942042E4DD58B5)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per doubling."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


class Tokens:
    """A shard's token and bigram keys."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table
        texts = table.column("text")
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else pa.array([], pa.string())
        found = W.words(W.lowered(texts))
        n = table.num_rows
        self.bounds = found.bounds + np.arange(n + 1)
        text = np.repeat(np.arange(n), np.diff(found.bounds))
        token = np.full(len(found.codes) + n, END, np.uint64)
        token[np.arange(len(found.codes)) + text] = W.hashes(found.distinct)[found.codes]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.bounds[:-1]] = START
        self.first = self.bounds[:-1]
        train = np.array(table.column("carried_0").to_pylist(), bool)
        fold = np.array([x.is_valid and zlib.crc32(x.as_buffer()) % FOLDS == 0 for x in table.column("text")], bool) & train
        self.train, self.fold = np.repeat(train, np.diff(self.bounds)), np.repeat(fold, np.diff(self.bounds))
        single, pair = W.mixed(token), W.mixed(W.mixed(before) * _PAIR + token)
        self.keys, place = np.unique(np.concatenate((single, pair, W.mixed(np.array([START])))), return_inverse=True)
        self.single, self.pair, self.start = place[: len(single)], place[len(single) : -1], place[-1]
        self.is_single = np.zeros(len(self.keys), bool)
        self.is_single[self.single] = True
        kept = np.concatenate((self.train & ~self.fold,) * 2)
        held = np.concatenate((self.fold,) * 2)
        self.kept = np.bincount(place[:-1][kept], minlength=len(self.keys))
        self.held = np.bincount(place[:-1][held], minlength=len(self.keys))
        self.kept[self.start] += int((train & ~fold).sum())
        self.held[self.start] += int(fold.sum())

    def contexts(self, count: np.ndarray) -> np.ndarray:
        """Of each token, how often its context occurs."""
        own = count[self.single]
        out = np.empty_like(own)
        out[1:] = own[:-1]
        out[self.first] = count[self.start]
        return out


def _totals(keys: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """For each shard and key: kept count, held-out count, and 1 in the first shard that has the key."""
    place, distinct = S.merged(keys)
    both = [S.unpacked(x).reshape(2, -1) for x in extras]
    sums = [np.bincount(place, np.concatenate([b[k] for b in both]).astype(np.float64), len(distinct)).astype(np.uint64) for k in range(2)]
    owner = np.zeros(len(place), np.uint64)
    owner[np.unique(place, return_index=True)[1]] = 1
    parts = zip(S.parted(sums[0][place], keys), S.parted(sums[1][place], keys), S.parted(owner, keys), strict=True)
    return [np.concatenate(p) for p in parts]


FOUND = "held_out boolean, n_tokens long, n_known long, known_score double, counts binary, class long, times long"
TOKENS, VOCABULARY, KEPT = -1, -2, -3


def _levels(value: np.ndarray) -> np.ndarray:
    """Class of a positive number by its logarithm; 0 for zero."""
    return np.where(value > 0, np.round(np.log2(np.maximum(value, 1e-300)) * STEPS) + 64 * STEPS + 1, 0).astype(np.int64)


def _value(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - 1 - 64 * STEPS) / STEPS), 0)


_SPAN = 128 * STEPS + 2


def counted(docs: DataFrame, shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """doc_id, mark and FOUND: a row per text with its tokens' counts, and rows without them for the histogram and the totals."""
    rows, shards = S.sharded(docs, shard_bytes, carry=("train",))

    def ask(key, table):
        t = Tokens(table)
        return S.question(key[0].as_py(), t.keys, lambda s: S.packed(np.concatenate((t.kept[s], t.held[s]))), shards)

    def look(key, table, answers):
        t = Tokens(table)
        kept, held, owner = S.gathered(answers.combine_chunks(), len(t.keys), 3, S.unpacked).astype(np.int64)
        total = kept + held
        single, pair = total[t.single], total[t.pair]
        known = single > 0
        log = np.concatenate(([0.0], np.cumsum(np.log10(single + 1.0))))
        seen = np.concatenate(([0], np.cumsum(known)))
        texts = table.num_rows
        counts = [S.planes(np.concatenate(([total[t.start]], single[a:b], pair[a:b]))) for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
        f = t.fold
        context = t.contexts(kept)[f]
        share = np.where(context > 0, kept[t.pair][f] / np.maximum(context, 1), 0)
        code = (bucket(context) * _SPAN + _levels(share)) * _SPAN + _levels(kept[t.single][f])
        classes, times = np.unique(code, return_counts=True)
        mine = (owner > 0) & t.is_single
        classes = np.concatenate((classes, [TOKENS, VOCABULARY, KEPT]))
        times = np.concatenate((times, [int(t.train.sum()), int((mine & (total > 0)).sum()), int((t.train & ~f).sum())]))
        extra = len(classes)
        none = lambda kind: pa.nulls(extra, kind)
        join = lambda a, b: pa.concat_arrays([a, b])
        column = lambda name: pa.concat_arrays([*t.table.column(name).chunks, none(t.table.column(name).type)])
        return pa.table(
            {
                "doc_id": column("doc_id"),
                "mark": column("mark"),
                "held_out": join(pa.array([not x for x in t.table.column("carried_0").to_pylist()], pa.bool_()), none(pa.bool_())),
                "n_tokens": join(pa.array(np.diff(t.bounds)), none(pa.int64())),
                "n_known": join(pa.array(np.diff(seen[t.bounds])), none(pa.int64())),
                "known_score": join(pa.array(np.diff(log[t.bounds])), none(pa.float64())),
                "counts": join(pa.array(counts, pa.binary()), none(pa.binary())),
                "class": join(pa.nulls(texts, pa.int64()), pa.array(classes)),
                "times": join(pa.nulls(texts, pa.int64()), pa.array(times)),
            }
        )

    answers = S.answered(rows.groupBy("shard").applyInArrow(R.lean(ask), S.ROWS), _totals, S.packed)
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(f"mark binary, {FOUND}").fields])
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(R.lean(look, 2), out)


def learn(classes: np.ndarray, times: np.ndarray, kept_tokens: int, vocabulary: int) -> np.ndarray:
    """Weights of bigram, token and uniform estimate in each bucket, by expectation-maximisation on the held-out histogram."""
    where, rest = np.divmod(classes, _SPAN * _SPAN)
    pair, single = np.divmod(rest, _SPAN)
    p = np.stack([_value(pair), _value(single) / max(1, kept_tokens), np.full(len(classes), 1 / (vocabulary + 1))], 1)
    pooled = _maximised(p, times)
    weights = np.tile(pooled, (BUCKETS, 1))
    for b in np.unique(where):
        weights[b] = _maximised(p[where == b], times[where == b])
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def _maximised(p: np.ndarray, times: np.ndarray) -> np.ndarray:
    w = np.full(3, 1 / 3)
    for _ in range(ROUNDS if len(p) else 0):
        part = p * w
        part *= (times / part.sum(1))[:, None]
        w = np.maximum(part.sum(0) / times.sum(), LEAST)
        w /= w.sum()
    return w


def scored(docs: DataFrame, shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """doc_id, mark, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, train)."""
    found = R.stored(counted(docs, shard_bytes), "ngrams", "zstd")
    rows = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("times").alias("times")).collect()
    sums = {r["class"]: r.times for r in rows}
    tokens, vocabulary = sums.get(TOKENS, 0), sums.get(VOCABULARY, 0)
    histogram = sorted((c, n) for c, n in sums.items() if c >= 0)
    weights = learn(np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.float64), sums.get(KEPT, 0), vocabulary)

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("counts").to_pylist():
                numbers = S.unplaned(data).astype(np.float64)
                single, pair = np.split(numbers[1:], 2)
                context = np.concatenate((numbers[:1], single[:-1]))
                w = weights[bucket(context)]
                ratio = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
                p = w[:, 0] * ratio + w[:, 1] * single / max(1, tokens) + w[:, 2] / (vocabulary + 1)
                out.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    base = F.col("known_score") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))
    texts = found.where("counts IS NOT NULL").select(
        "doc_id", "mark", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "counts"
    )
    return texts.mapInArrow(run, T.StructType([*texts.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs.withColumn("train", ~held_out(F.col("doc_id"), 7, 2)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
