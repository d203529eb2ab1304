"""Near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of distinct 5-word shingles and a MinHash signature of COORDINATES values. Texts with equal sets are
   one class; from here on a class is one row, however many copies it has.
2. A class is posted under its coordinate-value pairs. Pairs of classes worth a look agree in at least MATCHES coordinates, so they
   share one of the COORDINATES - MATCHES + 1 pairs that are rarest in either (prefix); only these are posted, and only where another
   class has the pair too.
3. Along each posting list collisions are counted over the whole signatures. Classes that the list has already connected are
   skipped when merging, so a list yields a spanning forest of links and not all pairs.
4. Links make clusters; within a cluster full shingle sets are intersected, and links with a similarity of at least 75 % confirmed,
   again as a spanning forest. Components of the confirmed links are the groups.
Long lists and large clusters are split into pairs of blocks, so that no task holds more than two blocks of them.

At 64 coordinates and 32 matches a pair with similarity 0.75 is missed with probability 2e-6.

Defined cases: a text without words has an empty set and is linked with nothing; null texts have no words. Rows may share a doc_id
or have none: a component is named by its smallest doc_id that is not null (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import runs as R
from tallyhouse.llm import shards as S
from tallyhouse.llm import words as W

SHINGLE = 5
COORDINATES, MATCHES = 64, 32
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Classes of a posting list or cluster that one task compares with as many others.
BLOCK = 1024

_FACTORS = np.random.default_rng(1).integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; a shorter text is one shingle, one without words has none."""
    found = W.words(W.lowered(texts))
    values = W.hashes(found.distinct)[found.codes]
    shingles = W.windows(values, width)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingles[a : b - width + 1]))
        else:
            out.append(W.mixed(W.windows(values[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = (shingles[:, None] * _FACTORS[None, :]).min(0)
    return (W.mixed(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, mark, n_shingles, class (of equal sets; null if empty) and signature."""
    doc_id = docs.schema["doc_id"]

    def run(batches):
        for batch in batches:
            for part in W.parts(batch):
                sets = shingle_sets(part.column("text"), width)
                classes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                values = [signature(s).tobytes() if len(s) else None for s in sets]
                counts = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), counts, pa.array(classes, pa.binary()), pa.array(values, pa.binary())],
                    names=["doc_id", "mark", "n_shingles", "class", "signature"],
                )

    schema = T.StructType([doc_id, *T.StructType.fromDDL("mark binary, n_shingles long, class binary, signature binary").fields])
    return docs.select("doc_id", S.text_mark().alias("mark"), "text").mapInArrow(R.lean_stream(run), schema)


def _pairs(signature: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs."""
    return W.mixed(signature.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


POSTING = "list long, i int, j int, class binary, signature binary"


def postings(classes: DataFrame) -> DataFrame:
    """POSTING rows of the prefix of each class, once for each pair of blocks in which its list is worked on."""
    rows = classes.count()
    shards = max(1, -(-rows // 20_000))
    dealt = classes.select("class", "signature", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard")).repartition(shards, "shard")

    def named(table):
        return _pairs(np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES))

    def ask(key, table):
        keys, count = np.unique(named(table), return_counts=True)
        return S.question(key[0].as_py(), keys, lambda s: S.planes(count[s]), shards)

    def totals(keys, extras):
        place, distinct = S.merged(keys)
        total = np.bincount(place, np.concatenate([S.unplaned(x) for x in extras]).astype(np.float64), len(distinct))
        return S.parted(total[place].astype(np.uint64), keys)

    def post(key, table, answers):
        names = named(table)
        keys, inverse = np.unique(names, return_inverse=True)
        frequency = S.gathered(answers, len(keys))[inverse.reshape(names.shape)].astype(np.int64)
        order = np.lexsort((names, frequency), axis=1)[:, : COORDINATES - MATCHES + 1]
        row = np.repeat(np.arange(len(names)), order.shape[1])
        coordinate = order.ravel()
        shared = frequency[row, coordinate] > 1
        row, coordinate = row[shared], coordinate[shared]
        blocks = -(-frequency[row, coordinate] // BLOCK)
        own = np.fromiter((xxhash.xxh3_64_intdigest(c) >> 1 for c in table.column("class").to_pylist()), np.int64, len(names))[row] % blocks
        copy = np.repeat(np.arange(len(row)), blocks)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        source = pa.array(row[copy])
        short = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint16)
        shorter = pa.array([s.tobytes() for s in short], pa.binary())
        return pa.table(
            {
                "list": pa.array(names[row, coordinate][copy].view(np.int64)),
                "i": pa.array(np.minimum(own[copy], other), pa.int32()),
                "j": pa.array(np.maximum(own[copy], other), pa.int32()),
                "class": table.column("class").combine_chunks().take(source),
                "signature": shorter.take(source),
            }
        )

    answers = S.answered(dealt.groupBy("shard").applyInArrow(R.lean(ask), S.ROWS), totals)
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(R.lean(post, 2), POSTING)


def _links(names: list[bytes], a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array([names[k] for k in a], pa.binary()), "b": pa.array([names[k] for k in b], pa.binary())})


LINK = "a binary, b binary"


def _spanning(n: int, partners) -> tuple[list[int], list[int]]:
    """Links that connect all that partners connects; partners(a, those not yet connected with a) gives the linked ones."""
    left, right = [], []
    label = np.arange(n)
    for a in range(n - 1):
        rest = np.flatnonzero(label[a + 1 :] != label[a]) + a + 1
        if not len(rest):
            continue
        for b in partners(a, rest).tolist():
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                left.append(a)
                right.append(b)
    return left, right


def colliding(posted: DataFrame) -> DataFrame:
    """Links (a, b) between classes that agree in MATCHES coordinates: a spanning forest of each list or pair of its blocks."""

    def run(table):
        if table.num_rows < 2:
            return None
        names = table.column("class").to_pylist()
        values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        return _links(names, *_spanning(len(names), lambda a, rest: rest[(values[rest] == values[a]).sum(1) >= MATCHES]))

    return R.by_key(posted, ["list", "i", "j"], run, LINK)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    n = len(sets)
    ids, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    useful = count[inverse] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[inverse[useful]], owner[useful]
    out, step = np.zeros((n, n), np.float32), max(1024, (1 << 23) // n)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [start, start + step])
        part = np.zeros((n, int(column[b - 1]) + 1 - start), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def confirmed(members: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members (class, cluster, i, j, text) whose full sets are similar enough, as spanning forests."""

    def run(table):
        texts = table.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        first = dict(reversed([(c, k) for k, c in enumerate(table.column("class").to_pylist())]))
        names = sorted(first)
        if len(names) < 2:
            return None
        sets = shingle_sets(texts.take(pa.array([first[c] for c in names])), width)
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets)
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        return _links(names, *_spanning(len(names), lambda a, rest: rest[near[a, rest]]))

    return R.by_key(members, ["cluster", "i", "j"], run, LINK)


def _blocks(members: DataFrame) -> DataFrame:
    """Members (class, cluster) with the pairs of blocks in which they are compared."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    spread = members.join(sizes, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("class", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and chosen of every row of docs (doc_id, text).

    chosen marks the rows with the component's smallest doc_id and, under it, the smallest mark: one document unless a row repeats.
    """
    signed = R.stored(signatures(docs, width), "minhash")
    source = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("source")
    some = F.max("signature").alias("signature")  # equal sets have equal signatures
    classes = R.stored(signed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), source, some), "minhash")
    clusters = R.components(R.stored(colliding(postings(classes)), "minhash"))
    members = _blocks(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")))
    placed = members.join(classes.select("class", "source.doc_id", "source.mark"), "class").select("*", F.col("doc_id").alias("s"), F.col("mark").alias("m")).drop("doc_id", "mark")
    texts = docs.select("doc_id", S.text_mark().alias("mark"), "text")
    read = placed.join(texts, F.col("s").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))).select("class", "cluster", "i", "j", "text")
    groups = R.components(confirmed(read, width, percent))
    named = classes.select("class", "least", "source").join(groups, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("source").alias("source"))
    by_class = named.select(F.col("class").alias("c"), "root").join(least, "root").select("c", "component_id", "source")
    found = signed.join(by_class, F.col("class") == F.col("c"), "left")
    alone = F.col("class").isNull()
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("source.doc_id")) & (F.col("mark") == F.col("source.mark")))
    return found.select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), chosen.alias("chosen"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
