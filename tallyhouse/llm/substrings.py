"""Removal of long repeated word sequences by de Bruijn compaction.

Windows of WIDTH words are the edges of a de Bruijn graph (their first and last WIDTH - 1 words are its nodes).
1. Shards of documents send their distinct edges; the merged counts come back. Edges found once are no part of the graph.
2. Each document walks the repeated edges. A walk is compacted into paths, which go on as long as consecutive edges are
   equally frequent: a nonbranching path, if that frequency is the number of walks over the whole path.
3. Joined by path over all shards, walks are counted. Where walks and edge count agree, the smallest source coordinate
   (doc_id, text, start) is where all edges of the path occur first, and all other walks are repeats.
4. Where they disagree the path branches between equally frequent edges; its edges are then joined one by one.
The words of all edges that are not first occurrences are removed. A shard adds one row per distinct path or edge, whatever the
size of a group of copies.

Defined cases: null texts have no words. Rows under one doc_id (or none) with different texts are different documents, ordered by
a checksum of the text; equal rows stand for one document and get equal results. A null doc_id comes before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import runs as R
from tallyhouse.llm import shards as S
from tallyhouse.llm import words as W

WIDTH = 20


class Walks:
    """A shard's documents, edges and, once counts are known, paths."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        self.width = width
        order = table.select(["doc_id", "mark"]).append_column("row", pa.array(np.arange(table.num_rows)))
        order = order.sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("row", "ascending")])
        rows = order.column("row").to_numpy()
        ids, marks = order.column("doc_id").to_pylist(), order.column("mark").to_pylist()
        new = np.array([k > 0 and (ids[k], marks[k]) != (ids[k - 1], marks[k - 1]) for k in range(len(ids))], np.int64)
        nulls = sum(i is None for i in ids)  # sorted last, but first in this order
        rank = np.cumsum(new)
        rank[len(ids) - nulls :] -= len(ids) + 1
        self.rank = np.zeros(table.num_rows, np.int64)
        self.rank[rows] = rank
        self.ids, self.marks = table.column("doc_id"), table.column("mark")
        self.texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks) if self.texts.num_chunks else pa.array([], pa.string())
        self.words = W.words(self.texts)
        self.starts = W.window_starts(self.words.bounds, width)
        self.edges = W.windows(W.hashes(self.words.distinct)[self.words.codes], width)[self.starts]
        self.text = np.searchsorted(self.words.bounds, self.starts, side="right") - 1
        self.keys, self.place, self.count = np.unique(self.edges, return_inverse=True, return_counts=True)

    def paths(self, total: np.ndarray) -> None:
        """Cut the walks over repeated edges into paths; total: the count of each distinct edge over all shards."""
        frequency = total[self.place]
        on = np.flatnonzero(frequency > 1)
        cut = np.ones(len(on) + 1, bool)
        if len(on):
            same = (np.diff(self.starts[on]) == 1) & (np.diff(self.text[on]) == 0) & (np.diff(frequency[on].astype(np.int64)) == 0)
            cut[1:-1] = ~same
        at = np.flatnonzero(cut)
        self.first, self.stop = at[:-1], at[1:]  # of each walk, in `on`
        self.on = on
        sums = np.zeros(len(on) + 1, np.uint64)
        np.cumsum(self.edges[on] * W.powers(W.BASE, len(on)), out=sums[1:])
        back = W.powers(W.INVERSE, len(on) + 1)
        self.path = W.mixed((sums[self.stop] - sums[self.first]) * back[self.first] + W.mixed((self.stop - self.first).astype(np.uint64)))
        self.frequency = frequency[on][self.first] if len(on) else np.zeros(0, np.uint64)

    def earliest(self, keys: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, how often each occurs, and the index of its first; `where` is the window of each key."""
        order = np.lexsort((self.starts[where], self.rank[self.text[where]]))
        distinct, index, count = np.unique(keys[order], return_index=True, return_counts=True)
        return distinct, count, order[index]

    def later(self, keys: np.ndarray, where: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Which keys are repeats: of a distinct key, all but the first in the shard, or all if it is first elsewhere."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        _, _, first = self.earliest(keys, where)
        base, doc = self.words.bounds[self.text[where]], self.rank[self.text[where]]
        start = self.starts[where] - base
        same = (doc == doc[first][inverse]) & (start == start[first][inverse])
        return ~same | np.isin(distinct, elsewhere)[inverse]

    def coordinates(self, where: np.ndarray) -> list[pa.Array]:
        text = pa.array(self.text[where])
        return [self.ids.take(text), self.marks.take(text), pa.array(self.starts[where] - self.words.bounds[self.text[where]])]


def _decided(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.asarray(table.column("kind").to_pylist(), np.int64) == kind
    return table.column("key").to_numpy().view(np.uint64)[keep], table.column("state").to_numpy()[keep]


NOTICE = "shard int, range int, data binary, kind int, key long, state int"
LATER, OPEN = 1, 2


class _Pass:
    """What a shard does with the notices it has got so far: list its paths, list opened edges, or remove words."""

    def __init__(self, width: int):
        self.width = width

    def walks(self, table: pa.Table, notices: pa.Table) -> Walks:
        notices = notices.combine_chunks()
        kinds = np.asarray(notices.column("kind").to_pylist(), np.int64)
        w = Walks(table, self.width)
        w.paths(S.gathered(notices.filter(pa.array(kinds == 0)), len(w.keys)))
        return w

    def list_paths(self, key, table, notices):
        w = self.walks(table, notices)
        distinct, count, first = w.earliest(w.path, w.on[w.first])
        ids, marks, start = w.coordinates(w.on[w.first][first])
        shard = key[0].as_py()
        return pa.table(
            [pa.array([shard] * len(distinct), pa.int32()), pa.array(distinct.view(np.int64)), pa.array(count), pa.array(w.frequency[first].astype(np.int64)), ids, marks, start],
            names=["shard", "key", "walks", "frequency", "doc_id", "mark", "start"],
        )

    def opened(self, w: Walks, notices: pa.Table) -> np.ndarray:
        """Windows on paths whose edges are joined one by one."""
        keys, states = _decided(notices, 1)
        walk = np.isin(w.path, keys[states == OPEN])
        return w.on[np.repeat(walk, w.stop - w.first)]

    def list_edges(self, key, table, notices):
        w = self.walks(table, notices)
        at = self.opened(w, notices)
        distinct, count, first = w.earliest(w.edges[at], at)
        ids, marks, start = w.coordinates(at[first])
        return pa.table(
            [pa.array([key[0].as_py()] * len(distinct), pa.int32()), pa.array(distinct.view(np.int64)), ids, marks, start],
            names=["shard", "key", "doc_id", "mark", "start"],
        )

    def removed(self, key, table, notices):
        w = self.walks(table, notices)
        keys, states = _decided(notices, 1)
        repeat = w.later(w.path, w.on[w.first], keys[states == LATER]) & ~np.isin(w.path, keys[states == OPEN])
        windows = w.on[np.repeat(repeat, w.stop - w.first)]
        at = self.opened(w, notices)
        edges, states = _decided(notices, 2)
        windows = np.concatenate((windows, at[w.later(w.edges[at], at, edges)]))
        edge = np.zeros(len(w.words.codes) + 1, np.int64)
        np.add.at(edge, w.starts[windows], 1)
        np.add.at(edge, w.starts[windows] + self.width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = W.joined(w.words, ~gone)
        totals = np.concatenate(([0], np.cumsum(gone)))[w.words.bounds]
        carried = [c for c in table.column_names if c.startswith("carried_")]
        return pa.table(
            [w.ids, w.marks, w.texts, kept.cast(pa.string()), pa.array(np.diff(w.words.bounds)), pa.array(np.diff(totals)), *(table.column(c) for c in carried)],
            names=["doc_id", "mark", "text", "kept_text", "n_words", "n_removed", *carried],
        )


def deduplicated(docs: DataFrame, width: int = WIDTH, shard_bytes: int = S.SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, mark, text, kept_text (kept words joined by one space), n_words and n_removed of every row, and the carried columns."""
    rows, shards = S.sharded(docs, shard_bytes, carry)
    step, doc_id = _Pass(width), rows.schema["doc_id"]

    def ask(key, table):
        w = Walks(table, width)
        return S.question(key[0].as_py(), w.keys, lambda s: S.planes(w.count[s]), shards)

    def totals(keys, extras):
        place, distinct = S.merged(keys)
        total = np.bincount(place, np.concatenate([S.unplaned(x) for x in extras]).astype(np.float64), len(distinct))
        return S.parted(total[place].astype(np.uint64), keys)

    def along(run, notices: DataFrame, fields) -> DataFrame:
        return rows.groupBy("shard").cogroup(notices.groupBy("shard")).applyInArrow(R.lean(run, 2), T.StructType(fields))

    counts = S.answered(rows.groupBy("shard").applyInArrow(R.lean(ask), S.ROWS), totals)
    none = {"kind": F.lit(0), "key": F.lit(0).cast("long"), "state": F.lit(0)}
    counts = counts.withColumns(none).repartition(shards, "shard")
    place = [doc_id, *T.StructType.fromDDL("mark binary, start long").fields]
    ddl = T.StructType.fromDDL
    over = Window.partitionBy("key")
    order = F.struct("doc_id", "mark", "start")

    paths = along(lambda k, t, n: step.list_paths(k, t, n), counts, [*ddl("shard int, key long, walks long, frequency long").fields, *place])
    state = F.when(F.sum("walks").over(over) != F.col("frequency"), OPEN).when(F.min(order).over(over) != order, LATER).otherwise(0)
    heard = paths.withColumn("state", state).where("state > 0").selectExpr("shard", "0 AS range", "CAST(NULL AS BINARY) AS data", "1 AS kind", "key", "state")
    notices = counts.unionByName(heard).repartition(shards, "shard")

    edges = along(lambda k, t, n: step.list_edges(k, t, n), notices, [*ddl("shard int, key long").fields, *place])
    late = edges.withColumn("state", F.when(F.min(order).over(over) != order, LATER).otherwise(0)).where("state > 0")
    heard = late.selectExpr("shard", "0 AS range", "CAST(NULL AS BINARY) AS data", "2 AS kind", "key", "state")
    out = [doc_id, *ddl("mark binary, text string, kept_text string, n_words long, n_removed long").fields]
    out += [f for f in rows.schema.fields if f.name.startswith("carried_")]
    found = along(lambda k, t, n: step.removed(k, t, n), notices.unionByName(heard), out)
    return found.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})


def query(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
