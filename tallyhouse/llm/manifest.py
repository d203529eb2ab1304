"""A Merkle manifest of documents: one tree per source over its rows in order of doc_id, one tree over the sources' roots.

A node is the digest H of up to FAN consecutive nodes below it. Trees are stored as blocks: aligned subtrees of at most HEIGHT levels
above their leaves, whose roots are the leaves of the next round of blocks, until a tree is one block. Within a block nodes stand in
van Emde Boas order: the subtree is cut at half its height, the upper part comes first, then the lower ones from left to right, each
cut in the same way. `places` is the arithmetic from (depth, number) to an address; building a block and reading the siblings of a
leaf use it alike, and a path from leaf to root touches few runs of the array whatever the size of a cache line or page.

Rows are numbered by a range partitioning on (source, doc_id, leaf) with one carry row per partition and source; a block is the only
thing a task holds whole. The paths of a block's root come down from the round above, one row per block.

Defined cases: nulls are written `-`. A source's rows with equal or null doc_id stand in order of their leaves, nulls first; null is a
source of its own, before all others. An empty table has no rows, no roots and no blocks. Other columns are ignored unless named.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import runs as R

FAN = 3
#: Levels above the leaves of a block: at most FAN ** HEIGHT leaves.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree over all sources; sources' own keys are ":" and the source, or "" for null.
ALL = "*"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Van Emde Boas order


def nodes(levels: int, fan: int = FAN) -> int:
    """Nodes of a whole subtree."""
    return (fan**levels - 1) // (fan - 1)


def address(levels: int, depth: int, number: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Where the nodes `number` of a depth (0 is the root) stand in a subtree of `levels` levels."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number, fan)
    width = fan ** (depth - upper)
    return nodes(upper, fan) + number // width * nodes(levels - upper, fan) + address(levels - upper, depth - upper, number % width, fan)


@lru_cache(maxsize=64)
def places(levels: int, fan: int = FAN) -> tuple[list[int], ...]:
    """The addresses of all nodes, depth by depth."""
    return tuple(address(levels, depth, np.arange(fan**depth), fan).tolist() for depth in range(levels))


class Shape(NamedTuple):
    """A block: its levels, and how many of its nodes there are at each depth."""

    levels: int
    counts: tuple[int, ...]


@lru_cache(maxsize=1024)
def shape(leaves: int, whole: int, fan: int, height: int) -> Shape:
    """Of a block with so many leaves in a tree with `whole` leaves: a tree of one block ends with its root."""
    levels = height + 1
    if whole <= fan**height:
        levels = 1
        while fan ** (levels - 1) < whole:
            levels += 1
    counts = [leaves]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // fan))
    return Shape(levels, tuple(reversed(counts)))


def block(leaves: list[str], whole: int, fan: int = FAN, height: int = HEIGHT) -> list[str]:
    """The nodes of a block in van Emde Boas order; "" where an incomplete subtree has none."""
    form = shape(len(leaves), whole, fan, height)
    at = places(form.levels, fan)
    out = [""] * nodes(form.levels, fan)
    for place, leaf in zip(at[-1], leaves, strict=False):
        out[place] = leaf
    for depth in range(form.levels - 2, -1, -1):
        below = at[depth + 1]
        for k in range(form.counts[depth]):
            out[at[depth][k]] = digest(*[out[p] for p in below[k * fan : min((k + 1) * fan, form.counts[depth + 1])]])
    return out


def siblings(stored: list[str], form: Shape, leaf: int, fan: int = FAN) -> list[tuple[str, str]]:
    """Digests left and right of the path from a leaf to the root of its block, lowest first."""
    at, out = places(form.levels, fan), []
    for depth in range(form.levels - 1, 0, -1):
        run = range(leaf // fan * fan, min(leaf // fan * fan + fan, form.counts[depth]))
        out.append(tuple("".join(stored[at[depth][k]] for k in run if (k > leaf if right else k < leaf)) for right in (0, 1)))
        leaf //= fan
    return out


def written(path: list[tuple[str, str]]) -> str:
    """A path as text: levels end with "/", the node itself is "."."""
    return "".join(f"{left}.{right}/" for left, right in path)


def proof(path: str) -> str:
    return digest(path.replace("/", "").replace(".", ""))


def folded(leaf: str, path: str) -> str:
    for level in path.split("/")[:-1]:
        leaf = digest(level.replace(".", leaf))
    return leaf


def _packed(found: list[str]) -> bytes:
    return b"".join(bytes.fromhex(d) if d else bytes(32) for d in found)


def unpacked(data: bytes) -> list[str]:
    return ["" if data[k : k + 32] == bytes(32) else data[k : k + 32].hex() for k in range(0, len(data), 32)]


# Leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """H of a row's fields, each as byte count and value."""
    return F.sha2(F.concat(*(_field(replaced.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, ...) with `place` (from 0) in their tree by `order`, and `whole`, the leaves of the tree."""
    n = leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = leaves.repartitionByRange(int(n), "tree", *order).sortWithinPartitions("tree", *order)
    rows = R.stored(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "leaves")
    parts = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("whole"))
    return rows.join(carry, ["tree", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift")


# Blocks


BLOCKS = "tree string, round int, block long, whole long, leaves int, nodes binary, root string"


def _built(leaves: DataFrame, turn: int, fan: int, height: int) -> DataFrame:
    """BLOCKS rows of leaves (tree, place, whole, leaf)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        whole, at = table.column("whole")[0].as_py(), table.column("block")[0].as_py()
        found = block(table.column("leaf").to_pylist(), whole, fan, height)
        row = [table.column("tree")[0].as_py(), turn, at, whole, table.num_rows, _packed(found), found[0]]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    width = fan**height
    return R.by_key(leaves.select("tree", F.expr(f"place DIV {width}").alias("block"), "place", "whole", "leaf"), ["tree", "block"], run, BLOCKS)


class Forest(NamedTuple):
    """BLOCKS tables round by round, and the root (tree, root) of every tree."""

    rounds: list[DataFrame]
    roots: DataFrame


def forest(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> Forest:
    """Trees over leaves (tree, place, whole, leaf)."""
    most, width, rounds = leaves.agg(F.max("whole")).first()[0] or 0, fan**height, []
    while True:
        rounds.append(R.stored(_built(leaves, len(rounds), fan, height), "blocks"))
        if most <= width:
            break
        above = rounds[-1].where(F.col("whole") > width)
        leaves = above.select("tree", F.col("block").alias("place"), F.expr(f"(whole + {width - 1}) DIV {width}").alias("whole"), F.col("root").alias("leaf"))
        most = -(-most // width)
    roots = rounds[0].where(F.col("whole") <= width).select("tree", "root")
    for r in rounds[1:]:
        roots = roots.unionByName(r.where(F.col("whole") <= width).select("tree", "root"))
    return Forest(rounds, roots)


def _lowered(blocks: DataFrame, above: DataFrame, members: DataFrame, use, schema, fan: int, height: int) -> DataFrame:
    """`use` for each block with its members (tree, block, place, ...): the block's row joined with the path of its root, in `above`
    (tree, block, path), and the members meet in one stream."""
    extra = [c for c in members.columns if c not in ("tree", "block", "place")]
    head = blocks.join(above, ["tree", "block"]).select("tree", "block", F.lit(-1).cast("long").alias("place"), "whole", "leaves", "nodes", "path")
    both = head.unionByName(members, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first = table.slice(0, 1).to_pylist()[0]
        form, width = shape(first["leaves"], first["whole"], fan, height), fan**height
        stored, rest = unpacked(first["nodes"]), table.slice(1)
        paths = {}
        for p in rest.column("place").to_pylist():
            if p not in paths:
                paths[p] = written(siblings(stored, form, p % width, fan)) + first["path"]
        return use(rest.select(["tree", *extra, "place"]), [paths[p] for p in rest.column("place").to_pylist()])

    return R.by_key(both, ["tree", "block"], run, schema)


def paths_of(grown: Forest, tops: DataFrame, members: DataFrame, use, schema, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """`use(members, paths)` block by block, where paths lead to the root and go on with the path of the tree in tops (tree, path)."""
    width, above = fan**height, None
    for k in range(len(grown.rounds) - 1, -1, -1):
        ends = grown.rounds[k].where(F.col("whole") <= width).select("tree", "block").join(tops, "tree").select("tree", "block", "path")
        above = ends if above is None else above.unionByName(ends)
        if k == 0:
            return _lowered(grown.rounds[0], above, members, use, schema, fan, height)
        below = grown.rounds[k - 1].where(F.col("whole") > width).select("tree", F.col("block").alias("place"), F.expr(f"block DIV {width}").alias("block"))

        def lower(rows: pa.Table, paths: list[str]) -> pa.Table:
            return pa.table({"tree": rows.column("tree"), "block": rows.column("place"), "path": pa.array(paths, pa.string())})

        above = R.stored(_lowered(grown.rounds[k], above, below, lower, "tree string, block long, path string", fan, height), "paths")


class Manifest(NamedTuple):
    """Numbered leaves (tree, place, whole, doc_id, leaf and what was carried), the sources' trees, the tree over their roots, which
    has the sources' keys as its leaves (key, place), and its root."""

    leaves: DataFrame
    sources: Forest
    keys: DataFrame
    top: Forest
    root: str | None


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fan: int = FAN, height: int = HEIGHT) -> Manifest:
    """Of docs with the columns FIELDS; `carry`: further columns of the leaves."""
    key = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(key.alias("tree"), "doc_id", leaf_digest().alias("leaf"), *((c.alias(n) for n, c in (carry or {}).items())))
    leaves = R.stored(numbered(rows, ["doc_id", "leaf"]), "numbered")
    sources = forest(leaves.select("tree", "place", "whole", "leaf"), fan, height)
    roots = sources.roots.select(F.lit(ALL).alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"))
    keys = R.stored(numbered(roots, ["key"]), "keys")
    top = forest(keys.select("tree", "place", "whole", "leaf"), fan, height)
    root = top.roots.first()
    return Manifest(leaves, sources, keys, top, root.root if root else None)


def proofs(made: Manifest, doc_id: T.StructField, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, path and proof_sha256 of every leaf; folded_root and verified, recomputed from `claimed` if that was
    carried and is not null, else from the leaf."""
    width, root = fan**height, made.root
    at = made.keys.select("tree", F.expr(f"place DIV {width}").alias("block"), "place", "key", F.col("leaf").alias("subroot"))

    def upper(rows: pa.Table, paths: list[str]) -> pa.Table:
        return pa.table({"tree": rows.column("key"), "subroot": rows.column("subroot"), "path": pa.array(paths, pa.string())})

    start = made.keys.select("tree").limit(1).select("tree", F.lit("").alias("path"))
    tops = R.stored(paths_of(made.top, start, at, upper, "tree string, subroot string, path string", fan, height), "paths")
    claimed = F.col("claimed") if "claimed" in made.leaves.columns else F.lit(None).cast("string").alias("claimed")
    members = made.leaves.select("tree", F.expr(f"place DIV {width}").alias("block"), "place", "doc_id", "leaf", claimed)
    out = T.StructType([doc_id, *T.StructType.fromDDL("tree string, leaf string, path string, root string, proof_sha256 string, folded_root string, verified boolean").fields])

    def use(rows: pa.Table, paths: list[str]) -> pa.Table:
        leaves = rows.column("leaf").to_pylist()
        again = [folded(c or leaf, p) for leaf, c, p in zip(leaves, rows.column("claimed").to_pylist(), paths, strict=True)]
        columns = [rows.column("tree"), rows.column("leaf"), pa.array(paths, pa.string()), pa.array([root] * len(leaves), pa.string())]
        columns += [pa.array([proof(p) for p in paths], pa.string()), pa.array(again, pa.string()), pa.array([a == root for a in again])]
        return pa.table([rows.column("doc_id"), *columns], names=out.fieldNames())

    found = paths_of(made.sources, tops.select("tree", "path"), members, use, out, fan, height)
    return found.join(tops.select("tree", "subroot"), "tree")


def tampered() -> Column:
    """The leaf of the row without line feeds in its text, where 2 divides the checksum of the doc_id; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    found = proofs(manifest(docs, {"claimed": tampered()}), docs.schema["doc_id"])
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, text, head, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place
  FROM fields),
-- DuckDB has no crc32: the eight steps of a byte, byte after byte
crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, 1 AS pos, CAST(4294967295 AS UBIGINT) AS c, 0 AS bit FROM leaves
  UNION ALL
  SELECT doc_id, d, CASE WHEN bit = 7 THEN pos + 1 ELSE pos END,
    CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END, (bit + 1) % 8
  FROM (SELECT *, CASE WHEN bit = 0 THEN xor(c, CAST(ascii(d[pos]) AS UBIGINT)) ELSE c END AS x FROM crc WHERE pos <= length(d))),
odd AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 2 AS odd FROM crc WHERE pos > length(d)),
lower_nodes AS (
  SELECT source, 0 AS level, place, leaf AS node FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM lower_nodes) WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (
  SELECT source, level AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC) AS k FROM lower_nodes) WHERE k = 1),
upper_nodes AS (
  SELECT 0 AS level, place, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY level, place // 3),
top AS (SELECT node AS root FROM upper_nodes ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT l.doc_id, n.level, string_agg(n.node, '' ORDER BY n.place) FILTER (n.place < l.place // p.power) AS before,
    string_agg(n.node, '' ORDER BY n.place) FILTER (n.place > l.place // p.power) AS after
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
    JOIN (SELECT unnest(range(0, 40)) AS level, unnest([CAST(pow(3, i) AS HUGEINT) FOR i IN range(0, 40)]) AS power) p ON p.level < s.height
    JOIN lower_nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.level = p.level AND n.place // 3 = l.place // p.power // 3
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, 100 + n.level, string_agg(n.node, '' ORDER BY n.place) FILTER (n.place < s.place // p.power),
    string_agg(n.node, '' ORDER BY n.place) FILTER (n.place > s.place // p.power)
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
    JOIN (SELECT unnest(range(0, 40)) AS level, unnest([CAST(pow(3, i) AS HUGEINT) FOR i IN range(0, 40)]) AS power) p
      ON p.level < (SELECT max(level) FROM upper_nodes)
    JOIN upper_nodes n ON n.level = p.level AND n.place // 3 = s.place // p.power // 3
  GROUP BY ALL),
path AS (
  SELECT doc_id, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step
  FROM steps),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256, max(step) AS steps FROM path GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0 AS step, CASE WHEN odd = 0 THEN other ELSE leaf END AS node FROM leaves JOIN odd USING (doc_id)
  UNION ALL
  SELECT f.doc_id, p.step, sha256(p.before || f.node || p.after) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = top.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN top LEFT JOIN proof USING (doc_id)
  JOIN fold f ON f.doc_id = l.doc_id AND f.step = coalesce(proof.steps, 0)
"""
