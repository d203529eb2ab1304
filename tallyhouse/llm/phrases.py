"""Collocations per language, counted by weighted acyclic automata.

1. A part of a partition's texts (about PART_BYTES, cut only between pieces) sorts its sequences of language and up to LONGEST words
   and freezes them into a minimal automaton whose arcs carry the counts (automata.py). It leaves the task cut into prefix ranges,
   one automaton for each: a phrase belongs to the range of its first two words.
2. Automata of a range are united and their weights summed. With more than FAN ranges this takes several levels: groups of parts meet in a coarse
   range and leave it cut into FAN finer ones; a group's text is bounded, so that the pieces exchanged grow in proportion to the input. At last sequences under LEAST go.
3. The ranges of candidates' parts (first k words, the rest) get these parts as questions, again a tree, and compose it with their
   automaton. All parts of a candidate are at least as frequent as it is, so none was cut off.
4. Scores, the rule for longer candidates and the ranking are joins and aggregates over candidates; arithmetic is DECIMAL.

A task holds one part, or the pieces of a coarse range from GROUP_BYTES of its text, or one range. A range with more than twice SLICE_BYTES
(there are no more than FAN ranges until each has WIDE_BYTES of text; a very frequent pair may make one large) is held compressed and
united slice by slice, each with the sequences of one hash class. A frequent phrase is one entry per part, whatever its count.

Defined cases: null texts have no words; a null lang counts as `und`, together with rows that say so. Repeated rows count again. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm import automata as A
from tallyhouse.llm import runs as R
from tallyhouse.llm import words as W

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one around it has at least this share of its count, in percent.
COVERED = 80
PART_BYTES = 4 << 20
#: Text behind one prefix range, and how far it grows before there are more than FAN ranges.
RANGE_BYTES, WIDE_BYTES = 8 << 20, 96 << 20
#: Text of a coarse range that meets in one task.
GROUP_BYTES = 4 << 20
#: Bytes of a large range's automata, before compression, that are united at once.
SLICE_BYTES = 24 << 20
#: Ranges that one exchange deals to.
FAN = 128
#: Parts of a language that are ranked by themselves, step by step.
SALTS = (1024, 16)
PIECES = "range int, part int, blob binary"
GOLDEN = 0.6180339887498949

_SPACE, _BREAK = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


def _slabs(kind: np.ndarray, starts: np.ndarray, most: int):
    """Where to cut bytes into slabs of about `most`: at starts of texts and behind breaks."""
    may = np.union1d(np.flatnonzero(kind == _BREAK) + 1, starts)
    n, at = len(kind), 0
    while at < n:
        k = int(np.searchsorted(may, at + most))
        stop = int(may[k]) if k < len(may) else n
        yield at, max(stop, at + 1)
        at = max(stop, at + 1)


def word_rows(data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased bytes, the piece of each, and the position of its first byte; texts begin at `starts`."""
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = np.zeros(len(data), bool)
    border[starts] = True
    first |= inside & border
    at = np.flatnonzero(first)
    length = np.bincount(np.cumsum(first)[inside] - 1, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[inside].tobytes())])
    return found, np.cumsum((kind == _BREAK) + border.astype(np.int64))[at], at


def phrase_tree(texts: pa.Array, langs: pa.Array, longest: int = LONGEST, most: int = PART_BYTES):
    """Trees of (lang, word, ..., word) for parts of the texts."""
    data, bounds = W.byte_view(texts)
    data = _LOWER[data]
    kind = _CLASS[data]
    full = np.flatnonzero(np.diff(bounds))
    starts = bounds[:-1][full]
    for a, b in _slabs(kind, starts, most):
        inner = starts[slice(*np.searchsorted(starts, [a, b]))] - a
        found, piece, at = word_rows(data[a:b], kind[a:b], inner)
        if not len(found):
            continue
        owner = full[np.searchsorted(starts, at + a, side="right") - 1]
        names, lang = A.ranked(langs.cast(pa.large_string()))
        symbols, rank = A.ranked(pa.concat_arrays([names, found]))
        columns, word = [rank[: len(names)][lang[owner]]], rank[len(names) :]
        for k in range(longest):
            column = np.full(len(word), -1, np.int64)
            if len(word) > k:
                column[: len(word) - k] = np.where(piece[: len(word) - k] == piece[k:], word[k:], -1)
            columns.append(column)
        yield A.tree(symbols, columns)[0]


def _pieces(t: A.Tree, part: int, ranges: int, step: int) -> pa.Table:
    """PIECES rows: the tree cut into ranges, of which `step` make one for now."""
    cut = [(k, A.dumped(A.frozen(x))) for k, x in A.parted(t, [r // step for r in A.routes(t, 3, ranges)])]
    return pa.table([pa.array([k for k, _ in cut], pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([x for _, x in cut], pa.binary())], names=["range", "part", "blob"])


def _uniting(ranges: int, step: int, fan: int):
    def unite(key, table):
        t = A.union(A.loaded(x.as_py()) for x in table.column("blob"))
        return _pieces(t, key[1].as_py(), ranges, step)

    return unite


def frequent(blobs: pa.ChunkedArray, least: int, slice_bytes: int = SLICE_BYTES) -> A.Tree:
    """The sequences that all automata together count `least` times or more."""
    sizes = [int.from_bytes(x, "little") for x in pc.binary_slice(blobs, 0, 8).to_pylist()]
    if sum(sizes) <= 2 * slice_bytes:
        return A.pruned(A.union(A.loaded(x.as_py()) for x in blobs), least)
    slices = -(-sum(sizes) // slice_bytes)
    held, cuts = [[] for _ in range(slices)], np.cumsum(sizes) // max(1, slice_bytes // 2)
    begin = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist()]
    for a, b in zip(begin, [*begin[1:], len(sizes)], strict=True):
        t = A.union(A.loaded(x.as_py()) for x in blobs.slice(a, b - a))
        for k, x in A.parted(t, A.routes(t, len(t.levels), slices, 0)):
            held[k].append(A.dumped(A.unfolded(x)))
        del t
        W.released()
    found = []
    for part in held:
        if part:
            found.append(A.frozen(A.pruned(A.union(A.loaded(x) for x in part), least)))
            part.clear()
            W.released()
    return A.union(found)


def groups(size: int, coarse: int, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of parts, each of which has `group_bytes` of text in one of so many ranges."""
    return max(1, -(-size // (coarse * group_bytes)))


def counts(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, part_bytes: int = PART_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN,
    wide_bytes: int = WIDE_BYTES, group_bytes: int = GROUP_BYTES, slice_bytes: int = SLICE_BYTES,
) -> tuple[DataFrame, int]:
    """(range, blob): for each prefix range the automaton of all sequences counted `least` times or more; and the number of ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(-(-size // range_bytes), max(fan, -(-size // wide_bytes))))
    step = 1
    while -(-ranges // step) > fan:
        step *= fan
    first = groups(size, -(-ranges // step), group_bytes)

    def shards(batches, width=step):
        part = int(TaskContext.get().partitionId() * GOLDEN % 1 * first)  # parts go round the groups, each task's from another one on
        for batch in batches:
            for slab in W.parts(batch, most=part_bytes):
                for t in phrase_tree(slab.column("text"), slab.column("lang"), longest, part_bytes):
                    yield from _pieces(t, part % first, ranges, width).to_batches()
                    part += 1
                    del t
                    W.released()

    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(R.lean_stream(shards), PIECES)
    while step > 1:
        meet = groups(size, -(-ranges // step), group_bytes)
        step //= fan
        pieces = pieces.groupBy("range", F.expr(f"part % {meet}").alias("group")).applyInArrow(R.lean(_uniting(ranges, step, fan)), PIECES)

    def finish(key, table):
        t = frequent(table.column("blob"), least, slice_bytes)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([A.dumped(A.frozen(t))], pa.binary())], names=["range", "blob"])

    return R.stored(pieces.groupBy("range").applyInArrow(R.lean(finish), "range int, blob binary"), "phrases"), ranges


LISTED = "lang string, phrase string, words int, count long"


def listed(found: DataFrame) -> DataFrame:
    """LISTED rows of all sequences with a count; the language alone, with all its words, has 0 words."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                t = A.union([A.loaded(blob.as_py())])
                for k, (v, (lang, phrase)) in enumerate(zip(t.levels, A.spelled(t), strict=True)):
                    on = pa.array(v.weight > 0)
                    n = pc.sum(on).as_py() or 0
                    columns = [lang.filter(on).cast(pa.string()), phrase.filter(on).cast(pa.string()), pa.array([k] * n, pa.int32()), pa.array(v.weight).filter(on)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "count"])

    return found.mapInArrow(run, LISTED)


def _asked(lang: list[str], phrase: list[str]) -> tuple[A.Tree, np.ndarray]:
    words = [[a, *p.split(" ")] for a, p in zip(lang, phrase, strict=True)]
    symbols, rank = A.ranked(pa.array([w for row in words for w in row], pa.large_string()))
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    columns = [np.where(size > k, rank[np.minimum(first + k, len(rank) - 1)], -1) for k in range(int(size.max()))]
    return A.tree(symbols, columns)


def looked_up(parts: DataFrame, found: DataFrame, ranges: int) -> DataFrame:
    """(lang, part, count) of distinct parts, each composed with the automaton of its range."""

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                lang, part = batch.column("lang").to_pylist(), batch.column("part").to_pylist()
                t, order = _asked(lang, part)
                place = np.empty(batch.num_rows, np.int64)
                depth, nodes = _ends(t, part, order)
                routes = A.routes(t, 3, ranges)
                for k in range(len(t.levels)):
                    at = depth == k
                    place[at] = routes[k][nodes[at]]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("part"), pa.array(place, pa.int32())], names=["lang", "part", "range"])

    asked = parts.mapInArrow(route, "lang string, part string, range int")
    both = asked.unionByName(found, allowMissingColumns=True)

    def answer(table: pa.Table) -> pa.Table | None:
        blobs = [x.as_py() for x in table.column("blob") if x.is_valid]
        rows = table.filter(pc.is_valid(table.column("part")))
        if not blobs or not rows.num_rows:
            return None
        lang, part = rows.column("lang").to_pylist(), rows.column("part").to_pylist()
        t, order = _asked(lang, part)
        weights, (depth, nodes) = A.composed(t, A.loaded(blobs[0])), _ends(t, part, order)
        out = np.zeros(len(part), np.int64)
        for k, w in enumerate(weights):
            out[depth == k] = w[nodes[depth == k]]
        return pa.table([rows.column("lang"), rows.column("part"), pa.array(out)], names=["lang", "part", "count"])

    return R.by_key(both, ["range"], answer, "lang string, part string, count long")


def _ends(t: A.Tree, part: list[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct rows of _asked: the level of each, and its place there; among rows of one length the tree keeps their order."""
    depth = np.array([p.count(" ") + 1 for p in part], np.int64)
    nodes = np.empty(len(part), np.int64)
    new_depth = depth[order]
    for k in range(1, len(t.levels)):
        v = t.levels[k]
        # a row passes through the node at its own depth; rows that go on share it
        through = np.flatnonzero(new_depth >= k)
        ends = new_depth[through] == k
        place = np.repeat(np.arange(len(v.weight)), v.weight)
        nodes[order[through[ends]]] = place[ends]
    return depth, nodes


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of docs (text, lang)."""
    found, ranges = counts(docs, longest, least, **sizes)
    rows = R.stored(listed(found), "phrases")
    candidates = rows.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"))
    split = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns(
        {"left": F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ")}
    )
    parts = cuts.select("lang", F.col("left").alias("part")).unionByName(cuts.select("lang", F.col("right").alias("part"))).distinct()
    known = R.stored(looked_up(parts, found, ranges), "parts")
    first = known.select("lang", F.col("part").alias("left"), F.col("count").alias("l"))
    rest = known.select("lang", F.col("part").alias("right"), F.col("count").alias("r"))
    scored = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).withColumn("score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r)"))
    key = F.col("score") * 8 + F.col("k")  # at most 1 000 000 * 8 + 3
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(key).alias("key"), F.min_by("l", key).alias("l"), F.min_by("r", key).alias("r"))
    inner = candidates.withColumnRenamed("a", "longer").where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.select("lang", F.array_join(F.slice(split, F.col("start"), F.col("size")), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {covered}"
    kept = lowest.join(around, ["lang", "phrase"], "left").where(alone).withColumn("score", F.expr("key DIV 8"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    for parts in SALTS:  # a language's best are among the best of its parts, and no task sorts all its candidates
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = rows.where("words = 0").select("lang", F.col("count").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, p AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS words) WHERE len(w) >= words)
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, words - size + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS size FROM c)) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
