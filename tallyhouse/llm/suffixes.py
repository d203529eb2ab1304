"""Removal of byte strings of at least WIDTH bytes that occur elsewhere, by suffix arrays of shards merged by binary search.

1. Every window of WIDTH bytes has an anchor, its smallest hashed PIECE-byte piece (leftmost of equals), so equal windows have equal
   anchors in equal places. Consecutive windows with one anchor form a segment. Shards send the distinct (anchor, segment) pairs; back
   comes whether the segment occurs twice or more, whether its anchor occurs in other segments too, and which shard stands for a
   segment that several have.
2. A segment that occurs twice is repeated as a whole. Where an anchor has several segments, parts of them may be equal: the shard
   builds the suffix array of those stretches of its documents (Larsson-Sadakane refinement: ranks by 8 bytes, then doubling, sorting
   only groups that are still tied), and common prefixes of neighbours by Kasai's rule that a common prefix
   shrinks by one from a text position to the next. Neighbours sharing WIDTH bytes are repeats within the shard.
3. The shard's distinct windows, sorted by fingerprint, are merged with all other shards' by binary search in the sorted lists.
Bytes of all repeated windows are removed. Everything a group of copies adds is one entry per shard.

Defined cases: null texts are empty. Windows never cross documents. Every row is a document: equal rows are repeats of each other, also
where doc_id and text are both equal. The text of such rows is read once, its segments count twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import runs as R
from tallyhouse.llm import shards as S
from tallyhouse.llm import words as W

WIDTH, PIECE = 200, 32
SHARD_BYTES = 3 << 20
_BYTE = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
REPEATED, MIXED, OWNER = 1, 2, 4


class Text:
    """Bytes of a shard's distinct documents in a row, with a prefix sum of their hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(data)
        self.end = np.repeat(bounds[1:], np.diff(bounds))  # where the document of a byte ends
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE[data] * W.powers(W.BASE, self.n), out=self.sums[1:])
        self.back = W.powers(W.INVERSE, self.n + 1)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return W.mixed((self.sums[stop] - self.sums[start]) * self.back[start])


class Segments:
    """Stretches of windows with one anchor: windows first..last, anchor position, and 64-bit names of anchor and content."""

    def __init__(self, text: Text, width: int, piece: int):
        n, span = text.n, width - piece + 1
        self.width = width
        starts = np.flatnonzero(np.arange(max(0, n - width + 1)) + width <= text.end[: max(0, n - width + 1)])
        if not len(starts):
            self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        pieces = np.arange(n - piece + 1)
        ranked = (text.hash(pieces, pieces + piece) >> np.uint64(32) << np.uint64(32)) | pieces.astype(np.uint64)
        at = _sliding_least(ranked, span)[starts] & np.uint64(0xFFFFFFFF)
        at = at.astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
        begin = np.flatnonzero(new)
        self.first = starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1]
        at = at[begin]
        self.anchor = text.hash(at, at + piece)
        shape = (at - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        self.content = W.mixed(text.hash(self.first, self.last + width) ^ W.mixed(shape))

    def distinct(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (anchor, content), how often each occurs (a segment counts by its weight), the first segment of each, and
        each segment's place."""
        order = np.lexsort((self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[begin], c[begin], np.bincount(place, weight, len(begin)).astype(np.int64), order[begin], place


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of each `span` consecutive ones, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data sorted by the `depth` bytes (at least) that follow; ties stay in order of position."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    begin = np.ones(n, bool)
    begin[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(begin, np.arange(n), 0))  # a group's rank is its first place
    rank[order] = head
    step = 8
    while step < depth:
        tied = np.flatnonzero(~begin | ~np.append(begin[1:], True))  # places in groups of two or more
        if not len(tied):
            break
        at = order[tied]
        follow = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        by = np.lexsort((at, follow, head[tied]))
        at, follow, group = at[by], follow[by], head[tied]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        begin[tied] |= new
        head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = head[tied]
        step *= 2
    return order


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that the suffix at each place of the array shares with the one before it, up to the ends of their stretches."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.full(n, -1, np.int64)
    out[before < 0] = 0
    carried = np.zeros(n, bool)  # the neighbour moved on by one too: one byte less is shared
    carried[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (end[1:] == end[:-1])
    fresh = np.flatnonzero(~carried & (before >= 0))
    out[fresh] = _shared(data, end, fresh, before[fresh])
    source = np.maximum.accumulate(np.where(carried, 0, np.arange(n)))
    follows = np.flatnonzero(carried)
    value = out[source[follows]] - (follows - source[follows])
    out[follows] = value
    lost = follows[value < 0]
    out[lost] = _shared(data, end, lost, before[lost])
    return out[order]


def _shared(data: np.ndarray, end: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and q, within their stretches."""
    most = np.minimum(end[p] - p, end[q] - q)
    out, active, step = np.zeros(len(p), np.int64), np.arange(len(p)), 16
    while len(active):
        more = out[active][:, None] + np.arange(step)
        inside = more < most[active][:, None]
        last = len(data) - 1
        equal = inside & (data[np.minimum(p[active][:, None] + more, last)] == data[np.minimum(q[active][:, None] + more, last)])
        run = np.where(equal.all(1), step, equal.argmin(1))
        out[active] += run
        active = active[run == step]
        if step < 4096 and len(active) * step < 1 << 20:
            step *= 2
    return out


def documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of each row, and the bytes of all documents with their bounds. Documents stand in order of their marks: a shard's
    rows leave each exchange in another order, and what one task decided by position the next one reads."""
    table = table.combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts if not isinstance(texts, pa.ChunkedArray) else pa.array([], pa.string())
    seen: dict = {}
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("mark").to_pylist(), strict=True))
    doc = np.array([seen.setdefault(r, len(seen)) for r in rows], np.int64)
    first = np.unique(doc, return_index=True)[1] if len(rows) else np.zeros(0, np.int64)
    order = np.array(sorted(range(len(first)), key=lambda d: rows[first[d]][1]), np.int64)  # equal marks, equal bytes
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[doc], *W.byte_view(texts.take(pa.array(first[order], pa.int64())))


class Shard:
    """A shard's texts: what to ask about, and what suffix arrays say."""

    def __init__(self, table: pa.Table, width: int, piece: int):
        self.width = width
        doc, data, bounds = documents(table)
        self.text = Text(data, bounds)
        self.segments = Segments(self.text, width, piece)
        rows = np.minimum(np.bincount(doc, minlength=len(bounds) - 1), 2)  # twice is as good as more often
        weight = rows[np.searchsorted(bounds, self.segments.first, "right") - 1]
        self.anchors, self.contents, self.count, self.sample, self.place = self.segments.distinct(weight)

    def stretches(self, said: np.ndarray) -> None:
        """Suffix array over the windows that segments said to be mixed leave open."""
        seg, verdict = self.segments, said.astype(np.int64)
        self.verdict = verdict[self.place]
        chosen = (self.verdict & MIXED > 0) & (self.verdict & REPEATED == 0)
        owned = (verdict & MIXED > 0) & (verdict & REPEATED > 0) & (verdict & OWNER > 0)
        chosen[self.sample[owned]] = True
        first, last = seg.first[chosen], seg.last[chosen]
        stop = last + self.width
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] > stop[:-1]) | (self.text.end[first[1:]] != self.text.end[first[:-1]]) if len(first) else True
        begin = np.flatnonzero(fresh)
        a, b = first[begin], stop[np.append(begin[1:], len(first)) - 1] if len(first) else first
        size = b - a + 1  # and a separator
        at = np.cumsum(size) - size
        total = int(size.sum())
        self.source = np.arange(total) - np.repeat(at - a, size)  # where a byte stands in the text
        gap = np.zeros(total, bool)
        gap[at + size - 1] = True
        data = np.where(gap, 255, self.text.data[np.minimum(self.source, max(0, self.text.n - 1))] if total else 0).astype(np.uint8)
        end = np.repeat(at + size - 1, size)
        open_ = np.zeros(self.text.n + 1, np.int64)
        np.add.at(open_, first, 1)
        np.add.at(open_, last + 1, -1)
        window = (np.cumsum(open_[:-1]) > 0)[np.minimum(self.source, max(0, self.text.n - 1))] & ~gap if total else np.zeros(0, bool)
        order = suffix_array(data, self.width)
        long = common_prefixes(data, end, order) >= self.width
        whole = end[order] - order >= self.width
        group = np.cumsum(~long)
        same = np.bincount(group[whole], minlength=int(group[-1]) + 1 if total else 1)
        self.windows = self.source[order[window[order]]]  # window starts in order of their bytes
        self.group = group[window[order]]
        self.twice = same[self.group] > 1
        new = np.ones(len(self.group), bool)
        new[1:] = self.group[1:] != self.group[:-1]
        prints = self.text.hash(self.windows[new], self.windows[new] + self.width)
        self.prints, self.print_place = np.unique(prints, return_inverse=True)
        self.of = np.cumsum(new) - 1

    def decided(self) -> bytes:
        """What the shard knows by itself: the bytes that go, and the open windows with the places of their fingerprints."""
        seg, edge = self.segments, np.zeros(self.text.n + 1, np.int32)
        whole = self.verdict & REPEATED > 0
        np.add.at(edge, seg.first[whole], 1)
        np.add.at(edge, seg.last[whole] + self.width, -1)
        gone = self.windows[self.twice]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.width, -1)
        parts = [np.packbits(np.cumsum(edge[:-1]) > 0).tobytes(), *(S.planes(x[~self.twice]) for x in (self.windows, self.print_place[self.of]))]
        raw = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def removed(said: bytes, elsewhere: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n bytes go, from what the shard decided and, of each distinct fingerprint, whether another shard has it."""
    raw, at, parts = pa.decompress(said[8:], decompressed_size=int.from_bytes(said[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    windows, place = (S.unplaned(p).astype(np.int64) for p in parts[1:])
    late, edge = windows[elsewhere[place] > 0] if len(place) else windows, np.zeros(n + 1, np.int32)
    np.add.at(edge, late, 1)
    np.add.at(edge, late + width, -1)
    return (np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n) > 0) | (np.cumsum(edge[:-1]) > 0)


def _verdicts(keys: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """For each shard's sorted (anchor, content): REPEATED, MIXED and OWNER bits."""
    both = [np.split(S.unplaned(x), 2) for x in extras]
    anchor, content = np.concatenate(keys), np.concatenate([c for c, _ in both])
    count = np.concatenate([n for _, n in both]).astype(np.int64)
    order = np.lexsort((np.arange(len(anchor)), content, anchor))
    a, c = anchor[order], content[order]
    new_anchor, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new[1:] = new_anchor[1:] | (c[1:] != c[:-1])
    segment, group = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
    total = np.bincount(segment, count[order])
    contents = np.bincount(group, new)
    out = np.empty(len(a), np.uint64)
    out[order] = REPEATED * (total[segment] > 1) + MIXED * (contents[group] > 1) + OWNER * new
    return S.parted(out, keys)


def _elsewhere(key, table: pa.Table) -> pa.Table:
    """For each shard's sorted fingerprints, whether another shard has them: binary search in the merged list. What a shard decided
    (under a range of its own below 0) passes through."""
    if key[0].as_py() < 0:
        return pa.table({"shard": table.column("shard"), "range": table.column("range"), "data": table.column("extra")})
    keys = [S.undeltas(x.as_py()) for x in table.column("keys")]
    merged = np.sort(np.concatenate(keys))
    found = [(np.searchsorted(merged, k, "right") - np.searchsorted(merged, k, "left") > 1).astype(np.uint64) for k in keys]
    return pa.table({"shard": table.column("shard"), "range": table.column("range"), "data": pa.array([S.planes(f) for f in found], pa.binary())})


def deduplicated(docs: DataFrame, width: int = WIDTH, piece: int = PIECE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, mark, kept (the remaining bytes), n_bytes, n_removed and n_spans of every row."""
    rows, shards = S.sharded(docs, shard_bytes)

    def ask(key, table):
        s = Shard(table, width, piece)
        return S.question(key[0].as_py(), s.anchors, lambda r: S.planes(np.concatenate((s.contents[r], np.minimum(s.count[r], 2).astype(np.uint64)))), shards)

    def compare(key, table, answers):
        s = Shard(table, width, piece)
        s.stretches(S.gathered(answers, len(s.anchors)))
        asked, shard = S.question(key[0].as_py(), s.prints, lambda r: b"", shards), key[0].as_py()
        own = pa.table([pa.array([-1 - shard], pa.int32()), pa.array([shard], pa.int32()), pa.array([b""], pa.binary()), pa.array([s.decided()])], names=asked.column_names)
        return pa.concat_tables([asked, own])

    def finish(key, table, answers):
        answers = answers.combine_chunks()
        own = np.asarray(answers.column("range").to_pylist(), np.int64) < 0
        said, found = answers.filter(pa.array(own)).column("data")[0].as_py(), answers.filter(pa.array(~own))
        rows = sorted(zip(found.column("range").to_pylist(), found.column("data").to_pylist(), strict=True))
        elsewhere = np.concatenate([S.unplaned(d) for _, d in rows]) if rows else np.zeros(0, np.uint64)
        doc, data, bounds = documents(table)
        gone = removed(said, elsewhere, len(data), width)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        starts[inner] = gone[inner]
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        per = lambda flags: pa.array(np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])[doc])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "mark": table.column("mark"),
                "kept": pa.array([kept[d] for d in doc], pa.binary()),
                "n_bytes": pa.array(np.diff(bounds)[doc]),
                "n_removed": per(gone),
                "n_spans": per(starts),
            }
        )

    first = S.answered(rows.groupBy("shard").applyInArrow(R.lean(ask), S.ROWS), _verdicts).repartition(shards, "shard")
    questions = rows.groupBy("shard").cogroup(first.groupBy("shard")).applyInArrow(R.lean(compare, 2), S.ROWS)
    second = questions.groupBy("range").applyInArrow(lambda key, table: _elsewhere(key, table), S.ANSWERS)
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("mark binary, kept binary, n_bytes long, n_removed long, n_spans long").fields])
    return rows.groupBy("shard").cogroup(second.groupBy("shard")).applyInArrow(R.lean(finish, 2), out)


def query(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
