"""Benchmark decontamination with generalised suffix automata of the normalised test items.

Items are normalised (A to Z in lower case; words of letters, digits and non-ASCII characters) and built into suffix
automata, each over at most BLOCK_WORDS words: a larger item table becomes several automata, through which every document
streams one after the other. The state reached after a token says how long a run of tokens, ending there, occurs in some
item; where that is a whole window (WINDOW words, or a whole shorter item) its words are hit.

Defined cases: null or wordless texts and items have no words and match nothing. An item with a null item_id marks words but is
not counted or listed. Repeated items count once per item_id. Rows with equal or null doc_id are judged each for itself. An
empty item table leaves every document clean. Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyhouse.llm import words as W

WINDOW = 13
#: Words in one automaton; bounds what the driver builds at a time and sends to the executors.
BLOCK_WORDS = 100_000

#: Bytes of words; A to Z map to a to z, all other ASCII bytes separate words.
_BYTES = np.array(
    [b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8
)


def normalised(texts: pa.Array) -> pa.Array:
    data, at = W.byte_view(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.tobytes()), pa.py_buffer(_BYTES[data].tobytes()))


class Automaton:
    """Suffix automaton of word sequences, with the items whose windows each state stands for."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [(name, seq) for name, seq in items if seq]
        for _, seq in self.items:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.vocabulary = frozenset(w for _, seq in self.items for w in seq)
        self.shortest = min((min(window, len(seq)) for _, seq in self.items), default=0)
        self._mark()

    def _split(self, p: int, word: str, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: str) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _holding(self, state: int, length: int) -> int:
        """The state on the suffix path whose strings include the one of this length."""
        while self.length[self.link[state]] >= length > 0 and state:
            state = self.link[state]
        return state

    def _mark(self) -> None:
        """Per state: which items have a full window that ends in it, and which short items end in it or its suffixes."""
        self.full: dict[int, set[str | None]] = {}
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for name, seq in self.items:
            state = 0
            for i, word in enumerate(seq):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.full.setdefault(self._holding(state, self.window), set()).add(name)
            if len(seq) < self.window:
                ends.setdefault(self._holding(state, len(seq)), []).append((len(seq), name))
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if found := ends.get(state, []) + self.short.get(self.link[state], []):
                self.short[state] = found

    def stream(self, tokens: list[str]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, end, items) of every window of an item that ends at some token."""
        state, length = 0, 0
        for i, word in enumerate(tokens):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            target = self.next[state].get(word)
            if target is None:
                continue
            state, length = target, length + 1
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.full[self._holding(state, self.window)]
            for size, name in self.short.get(state, ()):
                if size <= length:
                    yield i + 1 - size, i + 1, {name}


def matches(automaton: Automaton, found: W.Words) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per text, the merged runs of hit words and the items. Only runs of item words long enough for a window are streamed."""
    n_texts = len(found.bounds) - 1
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in range(n_texts)]
    if not automaton.items or not len(found.codes):
        return out
    known = pc.is_in(found.distinct, pa.array(list(automaton.vocabulary), found.distinct.type)).to_numpy(zero_copy_only=False)
    inside = np.zeros(len(found.codes) + 1, bool)
    inside[:-1] = known[found.codes]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
    cuts = found.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(found.codes))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # a run never crosses texts
    starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    long = ends - starts >= automaton.shortest
    texts = np.searchsorted(found.bounds, starts, side="right") - 1
    for start, end, text in zip(starts[long].tolist(), ends[long].tolist(), texts[long].tolist(), strict=True):
        runs, items = out[text]
        base = start - int(found.bounds[text])
        here: list[tuple[int, int]] = []
        for a, b, names in automaton.stream(found.distinct.take(pa.array(found.codes[start:end])).to_pylist()):
            items.update(n for n in names if n is not None)
            here.append((base + a, base + b))
        for a, b in sorted(here):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
    return out


SCHEMA = "n_words long, spans array<struct<first: long, stop: long>>, items array<string>"


def item_blocks(items: DataFrame, window: int, block_words: int) -> list[Automaton]:
    """Automata over all items, each over about `block_words` words; one block's items are on the driver at a time."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its separator take two characters at least
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        found = W.words(normalised(pa.array([r.text for r in rows], pa.string())))
        seqs = [found.distinct.take(pa.array(found.codes[a:b])).to_pylist() for a, b in zip(found.bounds, found.bounds[1:], strict=False)]
        out.append(Automaton([(r.item_id, s) for r, s in zip(rows, seqs, strict=True)], window))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents' columns plus n_words, spans (runs of hit words) and items (ids whose windows occur)."""
    docs = docs.drop("n_words", "spans", "items")
    out = docs
    for automaton in item_blocks(items, window, block_words):
        out = _streamed(out, docs.columns, automaton)
    return out


def _streamed(docs: DataFrame, columns: list[str], automaton: Automaton) -> DataFrame:
    """One automaton over all documents; spans and items of earlier automata are merged with its own."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kept = [f for f in docs.schema.fields if f.name in columns]
    again = len(docs.columns) > len(columns)

    def run(batches):
        for batch in batches:
            found = W.words(normalised(batch.column("text")))
            hits = matches(shared.value, found)
            spans, items = [s for s, _ in hits], [sorted(i) for _, i in hits]
            if again:
                for k, (s, i) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    spans[k] = _merged([(x["first"], x["stop"]) for x in s] + spans[k])
                    items[k] = sorted({*i, *items[k]})
            kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array(np.diff(found.bounds)), pa.array([[{"first": a, "stop": b} for a, b in s] for s in spans], kind), pa.array(items, pa.list_(pa.string()))],
                names=[f.name for f in kept] + ["n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, StructType([*kept, *_parse_datatype_string(SCHEMA).fields]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: A run of hit words is cut out of a text if it has at least this many words, or this share of the text's words.
CUT_WORDS, CUT_SHARE = 13, 0.05


def cut_spans(found: DataFrame, cut_words: int = CUT_WORDS, cut_share: float = CUT_SHARE) -> DataFrame:
    """The result of `contamination` with the spans beyond a limit taken out of `text`, and n_cut, the words removed.

    A span goes if it has at least `cut_words` words, or at least `cut_share` of the text's words; `spans` lists those
    cut, in words of the original. The separators after a removed word go with it, all other characters stay as they were.
    A null text stays null.
    """
    size, words = (lambda x: x["stop"] - x["first"]), F.col("n_words")
    found = found.drop("n_cut")
    cut = found.withColumn("spans", F.filter("spans", lambda x: (size(x) >= cut_words) | (size(x) >= cut_share * words)))
    kind = StructType([f for f in cut.schema.fields if f.name != "text"]).add("text", "string").add("n_cut", "long")

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                texts.append(_without(text, [(x["first"], x["stop"]) for x in spans or []]))
                counts.append(sum(x["stop"] - x["first"] for x in spans or []))
            names = [f.name for f in kind.fields[:-2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*names, "text", "n_cut"])

    return cut.mapInArrow(run, kind).select(*found.columns, "n_cut")


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    starts = [m.start() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))] + [len(text)]
    kept, at = [], 0
    for first, stop in spans:
        kept.append(text[at : starts[first]])
        at = starts[stop]
    return "".join(kept) + text[at:]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


#: Contaminated: some word is hit, and hit words are at least one in this many.
SHARE = 20


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and the verdict, from spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"])
    return found.withColumn("n_hit", hit).select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return judged(contamination(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
hits AS (
  SELECT d.doc_id, d.i, g.size, g.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM dw, (SELECT DISTINCT size FROM grams))) d JOIN grams g ON g.gram = d.gram AND g.size = d.size),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
