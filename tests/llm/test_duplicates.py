"""Near-duplicates, word and byte repeats, and components against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import prose

from tallyhouse.llm import minhash, runs, shards, substrings, suffixes
from tallyhouse.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def edited(text, seed, share):
    import random

    draw = random.Random(seed)
    return " ".join(w if draw.random() > share else f"new{draw.randrange(99)}" for w in text.split())


@pytest.fixture(scope="module")
def near_rows(odd_rows):
    base, line = prose(50, 150), prose(51, 30)
    rows = list(odd_rows)
    rows += [(100 + k, edited(base, k, 0.01 + 0.0015 * k)) for k in range(60)]
    rows += [(300 + k, line + " " + prose(400 + k, 12 + k)) for k in range(60)]
    rows += [(500 + k, base.upper()) for k in range(10)]
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize("block", [1024, 7])
def test_groups_by_brute_force(spark, docs, near_rows, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    sets = [shingles(t) for _, t in near_rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(near_rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(near_rows, sets, strict=True)))
    rows = minhash.near_duplicates(docs(*near_rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    chosen = Counter(r.component_id for r in rows if r.chosen and r.n_shingles and r.doc_id not in (None, 7, 12))
    assert max(chosen.values()) == 1


def test_no_rows_no_groups(docs, spark):
    assert minhash.near_duplicates(docs((1, "a")).where("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    found = dict(runs.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[k] for k in range(1, 41)} == {1} and {found[k] for k in range(100, 160)} == {100}
    assert runs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_by_words(rows, width):
    """Distinct documents in order of id and checksum; positions covered by windows seen before."""
    import zlib

    order = sorted({(i is not None, i or 0, zlib.crc32(t.encode()) if t is not None else -1, t) for i, t in rows}, key=lambda r: r[:3])
    seen, gone = set(), {}
    for known, i, _, t in order:
        w = WORD.findall(t or "")
        cut = set()
        for k in range(len(w) - width + 1):
            gram = tuple(w[k : k + width])
            if gram in seen:
                cut |= set(range(k, k + width))
            seen.add(gram)
        gone[(i if known else None), t] = (len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut))
    return gone


@pytest.mark.parametrize("shard_bytes", [3000, 1 << 23])
def test_word_repeats_by_brute_force(docs, near_rows, shard_bytes):
    extra = [(900, "l m " + prose(70, 30) + " p q"), (901, "l2 " + prose(70, 30) + " p2"), (902, prose(70, 21)), (903, " ".join(["tick"] * 90)), (904, " ".join(["tick tock"] * 50))]
    rows = [*near_rows, *extra]
    want = repeats_by_words(rows, 20)
    found = substrings.deduplicated(docs(*rows).selectExpr("doc_id", "text", "doc_id AS mark2"), shard_bytes=shard_bytes, carry=("mark2",)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id, r.text]
        assert r.mark2 == r.doc_id
    assert substrings.deduplicated(docs((1, "a")).where("false")).count() == 0


def test_branching_paths_of_equal_frequency(docs):
    """Edges met equally often, though not by the same documents, are told apart."""
    a, b, c, d, mid = (prose(k, 25) for k in (81, 82, 83, 84, 85))
    rows = [(1, f"{a} {mid}"), (2, f"{b} {mid}"), (3, f"{a} {c}"), (4, f"{b} {d}"), (5, f"{mid} {c}"), (6, f"{d} {mid}")]
    want = repeats_by_words(rows, 20)
    for r in substrings.deduplicated(docs(*rows)).collect():
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id, r.text]


@pytest.mark.parametrize("shard_bytes", [3000, 1 << 22])
def test_byte_repeats_by_brute_force(docs, near_rows, shard_bytes):
    same = prose(90, 31)[:200]
    extra = [(910, "é" * 150), (911, same), (912, "z" + same), (913, same[:199]), (914, "ab" * 200), (915, "q" + "ab" * 130), (916, same[:150] + "!" + same)]
    rows = [*near_rows, *extra]
    distinct = {(i, t or "") for i, t in rows}
    count = Counter(b[k : k + 200] for _, t in distinct for b in [t.encode()] for k in range(len(b) - 199))
    found = suffixes.deduplicated(docs(*rows), shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    kept = Counter()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    for r in found:
        kept[r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()] += 1
    assert kept == want
    assert suffixes.deduplicated(docs((1, "a")).where("false")).count() == 0


def test_rows_equal_in_id_and_text_repeat_each_other(docs):
    twice, part, short = prose(60, 60), prose(60, 60)[40:300], "too short to repeat"
    rows = [(1, twice), (1, twice), (2, prose(61, 50)), (3, short), (3, short), (4, part + prose(62, 9)), (None, prose(63, 40)), (None, prose(63, 40))]
    found = Counter((r.doc_id, r.n_bytes - r.n_removed, r.n_spans) for r in suffixes.deduplicated(docs(*rows), shard_bytes=700).collect())
    rest = len(prose(62, 9))
    assert found == Counter([(1, 0, 1)] * 2 + [(2, len(prose(61, 50)), 0)] + [(3, len(short), 0)] * 2 + [(4, rest, 1)] + [(None, 0, 1)] * 2)


def test_decisions_hold_for_rows_in_another_order():
    """Executors read the parts of a shard in any order: what one task decides by position, another finds at the same bytes."""
    shared = prose(63, 50)
    texts = [prose(64, 90), shared + prose(65, 40), None, prose(66, 70) + shared[:250], prose(64, 90), "short", prose(67, 120), prose(68, 10) + shared[100:320]]
    marks = [hashlib.sha256(t.encode()).digest()[:16] if t else b"" for t in texts]
    table = pa.table({"doc_id": [5, 1, 2, None, 4, 7, 3, 6], "mark": pa.array(marks, pa.binary()), "text": texts})
    count = Counter(b[k : k + 200] for t in texts if t for b in [t.encode()] for k in range(len(b) - 199))
    want = {}
    for i, t in zip(table.column("doc_id").to_pylist(), texts, strict=True):
        b = (t or "").encode()
        want[i] = len({k + j for k in range(len(b) - 199) if count[b[k : k + 200]] > 1 for j in range(200)})
    s = suffixes.Shard(table, 200, 32)
    asked = shards.planes(np.concatenate((s.contents, s.count.astype(np.uint64))))
    s.stretches(suffixes._verdicts([s.anchors], [asked])[0])
    said, elsewhere = s.decided(), np.zeros(len(s.prints), np.uint64)
    for order in (range(8), range(7, -1, -1), (3, 7, 0, 5, 2, 6, 1, 4)):
        again = table.take(list(order))
        doc, data, bounds = suffixes.documents(again)
        gone = suffixes.removed(said, elsewhere, len(data), 200)
        found = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])[doc]
        assert dict(zip(again.column("doc_id").to_pylist(), found.tolist(), strict=True)) == want


def test_answers_do_not_depend_on_the_order_of_questions(spark):
    keys = np.array([3, 9], np.uint64)
    first = lambda keys, extras: [np.full(len(k), n, np.uint64) for n, k in enumerate(keys)]
    for order in ((2, 0, 1), (0, 1, 2), (1, 2, 0)):
        rows = [(0, shard, bytearray(shards.deltas(keys)), bytearray()) for shard in order]
        found = shards.answered(spark.createDataFrame(rows, shards.ROWS).coalesce(1), first).collect()
        assert {r.shard: shards.unplaned(bytes(r.data)).tolist() for r in found} == {k: [k, k] for k in range(3)}


def test_suffix_array_and_common_prefixes():
    draw = np.random.default_rng(3)
    data = draw.integers(97, 99, 700).astype(np.uint8)
    data = np.concatenate((data, [255], data[100:600], [255])).astype(np.uint8)
    end = np.concatenate((np.full(701, 700), np.full(501, 1201)))
    order = suffixes.suffix_array(data, 64)
    raw = data.tobytes()
    assert all(raw[a : a + 64] <= raw[b : b + 64] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
    shared = suffixes.common_prefixes(data, end, order)

    def common(p, q):
        n = 0
        while p + n < end[p] and q + n < end[q] and raw[p + n] == raw[q + n]:
            n += 1
        return n

    assert shared.tolist() == [0] + [common(p, q) for p, q in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]


def test_keys_survive_packing():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (shards.undeltas(shards.deltas(keys)) == keys).all()
    at = shards.cut(keys, 7)
    assert at[0] == 0 and at[-1] == 1000 and (np.diff(at) >= 0).all()
    values = np.array([0, 1, 255, 256, 1 << 40], np.uint64)
    assert (shards.unplaned(shards.planes(values)) == values).all()
    assert len(shards.unplaned(shards.planes(np.zeros(0, np.uint64)))) == 0


def test_windows_stay_within_texts():
    import pyarrow as pa

    found = W.words(pa.array(["a b c", None, "a b", "c a b c"]))
    assert found.bounds.tolist() == [0, 3, 3, 5, 9]
    starts = W.window_starts(found.bounds, 3)
    assert starts.tolist() == [0, 5, 6]
    keys = W.windows(W.hashes(found.distinct)[found.codes], 3)[starts]
    assert keys[0] == keys[2] != keys[1]


def same_checksum():
    """Two texts of one crc32, found among fresh ones: 80 000 of them hold such a pair almost surely."""
    import random
    import zlib

    draw = random.Random(5)
    seen, tail = {}, prose(77, 60)
    for _ in range(400_000):
        text = f"start{draw.getrandbits(64):x} {tail}"
        mark = zlib.crc32(text.encode())
        if mark in seen:
            return seen[mark], text
        seen[mark] = text
    raise AssertionError("no pair")


def test_texts_of_equal_checksum_stay_apart(spark, docs):
    import corpus_pipeline

    a, b = same_checksum()
    frame = docs((None, a), (None, b), (None, "something else entirely, for all to read"))
    assert corpus_pipeline.near_dedup(spark, frame, "").count() == 2  # a and b are near copies: one of them stays
    found = {r.kept for r in suffixes.deduplicated(docs((None, a), (None, b))).collect()}
    assert len(found) == 2
    removed = sorted(r.n_removed for r in substrings.deduplicated(docs((None, a), (None, b))).collect())
    assert removed[0] == 0 and removed[1] > 30
