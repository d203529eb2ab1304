"""Exact duplicates, the Merkle manifest and collocations against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import prose
from pyspark.sql import functions as F

from tallyhouse.llm import automata, exact, manifest, phrases

SPACE = re.compile(r"[\x20\x09-\x0D]")


# Exact duplicates


def kept_rows(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for plain, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out[(m[3], members[0][3], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size,mark", [(4096, F.xxhash64), (16, F.xxhash64), (7, lambda b: F.length(b).cast("long"))])
def test_exact_duplicates_by_brute_force(spark, docs, odd_rows, size, mark):
    rows = [*odd_rows, *((20 + k, prose(1, 6000).replace(" ", "  " if k == 4 else "\n")) for k in range(6)), (40, "onetwo"), (41, "o n e two"), (42, "one\ntwo")]
    found = exact.duplicates(docs(*rows), size, mark=mark)
    assert Counter(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == kept_rows(rows)


def test_exact_duplicates_of_no_rows_and_carried_columns(spark, docs):
    assert exact.duplicates(docs(), carry=("text",)).collect() == []
    named = spark.createDataFrame([(1, "a b", "x", 5), (2, "ab", "y", 6)], "doc_id long, text string, row string, name int")
    found = exact.duplicates(named, carry=("row", "name", "text"))
    assert sorted((r.doc_id, r.keep_id, r.kept, r["row"], r["name"], r["text"]) for r in found.collect()) == [(1, 1, True, "x", 5, "a b"), (2, 1, False, "y", 6, "ab")]


def test_exact_duplicates_stay_in_the_engine(spark, docs):
    plan = exact.duplicates(docs((1, "a"), (2, "b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Merkle manifest


def test_van_emde_boas_addresses():
    for levels in range(1, 8):
        at = manifest.places(levels)
        assert sorted(p for row in at for p in row) == list(range(manifest.nodes(levels)))
    upper = 2  # of 4 levels: each lower subtree of 2 levels is one run behind the upper one
    at = manifest.places(4)
    for k, root in enumerate(at[upper]):
        assert root == manifest.nodes(2) + k * manifest.nodes(2)
        assert at[3][3 * k : 3 * k + 3] == [root + 1, root + 2, root + 3]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def manifest_rows(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[(r[1] is not None, (r[1] or "").encode())].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    keys = sorted(trees)
    grown = {k: climbed([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in keys}
    top = climbed([grown[k][-1][0] for k in keys])
    out = Counter()
    for place, k in enumerate(keys):
        for at, (_, _, own, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            tampered = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node, seen, i = leaf(r, tampered), [], at
            for levels, start in ((grown[k], at), (top, place)):
                i = start
                for level in levels[:-1]:
                    run = level[i // 3 * 3 : i // 3 * 3 + 3]
                    seen += run[: i % 3] + run[i % 3 + 1 :]
                    node = h(*run[: i % 3], node, *run[i % 3 + 1 :])
                    i //= 3
            out[(r[0], own, grown[k][-1][0], top[-1][0], h(*seen), node, node == top[-1][0])] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [6, 1, 2])
def test_manifest_by_brute_force(spark, height):
    rows = [(k, f"site{k % 7 if k % 3 else 0}", "en" if k % 5 else None, k, f"line {k}\nend" if k % 4 else "plain") for k in range(400)]
    rows += [(900, None, None, None, None), (901, None, "de", 3, ""), (902, "", "de", 3, "ä\n"), (903, "ö", "de", 3, "\n"), (904, "ö", "de", 3, "x"), (904, "ö", "de", 3, "y"), (None, "ö", "de", 3, "y\n")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    made = manifest.manifest(frame, {"claimed": manifest.tampered()}, height=height)
    found = manifest.proofs(made, frame.schema["doc_id"], height=height)
    got = Counter(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == manifest_rows(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "s", "en", 1, "a\nb")]
    frame = spark.createDataFrame(one, SCHEMA)
    made = manifest.manifest(frame, {"claimed": manifest.tampered()})
    (row,) = manifest.proofs(made, frame.schema["doc_id"]).collect()
    assert (row.leaf, row.subroot, row.root, row.path, row.proof_sha256) == (made.root, made.root, made.root, "", h())
    empty = manifest.manifest(frame.limit(0))
    assert empty.root is None and manifest.proofs(empty, frame.schema["doc_id"]).collect() == []


def test_a_changed_leaf_is_found(spark):
    rows = [(k, "s", "en", 1, f"text {k}") for k in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    made = manifest.manifest(frame, {"claimed": F.when(F.col("doc_id") == 7, F.lit("0" * 64))})
    assert [r.doc_id for r in manifest.proofs(made, frame.schema["doc_id"]).where("NOT verified").collect()] == [7]


# Collocations


def pieces(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def best_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[(lang or "und", *w[i : i + size])] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, b in candidates.items():
        for size in range(2, len(p) - 1):
            for i in range(1, len(p) - size + 1):
                inner = (p[0], *p[i : i + size])
                if 100 * b >= 80 * f[inner]:
                    dropped.add(inner)
    found = defaultdict(list)
    for p, a in candidates.items():
        if p not in dropped:
            cuts = [(2000000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    out = set()
    for lang, listed in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def spoken(seed, n):
    words = prose(seed, n).split()
    return " ".join(w[:4] + ("." if k % 11 == 0 else "") for k, w in enumerate(words))


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 700, "range_bytes": 900, "fan": 3}, {"part_bytes": 1 << 20, "range_bytes": 300, "fan": 1000}])
def test_collocations_by_brute_force(spark, sizes):
    rows = [(spoken(k, 300 + 20 * k), ("en", "de", None, "und")[k % 4]) for k in range(24)]
    rows += [("New York, new york! NEW\tyork?\nnew  york; Ä é " * 40, "en"), (None, "en"), ("", None), (". , \n", "fr"), ("日本 語 " * 90, "ja"), ("x" * 5000 + " y", "en")]
    rows += [("one two three four five", "en")] * 30
    found = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), least=20, top=50, **sizes)
    assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == best_phrases(rows, 20, 50)


LARGE = [{"part_bytes": 700, "range_bytes": 900, "wide_bytes": 900, "fan": 3, "group_bytes": 300, "slice_bytes": 2000}, {"part_bytes": 700, "range_bytes": 900, "fan": 3, "slice_bytes": 900}]


@pytest.mark.parametrize("sizes", LARGE)
def test_collocations_of_many_groups_and_slices(spark, sizes):
    rows = [(spoken(k, 300 + 20 * k) + " new york" * 200, ("en", "de", None, "und")[k % 4]) for k in range(24)]
    found = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), least=20, top=50, **sizes)
    assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == best_phrases(rows, 20, 50)


def test_parts_that_meet_are_bounded(spark, tmp_path, monkeypatch):
    uniting = phrases._uniting

    def spied(*args):
        run, folder = uniting(*args), str(tmp_path)

        def one(key, table):
            with open(f"{folder}/{key[0].as_py()}-{key[1].as_py()}", "w") as file:
                file.write(str(table.num_rows))
            return run(key, table)

        return one

    monkeypatch.setattr(phrases, "_uniting", spied)
    rows = [(spoken(k, 1200), "en") for k in range(32)]
    sizes = {"part_bytes": 700, "range_bytes": 2000, "fan": 8} | ({"wide_bytes": 2000, "group_bytes": 2000} if hasattr(phrases, "WIDE_BYTES") else {})
    phrases.counts(spark.createDataFrame(rows, "text string, lang string").repartition(4), **sizes)
    met = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(met) > 1000 and max(met) < 60  # of some 300 parts


def test_a_large_range_is_united_in_slices():
    trees = [small_tree(k, 400) for k in range(9)]
    total = sum((counts for _, counts in trees), Counter())
    blobs = pa.chunked_array([pa.array([automata.dumped(automata.frozen(t)) for t, _ in part], pa.binary()) for part in (trees[:4], trees[4:])])
    want = {p: w for p, w in total.items() if w >= 3}
    for slice_bytes in (1 << 20, 2000, 100):
        assert {p: w for p, w in sequences(phrases.frequent(blobs, 3, slice_bytes)).items() if w} == want


def test_collocations_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def sequences(t):
    out = {}
    paths = [()]
    for v in t.levels:
        paths = [(*paths[p], t.symbols[x].as_py()) for p, x in zip(v.parent.tolist(), v.label.tolist(), strict=True)]
        out |= dict(zip(paths, v.weight.tolist(), strict=True))
    return out


def small_tree(seed, n):
    draw = np.random.default_rng(seed)
    rows = [["".join(draw.choice(list("abc"), draw.integers(1, 3))) for _ in range(draw.integers(1, 5))] for _ in range(n)]
    symbols, rank = automata.ranked(pa.array([w for r in rows for w in r], pa.large_string()))
    at = np.cumsum([0] + [len(r) for r in rows])
    columns = [np.array([rank[at[k] + d] if d < len(r) else -1 for k, r in enumerate(rows)]) for d in range(4)]
    counts = Counter(tuple(r[: d + 1]) for r in rows for d in range(len(r)))
    return automata.tree(symbols, columns)[0], counts


def test_automata_count_unite_and_cut():
    trees = [small_tree(k, 50 + 100 * k) for k in range(4)]
    total = Counter()
    for t, counts in trees:
        assert sequences(t) == counts
        total += counts
    frozen = [automata.loaded(automata.dumped(automata.frozen(t))) for t, _ in trees]
    whole = automata.union(frozen)
    assert sequences(whole) == total
    assert {p: w for p, w in sequences(automata.pruned(whole, 3)).items() if w} == {p: w for p, w in total.items() if w >= 3}
    parts = [p for _, p in automata.parted(whole, automata.routes(whole, 2, 5))]
    assert len(parts) > 1 and sequences(automata.union([automata.frozen(p) for p in parts])) == total
    weights = automata.composed(trees[0][0], frozen[1])
    asked = [p for p in sequences(trees[0][0])]
    assert dict(zip(asked, [w for level in weights for w in level.tolist()], strict=True)) == {p: trees[1][1].get(p, 0) for p in asked}


def test_automata_are_minimal():
    t, _ = small_tree(9, 300)
    a = automata.frozen(t)
    states = [tuple(zip(a.label[i:j].tolist(), a.weight[i:j].tolist(), a.target[i:j].tolist(), strict=True)) for i, j in zip(a.first, a.first[1:], strict=False)]
    assert len(set(states)) == len(states) < sum(len(v.label) for v in t.levels)
