"""Language, quality, decontamination, packing and language model against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from llm.helpers import prose
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, language, ngrams, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
SMALL = "/root/testdata/sf0.001"


def test_trigram_profiles_tell_languages_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, "u", 1.0, "q") for i, t in odd_rows], "doc_id long, text string, lang_pred string, score double, extra string")
    train = spark.createDataFrame([("alpha beta gamma", "g"), ("größe öde", "d"), (None, "d"), ("x", None)], "text string, lang string")
    found = language.identify(docs, *language.train(train))
    assert found.columns == ["doc_id", "text", "extra", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language.identify(docs, *language.train(train.where("false")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language.identify(docs.where("false"), *language.train(train)).count() == 0


def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_by_brute_force(spark, odd_rows):
    rows = [*odd_rows, (20, "a\na\n \nb # $\na"), (21, prose(9, 10) + " " + prose(9, 10))]
    given = spark.createDataFrame([(k, t, 5) for k, (_, t) in enumerate(rows)], "doc_id long, text string, n_words int")
    found = quality.statistics(given).orderBy("doc_id").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r[n] for n in names) for r in found] == [brute_statistics(t) for _, t in rows]


def test_outliers_are_rejected_in_groups_of_any_size(spark):
    clean = [(i, prose(i, 60 + i % 50), "en", "s1" if i % 3 else None) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 80).split()), "en", "s1") for i in range(20)]
    rare = [(2000 + i, " ".join(w + "$$$" for w in prose(i, 80).split()), "xx", None) for i in range(5)]
    rows = spark.createDataFrame([*clean, *junk, *rare, (3000, None, None, None), (3001, "short", "en", "s1")], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.judged(rows.withColumn("d2", F.lit(1))).collect()}
    assert len(found) == 427
    assert all(found[i].kept for i in range(400))
    assert not any(found[i].kept for i in range(1000, 1020))
    assert not any(found[i].kept or found[i].d2 is None for i in range(2000, 2005))
    assert found[3000].base_failed and found[3001].base_failed and not found[3001].kept
    assert quality.judged(rows.where("false")).count() == 0


def test_outliers_of_rare_languages_are_rejected(spark, tmp_path):
    def marked(i):
        return " ".join(w + "$$$" for w in prose(i, 80).split())

    def verdicts(name, *rows):
        spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
        return {r.doc_id: r for r in quality.query(spark, str(tmp_path / name)).collect()}

    clean = [(i, prose(i, 60 + i % 50), "en", "s1") for i in range(300)]
    rare = [(1000 + i, prose(5000 + i, 70), "xx", None) for i in range(5)]
    skewed = verdicts("skewed", *clean, *rare, *[(2000 + i, marked(i), "xx", None) for i in range(5)], (3000, None, "xx", None))
    assert all(skewed[i].kept for i in [*range(300), *range(1000, 1005)])
    assert not any(skewed[i].kept for i in [*range(2000, 2005), 3000])
    assert all(r.d2 is not None for r in skewed.values())
    even = verdicts("even", *[(i, prose(i, 60 + i % 50), "abcd"[i % 4], "s1") for i in range(200)], *[(1000 + i, marked(i), "abcd"[i % 4], "s1") for i in range(8)])
    assert all(r.d2 is not None and r.kept == (r.doc_id < 1000) for r in even.values())
    few = verdicts("few", *[(i, prose(9, 60), "a", "s1") for i in range(4)], (5, prose(8, 61), "b", "s1"), (1000, marked(9), "c", "s1"))
    assert all(r.d2 is not None and r.kept == (r.doc_id < 1000) for r in few.values())


def item_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER)) if w]


def brute_contamination(text, items):
    words, hit, found = item_words(text), set(), set()
    for name, item in items:
        seq = item_words(item)
        size = min(13, len(seq))
        grams = {tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)} if seq else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(found)


def test_spans_beyond_a_limit_are_cut(spark):
    item = " ".join(f"Word{i}" for i in range(15))
    long = " ".join(f"own{i}" for i in range(400))
    rows = [
        (1, f"Before it, {item}! After\tit.", "x"), (2, f"{long} {item} end", "x"), (3, f"{long} alpha beta. {long}", "x"), (4, "Alpha, beta gamma", "x"),
        (5, item, "x"), (6, None, "x"), (7, "", "x"), (8, long, "x"), (9, f"{item} | ünï {item}", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_cut string")
    items = spark.createDataFrame([(1, item), (2, "alpha beta"), (1, item)], "item_id long, text string")
    found = decontaminate.cut_spans(decontaminate.contamination(docs, items))
    got = {r.doc_id: (r.text, r.n_cut) for r in found.collect()}
    assert got[1] == ("Before it, After\tit.", 15) and got[2] == (f"{long} end", 15)
    assert got[3] == (rows[2][1], 0)  # two words of 802 stay
    assert got[4] == ("gamma", 2) and got[5] == ("", 15) and got[6] == (None, 0) and got[7] == ("", 0) and got[8] == (long, 0)
    assert got[9] == ("ünï ", 30)
    assert found.columns == ["doc_id", "text", "n_words", "spans", "items", "n_cut"]
    again = decontaminate.contamination(found.select("doc_id", "text"), items).select("doc_id", F.size("spans").alias("n")).collect()
    assert {r.doc_id for r in again if r.n} == {3}
    assert decontaminate.cut_spans(decontaminate.contamination(docs, items), 2, 1.0).where("doc_id = 3").first().n_cut == 2


def test_a_repeated_item_table_gives_the_same(spark):
    items = spark.createDataFrame([(i % 3, f"some item of the table number {i % 3}") for i in range(600)], "item_id long, text string")
    assert len(decontaminate.item_blocks(items, 13, 30)) <= 2
    docs = spark.createDataFrame([(1, "here some item of the table number 2 is")], "doc_id long, text string")
    assert decontaminate.contamination(docs, items, block_words=30).first()["items"] == ["2"]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 30])
def test_decontamination_by_brute_force(spark, odd_rows, block_words):
    shared = odd_rows[0][1]
    items = [(1, shared[:200]), (1, shared[:200]), (2, "one TWO"), (3, None), (4, ""), (None, prose(4, 20)), (10, "a b a b"), (9, "日本語"), (7, prose(6, 25)), (5, "two one two one")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(k, t, "s", 1) for k, (_, t) in enumerate(odd_rows)], "doc_id long, text string, spans string, n_hit long")
    found = decontaminate.judged(decontaminate.contamination(rows, table, block_words=block_words)).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        n, hit, names = brute_contamination(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items, list(r["items"])) == (n, hit, len(names), names)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert not any(r.contaminated for r in decontaminate.judged(decontaminate.contamination(rows, table.where("false"))).collect())


def test_tokens_equal_the_tokenizer_on_whole_texts(odd_rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = [t for _, t in odd_rows] + ["É'S don't it's x.Y", "<|endoftext|>a. b<|startoftext|>", "ΑΣ. ΟΔΟΣ ﬁ ²", "naïve café, Straße!?", "x\x00y \x1c z\x85w İ ǅ", "A.B.C... #x| <a|b>"]
    ids, bounds = packing.token_ids(pa.array(texts), path)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_is_gapless_and_tight(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows + [(100 + i, prose(i, 40 + 13 * i)) for i in range(60)], "doc_id long, text string")
    rows = packing.packed(docs, capacity=512, keep_ids=True).collect()
    sizes = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes[r.sequence_id] and r.length <= 512
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        sizes[r.sequence_id] += r.length
    total = sum(sizes.values())
    assert max(sizes.values()) <= 512 and len(sizes) <= -(-total // 512) + 1
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert packing.packed(docs.where("false")).count() == 0


def test_placing_prefers_the_smaller_sum_of_squares():
    import numpy as np

    bins, offsets = packing.place(np.array([6, 6, 4, 4, 10, 3, 3, 3, 1]), 10)
    full = Counter()
    for b, s in zip(bins.tolist(), [6, 6, 4, 4, 10, 3, 3, 3, 1], strict=True):
        full[b] += s
    assert sorted(full.values()) == [10, 10, 10, 10]
    assert offsets[4] == 0


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 23])
def test_interpolated_scores_by_brute_force(spark, odd_rows, shard_bytes):
    rows = [(k, t, k % 7 != 2) for k, (_, t) in enumerate([*odd_rows, *((None, prose(100 + i, 80)) for i in range(60))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    found = {r.doc_id: r for r in ngrams.scored(docs, shard_bytes).collect()}
    tokens = {k: [*WORD.findall((t or "").translate(UPPER)), None] for k, t, _ in rows}
    fold = {k: train and (zlib.crc32(t.encode()) if t is not None else -1) % ngrams.FOLDS == 0 for k, t, train in rows}
    one, two, kept_one, kept_two, n = Counter(), Counter(), Counter(), Counter(), 0
    for k, _, train in rows:
        if train:
            pairs = list(zip(["^", *tokens[k]], tokens[k]))
            one.update(["^", *tokens[k]])
            two.update(pairs)
            n += len(tokens[k])
            if not fold[k]:
                kept_one.update(["^", *tokens[k]])
                kept_two.update(pairs)
    size = len(one) - 1
    assert len(found) == len(rows)
    import numpy as np

    held = Counter()
    for k, _, _ in rows:
        if fold[k]:
            for v, w in zip(["^", *tokens[k]], tokens[k]):
                share = kept_two[v, w] / kept_one[v] if kept_one[v] else 0.0
                b = ngrams.bucket(np.array([kept_one[v]]))
                held[int(((b * ngrams._SPAN + ngrams._levels(np.array([share]))) * ngrams._SPAN + ngrams._levels(np.array([kept_one[w]])))[0])] += 1
    kept_tokens = sum(len(tokens[k]) for k, _, train in rows if train and not fold[k])
    keys = sorted(held)
    weights = ngrams.learn(np.array(keys, np.int64), np.array([held[c] for c in keys], float), kept_tokens, size)
    for k, _, train in rows:
        r = found[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[k]), sum(one[w] > 0 for w in tokens[k]), n, not train)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + size + 1)) for w in tokens[k]))
        want = 0.0
        for v, w in zip(["^", *tokens[k]], tokens[k]):
            a, b, c = weights[int(ngrams.bucket(np.array([one[v]]))[0])]
            want += math.log10(a * (two[v, w] / one[v] if one[v] else 0) + b * one[w] / n + c / (size + 1))
        assert r.score == pytest.approx(want)


def test_scores_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, train boolean")
    assert {(r.doc_id, r.n_known, r.train_tokens) for r in ngrams.scored(docs).collect()} == {(1, 0, 0), (2, 0, 0)}
    assert ngrams.scored(docs.where("false")).count() == 0


def test_interpolation_beats_single_tokens_on_held_out_texts(spark):
    rows = ngrams.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_language_sums_by_brute_force(monkeypatch):
    import numpy as np

    texts = ["Hello, World and 日本語 text", "", None, "ñandú x yz", "a b", "".join(chr(0x4E00 + (k * 7919) % 20000) for k in range(6000))]
    want = np.zeros((len(texts), language.DIMENSIONS))
    for k, t in enumerate(texts):
        low = " " + (t or "").lower() + " "
        for i in range(1, len(low) - 1):
            if low[i].isalpha():
                vector = np.ones(language.DIMENSIONS, np.int64)
                for shift, c in zip((2, 1, 0), low[i - 1 : i + 2], strict=True):
                    if c.isalpha():
                        vector = vector * np.roll(language._letter(ord(c)), shift)
                want[k] += vector
    for size in (2048, 50):
        monkeypatch.setattr(language, "SLICE", size)
        got, n = language._sums(texts, np.arange(len(texts)), len(texts))
        assert (got == want).all() and n[1] == n[2] == 0
    monkeypatch.setattr(language, "PART", 40)
    long = " ".join(["Hello world ñandú"] * 20)
    parts, _ = language._sums([long], np.zeros(1, np.int64), 1)
    monkeypatch.setattr(language, "PART", 1 << 20)
    assert (parts == language._sums([long], np.zeros(1, np.int64), 1)[0]).all()
