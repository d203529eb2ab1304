"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram of letters (word edges count as one more
letter) is the product of its letters' vectors, permuted by their place: roll(a, 2) * roll(b, 1) * c. A text is the sum of its
trigram vectors, a language the sum of its texts; the language whose vector has the largest cosine with the text's wins.

Texts are lower-cased and read whole. Sums are integers, so partitioning and retries change nothing.

Defined cases: a null text or one without a letter gives `und` and score 0, as does every text if no language was learned; rows
with a null text or label are not learned from. Repeated rows count as often as they occur. Ties go to the label that sorts first.
Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.runs import lean_stream

DIMENSIONS = 1024
SEED = 8
UNKNOWN = "und"
#: Texts counted together; bounds the dense count matrix.
BLOCK = 128
#: Distinct trigrams whose vectors are built at once.
SLICE = 2048
#: Characters of a longer text counted at once, up to the next space.
PART = 1 << 20
#: A model of more languages than this (8 KB each) is refused: it is sent to every executor.
MAX_LANGUAGES = 5000


@functools.lru_cache(maxsize=8192)
def _letter(code: int) -> np.ndarray:
    return np.where(np.random.default_rng((SEED, code)).random(DIMENSIONS) < 0.5, -1, 1).astype(np.int8)


def _parts(text: str) -> list[str]:
    """A long text cut at spaces into parts of PART characters or a little more; trigrams never span a space."""
    out, start = [], 0
    while len(text) - start > PART:
        stop = text.find(" ", start + PART)
        if stop < 0:
            break
        out.append(text[start:stop])
        start = stop + 1
    return [*out, text[start:]]


def _sums(texts: list[str | None], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the trigram vectors of each group of texts, and the number of its trigrams."""
    long = len(texts) == 1 and len(texts[0] or "") > PART
    out, size = np.zeros((groups, DIMENSIONS), np.float64), np.zeros(groups, np.int64)
    for part in _parts(texts[0]) if long else [texts]:
        letters, text, code = _trigrams([part] if long else part)
        if len(code):
            out += _bundled(group[text], groups, letters, code)
            size += np.bincount(group[text], minlength=groups)
    return out, size


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters that occur (0: a word edge); and for each trigram, the number of its text and its code in base len(letters)."""
    low = [(t or "").lower() for t in texts]
    joined = np.frombuffer(" ".join(low).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    present = np.flatnonzero(np.bincount(joined, minlength=1)) if len(joined) else np.zeros(0, np.int64)
    letters = np.array([0, *(c for c in present.tolist() if chr(c).isalpha())])
    index = np.zeros(int(joined.max(initial=0)) + 1, np.int64)
    index[letters] = np.arange(len(letters))
    x = np.concatenate(([0], index[joined], [0]))
    code = (x[:-2] * len(letters) + x[1:-1]) * len(letters) + x[2:]
    inner = x[1:-1] > 0
    return letters, np.repeat(np.arange(len(texts)), sizes)[: len(joined)][inner], code[inner]


def _bundled(group: np.ndarray, groups: int, letters: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The sum of the trigram vectors of each group."""
    distinct, at = _distinct(code, len(letters) ** 3)
    base = np.stack([np.ones(DIMENSIONS, np.int8), *(_letter(int(c)) for c in letters[1:])])
    twice, once = np.roll(base, 2, 1), np.roll(base, 1, 1)
    order = np.argsort(at, kind="stable") if len(distinct) > SLICE else np.arange(len(at))
    at, group, out = at[order], group[order], np.zeros((groups, DIMENSIONS), np.float32)
    for start in range(0, len(distinct), SLICE):  # a dense matrix of all distinct trigrams would grow with the alphabet
        part = distinct[start : start + SLICE]
        a, b = np.searchsorted(at, [start, start + len(part)]) if len(distinct) > SLICE else (0, len(at))
        counts = np.bincount(group[a:b] * len(part) + at[a:b] - start, minlength=groups * len(part)).reshape(groups, -1).astype(np.float32)
        rest = part // len(letters)
        out += counts @ (twice[rest // len(letters)] * once[rest % len(letters)] * base[part % len(letters)]).astype(np.float32)
    return out


def _distinct(code: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    if space > 1 << 22:
        return np.unique(code, return_inverse=True)
    seen = np.zeros(space, bool)
    seen[code] = True
    rank = np.cumsum(seen) - 1
    return np.flatnonzero(seen), rank[code]


def _blocks(batches, *names):
    """Texts and other columns in blocks of at most BLOCK rows and about 2 MB of text."""
    for batch in batches:
        start, size, values = 0, 0, batch.column("text").to_pylist()
        for stop in range(1, len(values) + 1):
            size += len(values[stop - 1] or "")
            if stop - start == BLOCK or size > 2_000_000 or stop == len(values):
                yield values[start:stop], *(batch.column(n).slice(start, stop - start) for n in names)
                start, size = stop, 0


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors, from all rows of (text, lang)."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for texts, langs in _blocks(batches, "lang"):
            names, group = np.unique(np.array(langs.to_pylist(), object).astype(str), return_inverse=True)
            vectors, size = _sums(texts, group, len(names))
            for name, vector, n in zip(names.tolist(), vectors, size.tolist(), strict=True):
                if n:
                    sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"]
        )

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    parts = rows.mapInArrow(lean_stream(add), "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("place", "value"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    models = sorted(found.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(models) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r.lang for r in models], np.array([r.vector for r in models], np.float64).reshape(len(models), DIMENSIONS)


def identify(docs: DataFrame, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """The documents' columns plus lang_pred and score (the cosine, at least 0)."""
    docs = docs.drop("lang_pred", "score")
    unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((languages, unit))

    def run(batches):
        names, unit = shared.value
        for batch in batches:
            label, score = [], []
            for (texts,) in _blocks([batch]):
                best, cosine = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names:
                    sums, size = _sums(texts, np.arange(len(texts)), len(texts))
                    norm = np.linalg.norm(sums, axis=1)
                    has = size > 0
                    cosines = (sums @ unit.T) / np.maximum(norm, 1e-12)[:, None]
                    top = cosines.argmax(1)
                    best = [names[k] if h else UNKNOWN for k, h in zip(top.tolist(), has.tolist(), strict=True)]
                    cosine = np.where(has, np.clip(cosines.max(1), 0, 1), 0)
                label += best
                score += cosine.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(lean_stream(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(column, folds: int, fold: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = identify(docs.select("doc_id", "text"), *model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
