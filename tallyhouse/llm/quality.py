"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. For every language and source, concentration steps look for the part of
the rows (COVERAGE) whose covariance has the smallest determinant: each step computes all rows' Mahalanobis distances from the
current centre and covariance and takes the mean and covariance of the nearest rows. The distances are rescaled so that
their median is that of a chi-square law, and rows beyond CUTOFF are rejected. Sources with fewer than MIN_ROWS rows of a language are pooled into one group of that language.
If that group is still smaller than MIN_ROWS, its rows are judged by the estimate of all rows of all languages, which
has no least size; below MIN_ROWS rows it is not rescaled to less than the FLOOR of each statistic.

Every row counts. Statistics are whole numbers of 1/UNIT and their sums are exact, so partitioning changes nothing. A step is one
aggregation by group and distance class, with partial sums before the shuffle; what one group leaves for one task is a row
per distance class and salt, however many rows the group has: rows meet their group's estimate in SALTS parts.

Defined cases: null texts have no words and fail the base rule. Null languages and sources form groups of their own. d2 is null
only where no row at all passes the base rule. Ids may repeat or be null. Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import words as W
from tallyhouse.session import scratch_dir

REPEAT_WIDTH = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_SHARE = 20, 30
FEATURES = ["x0", "x1", "x2", "x3", "x4", "x5"]
UNIT = 1000
COVERAGE = 0.75
STEPS = 4
MIN_ROWS = 100
#: Median of the chi-square law with six degrees of freedom.
MEDIAN = 5.3481
#: Squared distance beyond which a row is rejected.
CUTOFF = 100.0
#: Least standard deviation of each statistic: many texts have no symbol or repeated line at all.
FLOOR = [0.2, 0.08, 0.1, 0.2, 0.2, 0.1]
#: Parts of a group; the few numbers of an estimate are repeated for each.
SALTS = 64
#: Distance classes per doubling, and the range of doublings they cover.
CLASSES, LEAST, MOST = 16, -16, 40

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_doubled long"


def statistics(docs: DataFrame) -> DataFrame:
    """The documents' columns other than text, plus the counts in STATISTICS (n_lines: lines with a word, n_doubled: words equal to the one before)."""
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled", "base_failed", "kept", "d2", *FEATURES, *KEY, "salt"}
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name not in results]

    def run(batches):
        for batch in batches:
            for part in W.parts(batch):
                counts = _counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(c) for c in counts], names=schema.names)

    schema = T.StructType([*kept, *T.StructType.fromDDL(STATISTICS).fields])
    return docs.mapInArrow(run, schema)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def _counts(texts: pa.Array) -> list[np.ndarray]:
    data, at = W.byte_view(texts)
    space, symbol = np.zeros(256, bool), np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    symbol[list(SYMBOLS)] = True
    found = W.words(texts)
    n_words = np.diff(found.bounds)
    chars = _per_text(~space[data] & ((data & 0xC0) != 0x80), at)
    lines = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    line_text = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    coded = lines.flatten().dictionary_encode()
    real = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = real[code]
    key = line_text[keep] * max(1, len(real)) + code[keep]
    first = np.unique(key) // max(1, len(real))
    n_lines = np.bincount(line_text[keep], minlength=len(texts))
    distinct = np.bincount(first, minlength=len(texts))
    same = np.zeros(len(found.codes), bool)
    same[1:] = found.codes[1:] == found.codes[:-1]
    same[found.bounds[:-1][n_words > 0]] = False
    return [n_words, chars, _per_text(symbol[data], at), n_lines - distinct, _repeated(found), n_lines, _per_text(same, found.bounds)]


def _repeated(found: W.Words) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    starts = W.window_starts(found.bounds, REPEAT_WIDTH)
    text = np.searchsorted(found.bounds, starts, side="right") - 1
    key = W.windows(W.hashes(found.distinct)[found.codes], REPEAT_WIDTH)[starts] ^ W.mixed(text.astype(np.uint64) + np.uint64(1))
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    edge = np.zeros(len(found.codes) + 1, np.int64)
    if len(twice):
        slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = starts[twice[slot] == key]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + REPEAT_WIDTH, -1)
    return _per_text(np.cumsum(edge[:-1]) > 0, found.bounds)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def vectors() -> dict[str, F.Column]:
    """The transformed statistics, in whole 1/UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    parts = [
        0.3 * F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_doubled") / n),
    ]
    return {name: F.round(UNIT * part).cast("long") for name, part in zip(FEATURES, parts, strict=True)}


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
#: Estimate of a group: rows, centre, inverse covariance (by rows), scale of the squared distance.
ESTIMATE = "g_lang string, g_source string, rows long, centre array<double>, inverse array<double>"


def _estimate(sums: np.ndarray, scale: float = 1.0) -> tuple[list[float], list[float]]:
    n = sums[0]
    mean = sums[1 : 1 + len(FEATURES)] / n
    cov = np.zeros((len(FEATURES),) * 2)
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = sums[1 + len(FEATURES) + k] / n - mean[i] * mean[j]
    cov = (cov / UNIT**2 + np.diag(np.square(FLOOR))) * scale
    return (mean / UNIT).tolist(), np.linalg.inv(cov).ravel().tolist()


def distance() -> F.Column:
    """Squared Mahalanobis distance of x0.. from centre under inverse."""
    total = F.lit(0.0)
    gap = [F.col(x) / UNIT - F.col("centre")[k] for k, x in enumerate(FEATURES)]
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * gap[i] * gap[j] * F.col("inverse")[i * len(FEATURES) + j]
    return F.greatest(total, F.lit(0.0))


def _sums() -> list[F.Column]:
    cols = [F.count("*").alias("s0")] + [F.sum(x).alias(f"s{1 + k}") for k, x in enumerate(FEATURES)]
    return cols + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{1 + len(FEATURES) + k}") for k, (i, j) in enumerate(PAIRS)]


SUMS = [f"s{k}" for k in range(1 + len(FEATURES) + len(PAIRS))]


def _step(classes: pd.DataFrame) -> pd.DataFrame:
    """A group's next estimate from its sums by distance class: those of the nearest COVERAGE of its rows."""
    classes = classes.sort_values("class")
    sums = classes[SUMS].to_numpy(np.float64)
    reach = np.cumsum(sums[:, 0])
    n = reach[-1]
    near = int(np.searchsorted(reach, COVERAGE * n))
    middle = 2.0 ** (LEAST + (classes["class"].iloc[int(np.searchsorted(reach, n / 2))] + 0.5) / CLASSES)
    last = bool(classes["last"].iloc[0])
    if last:  # rescale the estimate in use, so that the median distance is the chi-square law's
        wider = MEDIAN / middle if n >= MIN_ROWS else min(1.0, MEDIAN / middle)
        centre, inverse = classes["centre"].iloc[0], np.asarray(classes["inverse"].iloc[0]) * wider
    else:
        centre, inverse = _estimate(sums[: near + 1].sum(0))
    return pd.DataFrame({"g_lang": [classes["g_lang"].iloc[0]], "g_source": [classes["g_source"].iloc[0]], "rows": [int(n)], "centre": [list(centre)], "inverse": [list(inverse)]})


def _start(groups):
    """First estimates: the group's median, and a spread from its quartiles."""
    for pdf in groups:
        low, mid, high = (np.stack(pdf[c].to_numpy()).astype(float) / UNIT for c in ("q1", "q2", "q3")) if len(pdf) else (np.zeros((0, len(FEATURES))),) * 3
        spread = np.maximum((high - low) / 1.349, np.array(FLOOR)) ** 2
        yield pd.DataFrame({"g_lang": pdf["g_lang"], "g_source": pdf["g_source"], "rows": pdf["rows"], "centre": mid.tolist(), "inverse": [np.diag(1 / s).ravel().tolist() for s in spread]})


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and inverse covariance of every group with MIN_ROWS rows, and of ALL with any; rows has g_lang, g_source and FEATURES."""
    quartiles = [F.array(*[F.percentile(x, q) for x in FEATURES]).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)]
    grouped = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), *quartiles).where((F.col("rows") >= MIN_ROWS) | (F.col("g_lang") == ALL))
    found = grouped.mapInPandas(_start, ESTIMATE)
    for step in range(steps + 1):
        d2 = rows.join(_salted(found), [*KEY, "salt"]).withColumn("d2", distance())
        octave = F.least(F.greatest(F.log2(F.col("d2")), F.lit(LEAST)), F.lit(MOST)) - LEAST
        place = F.coalesce(F.floor(octave * CLASSES).cast("int"), F.lit(0)).alias("class")
        sums = d2.groupBy(*KEY, place).agg(F.first("centre").alias("centre"), F.first("inverse").alias("inverse"), *_sums())
        found = sums.withColumn("last", F.lit(step == steps)).groupBy(*KEY).applyInPandas(_step, ESTIMATE)
    return found


KEY = ["g_lang", "g_source"]
#: Both names of the group of all languages; other languages' names start with "=" or are empty.
ALL = "all"


def _salted(found: DataFrame) -> DataFrame:
    return found.drop("rows").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds g_lang and g_source: the group whose estimate a row is judged by."""
    named = stats.withColumn("g_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("g_own", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    named = named.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # stored, so drawn once
    sizes = named.groupBy("g_lang", "g_own").agg(F.count_if(~F.col("base_failed")).alias("g_rows"))
    # A language may have any number of sources: their pool is summed with partial sums and met in SALTS parts.
    pools = sizes.groupBy("g_lang").agg(F.sum(F.when(F.col("g_rows") < MIN_ROWS, F.col("g_rows"))).alias("pool"))
    parts = pools.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pooled = sizes.withColumn("part", F.pmod(F.xxhash64("g_own"), F.lit(SALTS)).cast("int")).join(parts, ["g_lang", "part"]).drop("part")
    group = F.when(F.col("g_rows") >= MIN_ROWS, F.col("g_own")).when(F.col("pool") >= MIN_ROWS, "pooled").otherwise(ALL)
    placed = named.join(pooled.withColumn("g_source", group).drop("g_rows", "pool"), ["g_lang", "g_own"], "left").drop("g_own")
    return placed.withColumn("g_lang", F.when(F.col("g_source") == ALL, ALL).otherwise(F.col("g_lang")))


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "quality")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def judged(docs: DataFrame) -> DataFrame:
    """The documents' columns other than text, plus STATISTICS, base_failed, d2 (squared distance) and kept."""
    counted = _written(statistics(docs).withColumn("base_failed", base_failed()).withColumns(vectors()))
    rows = _written(_grouped(counted))
    known = rows.where("NOT base_failed").select(*KEY, "salt", *FEATURES)
    if not rows.where(F.col("g_lang") == ALL).isEmpty():
        known = known.where(F.col("g_lang") != ALL).unionByName(known.withColumns({k: F.lit(ALL) for k in KEY}))
    found = estimates(known)
    d2 = rows.join(_salted(found), [*KEY, "salt"], "left").withColumn("d2", F.when(F.col("centre").isNotNull(), distance()))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return d2.withColumn("kept", verdict).drop(*KEY, "salt", "centre", "inverse", *FEATURES)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
