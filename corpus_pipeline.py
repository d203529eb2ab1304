"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; only the last returns placed pieces.
run() writes each stage's rows as Parquet to the shared folder and reads them again for the next one. Every stage is a function of
all rows the one before it kept. Columns of documents beyond doc_id and text pass through, whatever their names; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, language, minhash, packing, substrings
from tallyhouse.llm.runs import stored
from tallyhouse.llm.shards import text_mark


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """doc_id, text and the other columns under names that clash with nothing; and how to get the columns back."""
    rest = {c: f"_column_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    named = docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(n) for c, n in rest.items()))
    return named, [F.col(rest.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts and texts without a letter."""
    plain, back = _plain(docs)
    found = language.identify(plain, *language.train(docs.select("text", "lang")))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the chosen document of each group; of equal rows, one."""
    plain, back = _plain(docs)
    key = F.struct("doc_id", "mark")  # nulls in a struct are equal to each other
    found = minhash.near_duplicates(docs.select("doc_id", "text")).where("chosen").select(key.alias("key")).distinct()
    keyed = plain.withColumn("key", F.struct(F.col("doc_id"), text_mark().alias("mark")))
    return keyed.join(found, "key", "left_semi").dropDuplicates(["key"]).select(back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated word sequences; a document of which nothing is left goes. n_chars becomes the length of the new text."""
    plain, back = _plain(docs)
    found = substrings.deduplicated(plain, carry=tuple(plain.columns[2:]))
    left = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    kept = left.where("n_removed < n_words OR n_words = 0").select(back)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    plain, back = _plain(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.judged(decontaminate.contamination(plain, items)).where("NOT contaminated").select(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the learned language model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
