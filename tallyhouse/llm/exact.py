"""Exact duplicates by deterministic block naming.

1. A text without white space is cut into blocks of BLOCK characters (the last may be shorter; an empty text is one empty block).
   Distinct blocks are sorted and get whole numbers as names: equal blocks, and only they, have equal names.
2. Neighbouring names of a text are paired (a last one without neighbour is paired with NONE), distinct pairs are sorted and named in
   turn, until every text has one name. Texts are equal if and only if round and name agree; no hash decides.
3. Names are grouped: the row with the most code points stays, then the smallest doc_id, then the row read first.
Blocks travel once, to be named: distinct ones only, after a map-side combine. Back to their texts names are joined by a 64-bit
hash of the block where one block alone has it, and by hash and block where several do (about n * n / 2**65 of n blocks; these
hashes are listed in the plan). Copies add nothing to the naming, and groups are combined before each shuffle.

Defined cases: null texts count as empty. Rows that share a doc_id, or have none, are rows of their own; of equal rows the one read
first stays; a null doc_id is larger than all others, and keep_id is null if the row that stays has none. Other columns are ignored
unless carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.runs import stored

#: Characters of a block.
BLOCK = 4096
#: Partner of a last name that has none.
NONE = -1


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def blocks_of(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Each row's place in the sorted rows of its partition, behind the partition's number."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def block_names(texts: DataFrame, size: int, mark: Callable[[str], Column]) -> DataFrame:
    """mark, name and (where several blocks have the mark) block of every distinct block of `plain`."""
    blocks = texts.select(F.explode(blocks_of(F.col("plain"), size)).alias("block")).withColumn("mark", mark("block"))
    sets = blocks.groupBy("mark").agg(F.collect_set("block").alias("blocks"))
    named = _numbered(sets.select("mark", (F.size("blocks") > 1).alias("shared"), F.explode("blocks").alias("block")), "block")
    return stored(named.select("mark", "name", F.when(F.col("shared"), F.col("block")).alias("block")), "names")


def identities(texts: DataFrame, size: int = BLOCK, mark: Callable[[str], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """For texts with a column `plain`: their other columns with a number `row`; and (row, round, name), the identity of each."""
    names = block_names(texts, size, mark)
    shared = [r.mark for r in names.where("block IS NOT NULL").select("mark").distinct().collect()]
    cut = texts.withColumn("blocks", blocks_of(F.col("plain"), size)).withColumn("marks", F.transform("blocks", lambda b: mark(b)))
    several = F.arrays_overlap("marks", F.array(*map(F.lit, shared))) if shared else F.lit(False)
    kept = cut.withColumns({"row": F.monotonically_increasing_id(), "blocks": F.when(several, F.col("blocks"))}).drop("plain")
    rows = stored(kept, "rows")
    unit = F.posexplode(F.arrays_zip("marks", F.coalesce("blocks", F.transform("marks", lambda m: F.lit(None).cast("string"))).alias("blocks")))
    units = rows.select("row", F.size("marks").alias("n"), unit.alias("pos", "unit")).select("row", "n", "pos", "unit.marks", F.col("unit.blocks").alias("own"))
    same = (F.col("marks") == F.col("mark")) & (F.col("block").isNull() | (F.col("block") == F.col("own")))
    state = stored(units.join(names, same).select("row", "n", "pos", "name"), "named")
    found, longest = [], rows.agg(F.max(F.size("marks"))).first()[0] or 0
    turn = 0
    while True:
        found.append(state.where("n = 1").select("row", F.lit(turn).alias("round"), "name"))
        if longest <= 1:
            break
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        beside = state.where("n > 1").groupBy("row", "n", F.expr("pos DIV 2").alias("at")).agg(left.alias("a"), F.coalesce(right, F.lit(NONE)).alias("b"))
        pairs = stored(beside, "pairs")
        state = stored(pairs.join(_numbered(pairs.select("a", "b").distinct(), "a", "b"), ["a", "b"]).selectExpr("row", "(n + 1) DIV 2 AS n", "at AS pos", "name"), "named")
        turn, longest = turn + 1, -(-longest // 2)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return rows.drop("marks", "blocks"), out


def duplicates(docs: DataFrame, size: int = BLOCK, carry: tuple[str, ...] = (), mark: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, and the carried columns of docs (doc_id, text)."""
    carried = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    plain = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), normalised().alias("plain"), *carried)
    rows, names = identities(plain.withColumn("text_sha256", F.sha2(F.col("plain").cast("binary"), 256)), size, mark)
    known = rows.join(names, "row")
    one = known.groupBy("round", "name", "chars", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    first = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))  # a null doc_id only where there is no other
    level = one.groupBy("round", "name", "chars").agg(first.alias("row"), F.min("doc_id").alias("id"), F.sum("n").alias("n"))
    group = level.groupBy("round", "name").agg(F.max_by("row", "chars").alias("keep_row"), F.max_by("id", "chars").alias("keep_id"), F.sum("n").alias("group_size"))
    return known.join(group, ["round", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
  doc_id = first_value(doc_id) OVER same AS kept, sha256(plain) AS text_sha256
FROM t WINDOW same AS (PARTITION BY plain ORDER BY chars DESC, doc_id)
"""
