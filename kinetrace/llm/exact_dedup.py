"""Exact document deduplication by skew-safe combining; DataFrame functions only.

1. Copies meet locally: the map side of a grouping by (digest, salt, full text) merges those of one task.
2. Salted digest groups: only digests that more than ``max(1000, rows / 100000)`` rows carry are salted, so at
   most 100 000 digests are hot and their list is small enough to broadcast at any size of input.
3. The winners of the salts of a hot digest are combined by (digest, full text).

Texts are grouped by their full content at each stage; the digest only decides where rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.workspace import materialise, row_count
from kinetrace.session import table

#: Rows of one digest beyond which it is salted, and the most digests that can be hot.
HOT_ROWS, MOST_HOT = 1000, 100_000


def identity(text: Column) -> Column:
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=identity, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if ``normalise(text)`` is identical; a null text counts as empty. The row with the
    largest id stays. Repeated rows with the same id and text count in ``group_size`` and one of them stays; a
    null id loses to any other, and if all ids of a group are null, one row stays. Other columns are ignored, so their
    names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.col("_text"), 256)))
    cap = max(hot_rows, row_count(docs) // MOST_HOT)
    hot = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap)
    salts = F.ceil(F.col("_n") / F.lit(cap))
    dealt = rows.join(F.broadcast(hot), "_sha", "left").withColumn("_salt", F.when(F.col("_n").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("_id"), salts)))
    merged = dealt.groupBy("_sha", "_salt", "_text").agg(F.max("_id").alias("_win"), F.count(F.lit(1)).alias("_cnt"), F.sort_array(F.collect_list(F.struct("_id")), asc=False).alias("_ids"))
    salted = F.col("_salt") >= 0
    # what follows needs the text only where salts are still to be combined
    merged = materialise(merged.withColumn("_text", F.when(salted, F.col("_text"))).withColumn("_part", F.monotonically_increasing_id()), "exact-dedup")
    parts = merged.filter(salted).select("_sha", "_text", "_win", "_cnt", "_part")
    best = parts.groupBy("_sha", "_text").agg(F.max("_win").alias("_keep"), F.sum("_cnt").alias("_size"))
    settled = parts.join(best, ["_sha", "_text"]).select("_part", "_keep", "_size")
    joined = merged.drop("_text").join(settled, "_part", "left")
    keep = F.when(salted, F.col("_keep")).otherwise(F.col("_win"))
    out = joined.select("_sha", "_win", keep.alias("_keep_id"), F.coalesce("_size", "_cnt").alias("_group"), F.posexplode("_ids").alias("_pos", "_row"))
    return out.select(
        F.col("_row._id").alias(id_col),
        F.col("_keep_id").alias("keep_id"),
        F.col("_group").alias("group_size"),
        ((F.col("_pos") == 0) & F.col("_win").eqNullSafe(F.col("_keep_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
}
