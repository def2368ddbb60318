"""A training-corpus pipeline over ``documents``: language ID, line deduplication, near-deduplication, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns to the shared folder as Parquet and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm import language_id, line_dedup, minhash, packing, tokens
from kinetrace.llm.workspace import materialise, row_count
from kinetrace.session import table

#: Ids that are sent to all executors; with more, documents are shuffled to them.
SENT_IDS = 2_000_000


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if row_count(ids) <= SENT_IDS else ids


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and one column with all others, so that columns of the documents clash with none of an operator."""
    others = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(None).cast("int").alias("none"), *others).alias("others"))


def _unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the documents as they were, but for those that a stage changes."""
    held = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"others.c{k}") for k, c in enumerate(columns)} | {c: x for c, x in changed.items() if c in columns}
    return rows.select(*[held[c].alias(c) for c in columns])


def _place(columns: list[str], name: str) -> Column:
    return F.col(f"others.c{columns.index(name)}") if name in columns else F.lit(None).cast("string")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, learned from the labelled ones; a missing label is filled in.

    Rejected, and gone: null texts, texts without a letter, and texts that no learned language explains.
    """
    models = language_id.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language_id.identify(_packed(docs), models).filter(~F.col("rejected"))
    return _unpacked(found, docs.columns, lang=F.coalesce(_place(docs.columns, "lang"), "lang_pred"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those of which nothing is left are gone."""
    left = line_dedup.dedup_lines(_packed(docs)).filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return _unpacked(left, docs.columns, n_chars=F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; a null id loses to any other.

    Groups are of rows, whatever ids they have: different texts with a null or the same id all stay. Of rows that repeat both id and text one stays.
    """
    rows = materialise(_packed(docs).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    found = minhash.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    # a blank text is linked with nothing, and only its own repetitions are one with it
    blank = lambda c: F.when(F.col("blank"), F.col(c)).alias(f"blank_{c}")
    group = [F.when(~F.col("blank"), F.col("component_id")).alias("component"), blank("doc_id"), blank("text")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row"))
    kept = materialise(rows.join(found, "row").groupBy(*group).agg(first["row"].alias("row")).select("row"), "pipeline-kept")
    return _unpacked(rows.join(_sent(kept), "row", "left_semi"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: None of these stages can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
