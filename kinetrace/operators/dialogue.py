"""Conversation memory and message bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trim_memory(messages: DataFrame, by: list[str], order: list[str], text: str, turns: int, most_chars: int = 24_000) -> DataFrame:
    """What remains of each conversation: non-blank messages among the last ``2 * turns`` whose length with all that follow is at most ``most_chars``; two at least."""
    blank = r"^[\s\x{3000}]*$"
    held = messages.filter(F.col(text).isNotNull() & ~F.col(text).rlike(blank))
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    rank = F.row_number().over(back)
    chars = F.sum(F.length(text)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = held.withColumn("_rank", rank).withColumn("_chars", chars)
    return ranked.filter((F.col("_rank") <= 2 * turns) & ((F.col("_chars") <= most_chars) | (F.col("_rank") <= 2))).drop("_rank", "_chars")


def speech_metrics(events: DataFrame, by: list[str], kind: str, t: str, size: str, rate: int = 24_000) -> DataFrame:
    """Of each utterance the ms to the first part and to the final, and the ms of 16-bit audio."""
    start = F.min(F.when(F.col(kind) == "start", F.col(t)))
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(t)))
    return events.groupBy(*by).agg(
        ((at("partial") - start) * 1000).alias("first_partial_ms"),
        ((at("final") - start) * 1000).alias("final_ms"),
        (F.sum(F.when(F.col(kind) == "audio", F.col(size)).otherwise(0)) / (2 * rate) * 1000).alias("audio_ms"),
    )
