"""Corrections of text whose pairs come from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table of corrections at most; all of it goes to every task.
MOST_BYTES = 16 << 20


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``place, source, replacement`` of a JSON object, in the order of the file."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("place", "source", "replacement"))


def correct_from(rows: DataFrame, text: str, corrections: DataFrame, place: str = "place", source: str = "source", replacement: str = "replacement") -> DataFrame:
    """``rows`` with the ``source`` texts of a table replaced one pair after another, in the order of ``place``, each in what the ones before have left, and trimmed.

    Null and empty sources are left out, a null replacement counts as empty, pairs of equal place go by source. The pairs are folded over each text; they are a single value in the plan, so
    their number does not lengthen it. A table of more than MOST_BYTES is an error, since each task holds it.
    """
    pairs = corrections.filter(F.length(source) > 0).select(F.col(place).alias("place"), F.col(source).alias("source"), F.coalesce(replacement, F.lit("")).alias("replacement"))
    size = pairs.agg(F.sum(F.octet_length("source") + F.octet_length("replacement"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"corrections of {size} bytes; at most {MOST_BYTES} can be sent to all tasks")
    held = pairs.agg(F.sort_array(F.collect_list(F.struct("place", "source", "replacement"))).alias("pairs")).scalar()
    done = F.aggregate("_pairs", F.col(text), lambda t, p: F.replace(t, p["source"], p["replacement"]))
    return rows.withColumn("_pairs", held).withColumn(text, _stripped(done)).drop("_pairs")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
