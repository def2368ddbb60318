"""Trace files: JSON lines of events in folders named by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions.nested import finite_columns
from kinetrace.functions.paths import contained

RUN_ID = r"^\d{8}_\d{6}_[a-f0-9]{8}$"
VECTOR = T.ArrayType(T.DoubleType())
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "source", "reason", "detail", "server_payload")]
    + [T.StructField(n, T.DoubleType()) for n in ("monotonic", "t", "feedback_monotonic", "observation_monotonic")]
    + [T.StructField(n, T.IntegerType()) for n in ("chunk", "index", "motor_id", "error_flag")]
    + [T.StructField(n, VECTOR) for n in ("state", "held_action", "error", "server_action", "sent_action", "feedback_before", "speed", "torque", "kp", "kd", "motor_error", "refresh_gap_ms", "observation_state")]
    + [T.StructField("actions", T.ArrayType(VECTOR)), T.StructField("base_feedback_measured", T.BooleanType()), T.StructField("is_success", T.BooleanType())]
    + [T.StructField("sent_motor_ids", T.ArrayType(T.IntegerType())), T.StructField("failures", T.ArrayType(T.StringType()))]
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all runs below ``path`` (``<run_id>/events.jsonl``) with ``run_id`` and ``line_no``; lines that are no JSON are left out.

    ``line_no`` orders the lines of a file; it has gaps where files are split.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    placed = lines.select("value", run.alias("run_id"), (F.col("_metadata.file_block_start") * 1_000_000 + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("line_no"))
    parsed = placed.withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"})).filter(F.col("e.kind").isNotNull())
    return parsed.select("run_id", "line_no", "e.*")


def list_runs(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """The newest run ids that have a ``metadata.json``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").load(path).select("path", "modificationTime")
    runs = files.select(F.regexp_extract("path", r"([^/]+)/metadata\.json$", 1).alias("run_id")).filter(F.col("run_id").rlike(RUN_ID))
    return runs.distinct().orderBy(F.desc("run_id")).limit(most)


def valid_run_id(run: Column) -> Column:
    return F.coalesce(run.rlike(RUN_ID), F.lit(False))


def run_folder(root: Column, run: Column) -> Column:
    """The folder of a run below ``root``, relative to it; null for what is no run id."""
    return F.when(valid_run_id(run), contained(root, run))


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines in a folder for each run; numbers that are not finite become null at any depth, and nulls are written."""
    finite_columns(events).write.mode("append").option("ignoreNullFields", False).partitionBy("run_id").json(path)


def write_wide(samples: DataFrame, path: str) -> None:
    """Wide samples as CSV with a header; a missing value is empty."""
    samples.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
