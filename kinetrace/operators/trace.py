"""Summaries of recorded traces: one row per (key, axis, sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.vectors import finite_or_null

KINDS = ("request", "chunk", "step", "state", "fault", "end")
HEAVY = ("actions", "server_payload", "observation_state")


def shown_events(events: DataFrame) -> DataFrame:
    """Events of the kinds that a summary shows, without their heavy fields."""
    return events.filter(F.col("kind").isin(*KINDS)).drop(*HEAVY)


def axis_rows(events: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per event and axis with the item of each array column; an array that is too short gives null."""
    longest = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in columns], F.lit(0))
    places = F.explode(F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>")))
    held = events.select(*keys, *columns, places.alias("axis"))
    return held.select(*keys, "axis", *[F.get(c, F.col("axis")).alias(c) for c in columns])


def error_summary(rows: DataFrame, by: list[str], error: Column) -> DataFrame:
    """Count, root mean square and largest size of the finite errors of each group; null where there is none."""
    e = finite_or_null(error)
    return rows.groupBy(*by).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("peak"))


def run_summary(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Events of each run and the largest refresh gap over all axes and states, at least 0."""
    gap = F.array_max(F.transform("refresh_gap_ms", lambda g: finite_or_null(g)))
    return events.groupBy(run).agg(F.count(F.lit(1)).alias("events"), F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("kind") == "state", gap)), F.lit(0.0))).alias("max_refresh_gap_ms"))


def last_n(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group in arrival order; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def page_summary(rows: DataFrame, by: list[str], order: list[str], error: str, n: int) -> DataFrame:
    """As ``error_summary`` over the last ``n`` rows of each group, with the latest error."""
    page = last_n(rows, by, order, n)
    e = finite_or_null(F.col(error))
    return page.groupBy(*by).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("peak"), F.max_by(e, F.when(e.isNotNull(), F.struct(*order))).alias("latest"))


def merged_series(held: DataFrame, sent: DataFrame, t: str = "t") -> DataFrame:
    """Two series as one with their ``series`` name, in time order."""
    return held.withColumn("series", F.lit("held")).unionByName(sent.withColumn("series", F.lit("sent")), allowMissingColumns=True).orderBy(t, "series")


def wide_samples(rows: DataFrame, keys: list[str], groups: list[str], axes: list[str], axis: str = "axis") -> DataFrame:
    """One row per sample with a column ``group.axis`` for each of a fixed list of groups and axes."""
    cells = [F.max(F.when(F.col(axis) == name, F.col(g))).alias(f"{g}.{name}") for g in groups for name in axes]
    return rows.groupBy(*keys).agg(*cells)


def running_peak(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_peak", F.max(F.abs(value)).over(w))
