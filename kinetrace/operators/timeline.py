"""Timelines of episodes: diagnostics, duplicate removal and resampling on a uniform grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.clock import MILLISECONDS, unit_divisor


def control_rate(*candidates: Column, default: float = 30.0) -> Column:
    """The first rate that is given, else ``default``; null outside 1 to 500."""
    rate = F.coalesce(*candidates, F.lit(default))
    return F.when(rate.between(1, 500), rate)


def elapsed(rows: DataFrame, by: list[str], order: list[str], t: str) -> DataFrame:
    """``elapsed`` seconds since the first row of each episode; milliseconds are told by the median.

    Only on which side of a bound the median lies counts, and that takes no more than the numbers of times on either side and the two times next to the bound.
    """
    w = Window.partitionBy(*by)
    first, above = F.first(F.col(t)).over(w.orderBy(*order)), F.col(t) > MILLISECONDS
    n, n_above = F.count(t).over(w), F.count_if(above).over(w)
    middle = (F.max(F.when(~above, F.col(t))).over(w) + F.min(F.when(above, F.col(t))).over(w)) / 2
    median = F.when(2 * n_above == n, middle).when(2 * n_above > n, F.lit(float("inf"))).otherwise(F.lit(0.0))
    held = rows.withColumn("_median", median)
    return held.withColumn("elapsed", (F.col(t) - first) / unit_divisor(F.col("_median"))).drop("_median")


def diagnostics(rows: DataFrame, by: list[str], order: list[str], t: str, rate: float) -> DataFrame:
    """Frames, duplicates, gaps, largest interval and duration of each episode, and whether its time runs back."""
    held = elapsed(rows, by, order, t)
    dt = F.col("elapsed") - F.lag("elapsed").over(Window.partitionBy(*by).orderBy(*order))
    return (
        held.withColumn("_dt", dt)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.count_if(F.col("_dt") == 0).alias("duplicates"),
            F.count_if(F.col("_dt") > 1.5 / rate).alias("gaps"),
            (F.coalesce(F.max("_dt"), F.lit(0.0)) * 1000).alias("max_interval_ms"),
            (F.max("elapsed") - F.min("elapsed")).alias("duration_s"),
            F.coalesce(F.bool_or(F.col("_dt") < 0), F.lit(False)).alias("runs_back"),
        )
        .withColumn("valid", ~F.col("runs_back") & ((F.col("frames") == 1) | (F.col("duration_s") > 0)))
    )


def keep_last_of_equal(rows: DataFrame, by: list[str], order: list[str], t: str) -> DataFrame:
    """Of rows with equal times in a row the last."""
    after = F.lead(t).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") > F.col(t))).drop("_after")


def segments(rows: DataFrame, by: list[str], order: list[str], t: str, values: list[str]) -> DataFrame:
    """Each row with its successor's time and values, and the episode's bounds; duplicates keep the last."""
    single = keep_last_of_equal(rows, by, order, t)
    w = Window.partitionBy(*by).orderBy(t)
    whole = Window.partitionBy(*by)
    ahead = [F.lead(v).over(w).alias(f"_next_{v}") for v in values]
    return single.select(*by, t, *values, F.lead(t).over(w).alias("_next_t"), *ahead, F.min(t).over(whole).alias("_start"), F.max(t).over(whole).alias("_end"))


def resample(rows: DataFrame, by: list[str], order: list[str], t: str, hold: list[str], linear: list[str], rate: float, most_frames: int | None = None) -> DataFrame:
    """Each episode on a grid of ``max(1, round(duration * rate))`` equal steps: ``by, step, grid_t``, held and interpolated values.

    Every segment makes the grid points that lie in it, so the as-of lookup needs no join: one shuffle and sort by episode. The first and last points
    are the first and last rows. A single row is one point. Episodes of any length are gridded; with ``most_frames``, one that has more points ends the query with an error.
    """
    seg = segments(rows, by, order, t, [*hold, *linear])
    duration = F.col("_end") - F.col("_start")
    # half to even, at least one step
    steps = F.greatest(F.lit(1).cast("long"), F.bround(duration * F.lit(float(rate)), 0).cast("long"))
    seg = seg.withColumn("_steps", F.when(duration > 0, steps).otherwise(F.lit(0).cast("long")))
    if most_frames is not None:
        seg = seg.withColumn("_steps", F.when(F.col("_steps") + 1 > most_frames, F.raise_error(F.lit(f"an episode has more than {most_frames} frames")).cast("long")).otherwise(F.col("_steps")))
    at = lambda i: F.col("_start") + i * (duration / F.greatest(F.col("_steps"), F.lit(1)))
    guess = lambda x: F.floor((x - F.col("_start")) / duration * F.col("_steps")).cast("long")
    # candidates around the segment's bounds are filtered by the grid times themselves, so rounding cannot lose or repeat one
    low = F.greatest(F.lit(0).cast("long"), guess(F.col(t)) - 1)
    high = F.least(F.col("_steps"), guess(F.coalesce("_next_t", "_end")) + 1)
    places = F.when(F.col("_steps") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))
    grid = seg.withColumn("step", F.explode(places)).withColumn("grid_t", F.when(F.col("step") == F.col("_steps"), F.col("_end").cast("double")).otherwise(at(F.col("step"))))
    mine = F.col("_next_t").isNull() | (F.col("grid_t") < F.col("_next_t"))
    grid = grid.filter((F.col("grid_t") >= F.col(t)) & mine)
    share = (F.col("grid_t") - F.col(t)) / (F.col("_next_t") - F.col(t))
    lerp = lambda v: F.when(F.col("_next_t").isNull() | (F.col("grid_t") == F.col(t)), F.col(v)).otherwise(F.col(v) + (F.col(f"_next_{v}") - F.col(v)) * share)
    return grid.select(*by, "step", "grid_t", *hold, *[lerp(v).alias(v) for v in linear])
