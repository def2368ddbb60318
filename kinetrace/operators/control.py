"""Post-processing of recorded commands: slew limits, debounce, ticks, latency windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def slew_limit(start: Column, targets: Column, most: float) -> Column:
    """A short run of targets, each at most ``most`` from the one before it as limited; the first from ``start``."""
    step = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.greatest(F.lit(-most), F.least(F.lit(most), x - F.element_at(done, -1)))))
    return F.slice(F.aggregate(targets, F.array(start), step), 2, 2147483647)


def slew_limit_rows(rows: DataFrame, by: list[str], order: list[str], vector: str, axes: tuple[int, ...], most: float) -> DataFrame:
    """``rows`` with ``limited`` (the vector within ``most`` of the one sent before, on ``axes``) and ``limited_axes``.

    What is sent depends on what was sent before, so each key is one ordered pass; its rows stream through in batches with the
    last command as the only state, and a key may be of any length. The first row of a key passes.
    """
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("limited", T.ArrayType(T.DoubleType())), T.StructField("limited_axes", T.ArrayType(T.IntegerType()))])
    held_axes = np.array(axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            sent, changed = [], []
            for now, values in zip(batch[by].itertuples(index=False, name=None), batch[vector], strict=True):
                target = np.array(values, float)
                if now != key:
                    key, last = now, target
                delta = target[held_axes] - last[held_axes]
                over = np.abs(delta) > most
                target[held_axes[over]] = last[held_axes[over]] + np.copysign(most, delta[over])
                sent.append(target.tolist())
                changed.append(held_axes[over].tolist())
                last = target
            batch["limited"], batch["limited_axes"] = sent, changed
            yield batch

    return ordered.mapInPandas(run, schema)


def slew_report(limited: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Steps that were limited, and the axes of the last one."""
    hit = F.size("limited_axes") > 0
    return limited.groupBy(*by).agg(F.count_if(hit).alias("limited_steps"), F.max_by("limited_axes", F.when(hit, F.struct(*order))).alias("last_axes"))


def runs_of(rows: DataFrame, by: list[str], order: list[str], holds: Column) -> DataFrame:
    """``run_length``: rows in a row up to this one for which ``holds`` is true, 0 where it is not."""
    w = Window.partitionBy(*by).orderBy(*order)
    ok = F.coalesce(holds, F.lit(False))
    held = rows.withColumn("_ok", ok).withColumn("_island", F.sum(F.when(~ok, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.withColumn("run_length", F.when(F.col("_ok"), inside).otherwise(F.lit(0))).drop("_ok", "_island")


def debounced(rows: DataFrame, by: list[str], order: list[str], holds: Column, steps: int) -> DataFrame:
    """The rows at which ``holds`` has been true ``steps`` times in a row."""
    return runs_of(rows, by, order, holds).filter(F.col("run_length") == steps)


def converged(state: Column, target: Column, near: float = 0.05) -> Column:
    return F.coalesce(F.array_max(F.zip_with(state, target, lambda a, b: F.abs(a - b))) <= near, F.lit(False))


def missed_ticks(rows: DataFrame, by: list[str], order: list[str], tick: str) -> DataFrame:
    before = F.lag(tick).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("missed", F.greatest(F.lit(0), F.coalesce(F.col(tick) - before - 1, F.lit(0))))


def handoff(observed: Column, handed: Column, horizon: int = 50) -> Column:
    """Steps of a chunk that are over when it arrives; null if it is stale or from the future."""
    k = handed - observed
    return F.when((k >= 0) & (k < horizon), k)


def rolling_delay(rows: DataFrame, by: list[str], order: list[str], steps: str, initial: int = 6, margin: int = 1, window: int = 20) -> DataFrame:
    """``delay``: the largest of the last ``window`` delays and a margin, at least ``initial``."""
    recent = F.max(steps).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0))
    return rows.withColumn("delay", F.greatest(F.lit(initial), F.coalesce(recent, F.lit(0)) + margin))


def schedule_fits(s: Column, d: Column, reserve: Column, horizon: int = 50) -> Column:
    return F.coalesce((s > 0) & (s < horizon) & (d >= 0) & (d <= s) & (s <= horizon - d) & (s + d + reserve <= horizon), F.lit(False))


def reset_peaks(rows: DataFrame, by: list[str], order: list[str], value: Column, resets: Column) -> DataFrame:
    """``peak``: the running maximum since the last reset, a reset row starting anew."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_span", F.sum(F.when(F.coalesce(resets, F.lit(False)), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.withColumn("peak", F.max(value).over(inside)).drop("_span")
