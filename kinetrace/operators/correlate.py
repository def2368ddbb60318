"""Matching records of several streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wait_intervals(requests: DataFrame, replies: DataFrame, by: list[str], key: str, t: str) -> DataFrame:
    """Each request with the first reply of its key at or after it, or the last time of its group if there is none."""
    both = requests.select(*by, key, F.col(t).alias("start"), F.lit(True).alias("_ask")).unionByName(replies.select(*by, key, F.col(t).alias("start"), F.lit(False).alias("_ask")))
    ahead = Window.partitionBy(*by, key).orderBy(F.col("start").desc(), F.col("_ask").asc()).rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("end", F.last(F.when(~F.col("_ask"), F.col("start")), ignorenulls=True).over(ahead)).filter("_ask")
    ends = requests.select(*by, t).unionByName(replies.select(*by, t)).groupBy(*by).agg(F.max(t).alias("_last"))
    return held.join(ends, by).select(*by, key, "start", F.coalesce("end", "_last").alias("end"), F.col("end").isNotNull().alias("answered"))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last right row of its key at or before it: one sort of the union, no join."""
    rest = [c for c in left.columns if c not in (*by, t)]
    marked = left.select(*by, t, F.struct(*rest, F.lit(1).alias("_own")).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    other = right.select(*by, t, F.lit(None).cast(marked.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*by).orderBy(F.col(t), F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marked.unionByName(other).withColumn("_match", F.last("_right", ignorenulls=True).over(w)).filter(F.col("_left").isNotNull())
    return held.select(*by, t, *[F.col(f"_left.{c}").alias(c) for c in rest], *[F.col(f"_match.{v}").alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str, most: float) -> DataFrame:
    """``left`` with the value of the nearest right row within ``most``; the earlier one of two as near."""
    behind = asof_backward(left, right.withColumn("_t", F.col(t)), by, t, ["_t", value]).withColumnsRenamed({"_t": "_t0", value: "_v0"})
    mirrored = asof_backward(behind.withColumn("_m", -F.col(t)).drop(t).withColumnRenamed("_m", t), right.withColumn("_t", F.col(t)).withColumn(t, -F.col(t)), by, t, ["_t", value])
    back = mirrored.withColumn(t, -F.col(t))
    d0, d1 = F.coalesce(F.col(t) - F.col("_t0"), F.lit(float("inf"))), F.coalesce(F.col("_t") - F.col(t), F.lit(float("inf")))
    chosen = F.when((d0 <= d1) & (d0 <= most), F.col("_v0")).when(d1 <= most, F.col(value))
    return back.withColumn(value, chosen).drop("_t0", "_v0", "_t")


def observations(states: DataFrame, frames: DataFrame, by: list[str], t: str, camera: str, cameras: list[str]) -> DataFrame:
    """Each state with the time of the latest frame of each of a fixed list of cameras, and the greatest age in ms."""
    out = states
    for name in cameras:
        own = frames.filter(F.col(camera) == name).select(*by, t, F.col(t).alias(f"{name}_t"))
        out = asof_backward(out, own, by, t, [f"{name}_t"])
    ages = [(F.col(t) - F.col(f"{name}_t")) * 1000 for name in cameras]
    return out.withColumn("max_age_ms", F.array_max(F.array(*ages)))


def missing_expected(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(found.select(*on).distinct(), on, "left_anti")


def stale_replies(replies: DataFrame, requests: DataFrame, identity: list[str]) -> DataFrame:
    """Replies whose whole identity matches no request."""
    return replies.join(requests.select(*identity).distinct(), identity, "left_anti")


def with_spec(rows: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """``rows`` with a dimension table of fixed size."""
    return rows.join(F.broadcast(dim), on, "left")


def resolve_alias(rows: DataFrame, aliases: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """``status``: present, known but absent, or unknown; ``aliases`` (alias, name) and ``present`` (name) are small fixed tables."""
    known = rows.join(F.broadcast(aliases.select(F.col("alias").alias(name), F.col("name").alias("resolved"))), name, "left")
    held = known.join(F.broadcast(present.select(F.col("name").alias("resolved"), F.lit(True).alias("_here"))), "resolved", "left")
    return held.withColumn("status", F.when(F.col("resolved").isNull(), "unknown").when(F.col("_here"), "present").otherwise("absent")).drop("_here")


def attach_to_newest(messages: DataFrame, audio: DataFrame, by: list[str], order: str, wanted: Column) -> DataFrame:
    """Each group's audio with the newest wanted message of the group."""
    newest = messages.filter(wanted).groupBy(*by).agg(F.max(order).alias(order))
    return audio.join(newest, by, "left")


def same_plan(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def positional_delta(a: Column, b: Column, n: int) -> Column:
    """Largest difference of the first ``n`` items of two vectors."""
    return F.array_max(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y)))
