"""Freshness, rates and counters of streams of timestamped records, for recorded data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions.clock import age_ms
from kinetrace.functions.vectors import finite


def mark_repeats(rows: DataFrame, by: list[str], order: list[str], stamp: str) -> DataFrame:
    """``repeat``: whether a row's stamp equals that of the row before; only neighbours count."""
    before = F.lag(stamp).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("repeat", F.coalesce(before == F.col(stamp), F.lit(False)))


def stream_counters(marked: DataFrame, by: list[str], invalid: Column) -> DataFrame:
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("polls"),
        F.count_if(~F.col("repeat") & ~invalid).alias("fresh"),
        F.count_if(F.col("repeat")).alias("repeats"),
        F.count_if(~F.col("repeat") & invalid).alias("invalid"),
    )


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by partial aggregation rather than a sort."""
    rest = [c for c in rows.columns if c not in by]
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_age(rows: DataFrame, t: Column, now: Column, limit_s: float) -> DataFrame:
    """``age_ms`` (at least 0) and whether it is within the limit."""
    return rows.withColumn("age_ms", age_ms(now, t)).withColumn("fresh", F.col("age_ms") <= limit_s * 1000)


def trailing_rate(rows: DataFrame, by: list[str], t: str, span: int, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``rate``: arrivals per unit of ``t`` in the span that ends at each row, (n - 1) / (last - first); 0 for less than two or no time between.

    With ``most``, only the last so many arrivals are remembered, as in a ring: those up to the row itself, in ``order``, rows of equal ``t`` one after another.

    Time is cut into slots that are no longer than the span, so a row counts all rows of its own slot before it, and those of the slots that the span reaches
    back to as far as they are not too old. Rows go to their slot and to the later ones that they may count in; frames only grow, so work is that of sorting,
    however many rows a span holds, and slots are worked on apart from one another.
    """
    if span <= 0:
        return rows.withColumn("rate", F.lit(0.0))
    now = F.col(t)
    if dict(rows.dtypes)[t] in ("tinyint", "smallint", "int", "bigint"):
        slots = [now - F.pmod(now, F.lit(span)) + k * span for k in range(2)]
    else:
        # dividing by a power of two is exact
        slots = [F.floor(F.when(F.abs(now) < float("inf"), now) / F.lit(2.0 ** math.floor(math.log2(span)))) + k for k in range(3)]
    whole = F.struct(*rows.columns)
    copies = F.array(*[F.struct(s.alias("slot"), (whole if k == 0 else F.lit(None)).alias("row")) for k, s in enumerate(slots)])
    keys = list(dict.fromkeys([*by, t, *(order or [])]))
    dealt = rows.select(*keys, F.explode(copies).alias("_c")).select(*keys, F.col("_c.slot").alias("_slot"), F.col("_c.row").alias("_row"))
    past = F.col("_row").isNull()
    dealt = dealt.filter(~past | F.col("_slot").isNotNull())
    slot = Window.partitionBy(*by, "_slot")
    # from the newest row back: a past row comes before the rows whose span holds it
    back = slot.orderBy(F.when(past, now).otherwise(now - span).desc(), past.desc())
    waiting, oldest = F.count_if(past).over(back), F.min(F.when(past, now)).over(back)
    ahead = slot.orderBy(t) if most is None else slot.orderBy(t, *(order or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = dealt.withColumn("_n", F.count_if(~past).over(ahead)).withColumn("_first", F.min(F.when(~past, now)).over(ahead))
    if most is not None:
        held = held.withColumn("_ring", F.lag(t, most - 1).over(slot.orderBy(t, *(order or []))))
    held = held.withColumn("_n", F.col("_n") + waiting).withColumn("_first", F.coalesce(oldest, "_first")).filter(~past)
    n, first = F.col("_n"), F.col("_first")
    if most is not None:
        n, first = F.least(n, F.lit(most)), F.greatest(first, "_ring")
    rate = F.when((n < 2) | (now <= first), F.lit(0.0)).otherwise((n - 1) / (now - first))
    return held.select(*[F.col("_row")[c].alias(c) for c in rows.columns], rate.alias("rate"))


def silent_gaps(rows: DataFrame, by: list[str], order: list[str], t: str, limit: float) -> DataFrame:
    """Rows after which nothing came for more than ``limit``, with the gap."""
    gap = F.lead(t).over(Window.partitionBy(*by).orderBy(*order)) - F.col(t)
    return rows.withColumn("gap", gap).filter(F.col("gap") > limit)


def changes(rows: DataFrame, by: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Rows whose state differs from the row before, nulls compared as values."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.struct(*state)
    return rows.withColumn("_before", F.lag(now).over(w)).filter(~F.col("_before").eqNullSafe(now)).drop("_before")


def transitions(rows: DataFrame, by: list[str], order: list[str], phase: str) -> DataFrame:
    """How often each phase followed another within a key."""
    before = F.lag(phase).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(phase))).groupBy("before", F.col(phase).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, by: list[str], order: list[str], t: str, gap: float, longest: float) -> DataFrame:
    """Sessions that end after ``gap`` without a row; one that lasts longer than ``longest`` is cut into parts of that length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)), 1).otherwise(0)
    held = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    start = F.min(t).over(Window.partitionBy(*by, "session"))
    held = held.withColumn("part", F.floor((F.col(t) - start) / F.lit(longest)).cast("long"))
    return held.groupBy(*by, "session", "part").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))


def all_healthy(streams: DataFrame, healthy: Column, name: str) -> DataFrame:
    """Whether every stream is healthy, and the names of those that are not; a stream is a row, so the list is short."""
    return streams.agg(F.coalesce(F.bool_and(healthy), F.lit(False)).alias("healthy"), F.sort_array(F.collect_list(F.when(~healthy, F.col(name)))).alias("missing"))


def send_gaps(sends: DataFrame, motor: str, t: str, sample: str) -> DataFrame:
    """The largest time between two commands to a motor within each sample interval."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(motor).orderBy(t))
    return sends.withColumn("_gap", gap).groupBy(motor, sample).agg(F.max("_gap").alias("max_gap"))


def battery(percent: Column, charging: Column, fresh: Column) -> Column:
    """Percent and charging of a fresh reading with 0 to 100 percent, else null."""
    return F.when(F.coalesce(fresh & finite(percent) & percent.between(0, 100) & charging.isNotNull(), F.lit(False)), F.struct(percent.alias("percent"), charging.alias("charging")))


def battery_level(percent: Column, charging: Column) -> Column:
    return F.when(percent.isNull() | charging.isNull(), "unknown").when(charging, "charging").when(percent <= 20, "low").otherwise("normal")


def battery_label(percent: Column) -> Column:
    """Half up, as displays round."""
    return F.when(percent.isNull(), "--").otherwise(F.concat(F.floor(percent + 0.5).cast("string"), F.lit("%")))


def may_move(soc: Column, status: Column, chassis: bool = False) -> Column:
    """Power gate: less than 10 percent blocks unless it charges (status 1); the chassis never moves while it charges."""
    weak = (soc < 10) & (status != 1)
    return F.coalesce(~weak & (status != 1) if chassis else ~weak, F.lit(False))
