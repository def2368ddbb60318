"""Clocks: epoch values of zone-free timestamps, unit detection, ages, ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch values whose median is beyond this are milliseconds.
MILLISECONDS = 1e11


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)


def unit_divisor(median: Column) -> Column:
    """1000 for epoch milliseconds, else 1; subtract the origin before dividing by it."""
    return F.when(median > MILLISECONDS, F.lit(1000.0)).otherwise(F.lit(1.0))


def age_ms(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), now - then) * 1000


def tick(t: Column, base: Column, rate: float) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((t - base) * F.lit(float(rate)) + F.lit(1e-7)).cast("long"))


def next_tick(previous: Column, now: Column, period: float) -> Column:
    """The first time of a fixed phase after ``now``; periods that have passed are skipped."""
    return F.when(now < previous, previous).otherwise(previous + (F.floor((now - previous) / F.lit(float(period))) + 1) * F.lit(float(period)))
