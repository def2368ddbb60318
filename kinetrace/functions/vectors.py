"""Arrays of axes: finiteness, limits, projections, distances, interpolation; all within whole rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetrace.plans import dims


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def all_finite(v: Column) -> Column:
    return F.forall(v, finite)


def finite_items_or_null(v: Column) -> Column:
    return F.transform(v, finite_or_null)


def within(x: Column, low: Column | float, high: Column | float, margin: float = 0.0) -> Column:
    return F.coalesce(finite(x) & (x >= F.lit(low) + margin if not isinstance(low, Column) else x >= low + margin) & (x <= F.lit(high) - margin if not isinstance(high, Column) else x <= high - margin), F.lit(False))


def items_within(v: Column, lows: list[float], highs: list[float], margin: float = 0.0) -> Column:
    """Whether every item lies within its own limits, shrunk by ``margin``; a null or NaN item or another length fails."""
    ok = lambda x, i: F.coalesce(finite(x) & (x >= F.get(F.lit(lows), i) + margin) & (x <= F.get(F.lit(highs), i) - margin), F.lit(False))
    return (F.size(v) == len(lows)) & F.forall(F.transform(v, ok), lambda b: b)


def exceeds_delta(start: Column, target: Column, most: float) -> Column:
    return F.exists(F.zip_with(start, target, lambda a, b: F.abs(b - a)), lambda d: d > most)


def snap(x: Column, low: Column, high: Column, near: float = 1e-7) -> Column:
    """``x``, or the limit that it is nearly at."""
    lowered = F.when(F.abs(x - low) <= near, low).otherwise(x)
    return F.when(F.abs(lowered - high) <= near, high).otherwise(lowered)


def snap_items(v: Column, lows: list[float], highs: list[float], near: float = 1e-7) -> Column:
    return F.transform(v, lambda x, i: snap(x, F.get(F.lit(lows), i), F.get(F.lit(highs), i), near))


def wire_vector(arm: Column, effector: Column, waist: Column, head: Column, base: Column) -> Column:
    """The 23 axes from grouped parts: seven joints and gripper of each arm, waist, head, base."""
    return F.concat(F.slice(arm, 1, 7), F.slice(effector, 1, 1), F.slice(arm, 8, 7), F.slice(effector, 2, 1), waist, head, base)


def project_mode(action: Column, held: Column, mode: str) -> Column:
    """The axes that a mode enables, the others from ``held``, and a base at rest unless all are enabled."""
    n = dims.MODE_AXES[mode]
    if n == dims.AXES:
        return action
    return F.concat(F.slice(action, 1, n), F.slice(held, n + 1, dims.AXES - 2 - n), F.lit([0.0, 0.0]))


def mask_stage(action: Column, held: Column, stage: Column) -> Column:
    """The action with the side that a stage doesn't use held at its start or put to rest."""
    right = F.transform(action, lambda x, i: F.when(i.isin(*dims.RIGHT_SIDE), F.get(held, i)).otherwise(x))
    left = F.transform(action, lambda x, i: F.when(i.isin(*dims.LEFT_ARM), F.lit(0.0)).when(i == 7, F.lit(1.5)).otherwise(x))
    return F.when(stage == "dual_separate_left", right).when(stage == "dual_separate_right", left).otherwise(action)


def prefix(actions: Column, steps: Column | int) -> Column:
    return F.slice(actions, F.lit(1), F.least(F.size(actions), F.lit(steps) if isinstance(steps, int) else steps))


def suffix(actions: Column, cursor: Column) -> Column:
    return F.slice(actions, cursor + 1, F.greatest(F.lit(0), F.size(actions) - cursor))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean; null for different lengths."""
    return F.when(F.size(a) == F.size(b), norm(F.zip_with(a, b, lambda x, y: x - y)))


def largest_delta(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def unit_quaternion(q: Column, tolerance: float = 0.02) -> Column:
    return F.coalesce((F.size(q) == 4) & all_finite(q) & (F.abs(norm(q) - 1) <= tolerance), F.lit(False))


def quaternion_angle(a: Column, b: Column) -> Column:
    dot = F.abs(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def wheel_speeds(linear: Column, angular: Column, radius: float, track: float, left_sign: int = 1, right_sign: int = 1) -> Column:
    turn = angular * F.lit(track) / 2
    return F.struct((F.lit(left_sign) * (linear - turn) / radius).alias("left"), (F.lit(right_sign) * (linear + turn) / radius).alias("right"))


def smoothstep(p: Column) -> Column:
    """Quintic ease from 0 to 1 without jumps in speed or acceleration."""
    return p * p * p * (p * (p * 6 - 15) + 10)


def ramp(start: Column, target: Column, steps: int, smooth: bool = False) -> Column:
    """``steps`` points from after ``start`` to ``target``."""
    share = lambda i: i / F.lit(float(steps))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: start + (target - start) * (smoothstep(share(i)) if smooth else share(i)))


def duration_at(base_s: float, scale: Column, least: float = 0.2, most: float = 2.0) -> Column:
    return F.when(within(scale, least, most), F.lit(base_s) / scale)


def decode_bits(flag: Column, names: list[str]) -> Column:
    """The names of the bits that are set, lowest first."""
    return F.filter(F.lit(names), lambda n, i: F.get(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.call_function("shiftright", flag, k).bitwiseAND(F.lit(1))), i) == 1)


def letterbox(width: Column, height: Column, to_width: int = 224, to_height: int = 224) -> Column:
    """Size and padding of an image that is scaled to fit a frame without changing its shape."""
    ratio = F.greatest(width / F.lit(to_width), height / F.lit(to_height))
    w, h = F.floor(width / ratio).cast("int"), F.floor(height / ratio).cast("int")
    left, top = F.floor((F.lit(to_width) - w) / 2).cast("int"), F.floor((F.lit(to_height) - h) / 2).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), left.alias("left"), top.alias("top"), (F.lit(to_width) - w - left).alias("right"), (F.lit(to_height) - h - top).alias("bottom"))


def depth_shade(depth: Column, scale: float = 0.03) -> Column:
    """0 to 255 for a depth in millimetres; 0 for an invalid one (0 or 65535)."""
    return F.when(depth.isNull() | depth.isin(0, 65535), F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), depth * F.lit(scale)))).cast("int"))


def depth_valid(depth: Column, near: int = 100, far: int = 5000) -> Column:
    return F.coalesce(depth.between(near, far) & (depth != 65535), F.lit(False))


def back_project(u: Column, v: Column, z: Column, fx: float, fy: float, px: float, py: float) -> Column:
    """The point in space of a pixel of a pinhole camera."""
    return F.struct(((u - px) * z / fx).alias("x"), ((v - py) * z / fy).alias("y"), z.alias("z"))
