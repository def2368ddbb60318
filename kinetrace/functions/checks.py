"""Rules over whole records: a name or list of what is wrong, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions.text import prompt_direction
from kinetrace.functions.vectors import finite, within

# Size of an image, modes of a plan, settings of a schedule with their ranges.
WIDTH, HEIGHT = 640, 480
PLAN_MODES = ("custom", "single", "dual_continuous", "dual_separate")
WHOLE_SETTINGS = {"trigger_index": (1, 49), "delay_initial_steps": (0, 24), "safety_reserve_steps": (0, 49), "num_denoising_steps": (1, 50), "delay_window": (1, 1000), "delay_margin_steps": (0, 49), "dry_run_chunks": (2, 20)}
REAL_SETTINGS = {"max_guidance_weight": (0.0, 5.0), "max_observation_age_s": (0.0, 2.0), "warmup_timeout_s": (0.0, 600.0)}


def image_error(stream: Column, dtype: Column, width: Column, height: Column, channels: Column) -> Column:
    """What is wrong with a frame, from its metadata alone."""
    colour = (dtype == "uint8") & (channels == 3)
    depth = (dtype == "uint16") & channels.isNull()
    sound = F.when(stream == "rgb", colour).when(stream == "depth", depth)
    return F.when(sound.isNull(), "stream").when(~F.coalesce(sound, F.lit(False)), "type").when(~F.coalesce((width == WIDTH) & (height == HEIGHT), F.lit(False)), "size")


def source_error(available: Column, base_abs_max: Column, mode: Column) -> Column:
    """Why a source of an episode cannot be played: not there, or a moving base where the whole body plays."""
    moving = F.when(~F.coalesce(finite(base_abs_max), F.lit(False)), "base unknown").when(base_abs_max > 1e-9, "base moves")
    return F.when(~F.coalesce(available, F.lit(False)), "unavailable").when(mode == "full", moving)


def playback_seconds(duration: Column, speed: Column) -> Column:
    return F.when(speed > 0, duration / speed)


def plan_errors(mode: Column, execution: Column, hand: Column, prompt: Column, right_prompt: Column) -> Column:
    """The rules that a plan breaks, as an array."""
    m, h = F.lower(F.trim(mode)), F.lower(F.trim(hand))
    rules = {
        "mode": ~F.coalesce(m.isin(*PLAN_MODES), F.lit(False)),
        "execution": ~F.coalesce(execution.isin("arms", "arms_lift", "full"), F.lit(False)),
        "full needs one prompt": (execution == "full") & (m == "dual_separate"),
        "prompt": F.coalesce(F.trim(prompt) == "", F.lit(True)),
        "hand": h.isNotNull() & ~h.isin("left", "right"),
        "single needs a hand": (m == "single") & h.isNull(),
        "hand not accepted": (m != "single") & h.isNotNull(),
        "right prompt needed": (m == "dual_separate") & right_prompt.isNull(),
        "right prompt not accepted": (m != "dual_separate") & right_prompt.isNotNull(),
        "right prompt": F.trim(right_prompt) == "",
        "prompt and hand": (m == "single") & ~prompt_direction(prompt).eqNullSafe(h),
        "left and then right": (m == "dual_separate") & ~(prompt_direction(prompt).eqNullSafe(F.lit("left")) & prompt_direction(right_prompt).eqNullSafe(F.lit("right"))),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def setting_errors(settings: dict[str, Column]) -> Column:
    """Settings of a schedule that are no whole numbers, or out of range; the two times must be over 0."""
    bad = [F.when(~F.coalesce((settings[k] == F.floor(settings[k])) & settings[k].between(a, b), F.lit(False)), F.lit(k)) for k, (a, b) in WHOLE_SETTINGS.items() if k in settings]
    for k, (a, b) in REAL_SETTINGS.items():
        if k in settings:
            low = settings[k] >= a if k == "max_guidance_weight" else settings[k] > a
            bad.append(F.when(~F.coalesce(finite(settings[k]) & low & (settings[k] <= b), F.lit(False)), F.lit(k)))
    return F.array_compact(F.array(*bad))


def motor_valid(motor_id: Column, low: Column, high: Column) -> Column:
    return F.coalesce((motor_id == F.floor(motor_id)) & finite(low) & finite(high) & (high > low), F.lit(False))


def motor_defaults(rows: DataFrame) -> DataFrame:
    """Names, group, unit and a positive step for motors (id, key, label, group, unit, step); a missing step is null, any value."""
    number = F.col("id").cast("string")
    return rows.select(
        "id", F.coalesce("key", F.concat(F.lit("motor_"), number)).alias("key"), F.coalesce("label", F.concat(F.lit("motor "), number)).alias("label"),
        F.coalesce("group", F.lit("")).alias("group"), F.coalesce("unit", F.lit("")).alias("unit"), F.when(finite(F.col("step")) & (F.col("step") > 0), F.col("step")).alias("step"),
    )


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))


def tracking_error(target: Column, measured: Column) -> Column:
    return F.zip_with(target, measured, lambda a, b: a - b)


def pose_gate(distance: Column, angle: Column, most_distance: float, most_angle: float) -> Column:
    return within(distance, 0.0, most_distance) & within(angle, 0.0, most_angle)


def coherent(before: Column, after: Column) -> Column:
    """Whether what was read at the start of a capture still holds at its end."""
    return before.eqNullSafe(after)


def first_of_equal(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def run_id(started: Column, suffix: Column) -> Column:
    return F.concat_ws("_", F.date_format(started, "yyyyMMdd_HHmmss"), suffix)


def task_prompt(item: Column, hand: Column) -> Column:
    """The prompt of one hand; :func:`kinetrace.operators.policy.task_plan` builds those of whole tasks."""
    return F.format_string("Grasp %s with the %s hand", item, hand)
