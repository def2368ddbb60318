"""Gates that a command passes before it is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import typed_json as j
from kinetrace.functions.vectors import all_finite, finite, within
from kinetrace.plans import dims


def mode_table(spark) -> DataFrame:
    """(mode, axes, base_moves): bit k of ``axes`` is set if the mode drives axis k; a row for each mode."""
    limited = len(dims.LOWS)
    rows = [(m, sum(1 << k for k in range(min(n, limited))), n == dims.AXES) for m, n in dims.MODE_AXES.items()]
    return spark.createDataFrame(rows, "mode string, axes int, base_moves boolean")


def policy_targets(rows: DataFrame, mode: str, action: str = "action", state: str = "state") -> DataFrame:
    """``rows`` with ``error``, the first broken rule of a target: its mode, widths, finite numbers, the first driven axis out of its limits, a base that moves where it may not.

    Which axes a mode drives is a set of bits joined to the rows, so one plan serves all modes; axes that are held may lie anywhere.
    """
    modes = F.broadcast(mode_table(rows.sparkSession).withColumnRenamed("mode", "_mode"))
    held = rows.join(modes, F.col(mode) == F.col("_mode"), "left")
    names, lows, highs, target = F.lit(list(dims.AXIS_NAMES)), F.lit(dims.LOWS), F.lit(dims.HIGHS), F.col(action)
    off = lambda x, i: F.when((F.call_function("shiftright", F.col("axes"), i).bitwiseAND(F.lit(1)) == 1) & ((x < F.get(lows, i)) | (x > F.get(highs, i))), F.get(names, i))
    first = F.get(F.array_compact(F.transform(F.slice(target, 1, len(dims.LOWS)), off)), F.lit(0))
    wide = lambda v: F.coalesce(F.size(v) != dims.AXES, F.lit(True))
    error = j.first_fault(
        (F.col("_mode").isNull(), "mode"),
        (wide(target) | wide(F.col(state)), "width"),
        (~F.coalesce(all_finite(target) & all_finite(F.col(state)), F.lit(False)), "not finite"),
        (first.isNotNull(), first),
        (~F.col("base_moves") & F.exists(F.slice(target, len(dims.LOWS) + 1, 2), lambda x: x != 0), "base"),
    )
    return held.withColumn("error", error).drop("_mode", "axes", "base_moves")


def gripper_fault(start: Column, position: Column, delta: Column, most: float, flag: Column) -> Column:
    """Why a gripper may not go to ``position``, or by ``delta`` from where it starts if that is null: a fault flag, feedback or target that are no finite
    numbers, a target out of its limits, too long a way."""
    low, high = dims.limits_of("left_gripper")
    fault = lambda target: j.first_fault(
        (F.coalesce(flag != 0, F.lit(True)), "fault flag"),
        (~finite(start), "feedback"),
        (~within(target, low, high), "target"),
        (F.abs(target - start) > most, "way"),
    )
    return j.bind(F.coalesce(position, start + delta), fault)


def request_format_fault(request_format: Column, mode: Column, hand: Column, entry_action: Column) -> Column:
    """Why a server's request format cannot carry a plan: the plain one knows no entry action, and the single-arm one neither the right hand alone nor two prompts."""
    alone = (mode == "dual_separate") | ((mode == "single") & F.coalesce(hand == "right", F.lit(False)))
    return j.first_fault(((request_format == "legacy") & entry_action.isNotNull(), "entry action"), ((request_format == "a90") & alone, "task"))


def task_plan(task: Column, item: Column, hand: Column, left_item: Column, right_item: Column, prompt: Column) -> Column:
    """``mode, hand, prompt, right_prompt`` of a task: ``single``, ``dual_separate``, or both hands one after the other.

    A prompt of one's own goes before the template but where each hand has its own; a template without its item is empty. Any hand but the right one is the left.
    """
    own, chosen = F.coalesce(F.trim(prompt), F.lit("")), F.when(hand == "right", "right").otherwise("left")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    grasp = lambda what, side: F.when(given(what), F.concat(F.lit("Grasp "), what, F.lit(" with the "), side, F.lit(" hand"))).otherwise("")
    left, right = grasp(left_item, F.lit("left")), grasp(right_item, F.lit("right"))
    both = F.when(given(left_item) & given(right_item), F.concat(left, F.lit(" and then grasp "), right_item, F.lit(" with the right hand."))).otherwise("")
    one, two = task == "single", task == "dual_separate"
    return F.struct(
        F.when(one, "single").when(two, "dual_separate").otherwise("dual_continuous").alias("mode"),
        F.when(one, chosen).alias("hand"),
        F.when(two, left).when(own != "", own).when(one, grasp(item, chosen)).otherwise(both).alias("prompt"),
        F.when(two, right).alias("right_prompt"),
    )
