"""Small dimension tables: axes, limits, fault bits. Their sizes are fixed, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AXES = 23
# Axis order of a wire vector, limits of each motor, bits of a fault flag, axes of a mode.
JOINTS = ("shoulder_pitch", "shoulder_roll", "shoulder_yaw", "elbow", "wrist_roll", "wrist_yaw", "wrist_pitch")
AXIS_NAMES = (
    *(f"left_{j}" for j in JOINTS), "left_gripper", *(f"right_{j}" for j in JOINTS), "right_gripper",
    "lift", "waist_pitch", "waist_yaw", "head_yaw", "head_pitch", "linear", "angular",
)
LIMITS = {
    "shoulder_pitch": (-2.7, 1.5), "left_shoulder_roll": (-0.3, 2.0), "right_shoulder_roll": (-2.0, 0.3), "shoulder_yaw": (-2.9, 2.9), "elbow": (-1.3, 1.5),
    "wrist_roll": (-2.9, 2.9), "wrist_yaw": (-1.0, 1.0), "wrist_pitch": (-1.0, 1.0), "gripper": (0.0, 1.5),
    "lift": (0.0, 0.8), "waist_pitch": (0.0, 1.3), "waist_yaw": (-0.7, 0.7), "head_yaw": (-1.5, 1.5), "head_pitch": (-0.5, 0.75),
}
FAULT_BITS = (
    "disconnected", "overvoltage", "undervoltage", "overheat", "blocked", "overcurrent", "communication_loss", "overload",
    "battery_low", "overspeed", "encoder_fault", "brake_overvoltage", "driver_fault", "coil_overtemperature", "mos_overtemperature", "other_error",
)
MODE_AXES = {"arms": 16, "arms_lift": 17, "full": 23}
LEFT_ARM, RIGHT_SIDE = tuple(range(7)), tuple(range(8, 16))
ARM_JOINTS = (*range(7), *range(8, 15))
GRIPPERS = (7, 15)


def limits_of(axis: str) -> tuple[float, float]:
    return LIMITS.get(axis) or LIMITS[axis.split("_", 1)[1]]


LOWS = [limits_of(a)[0] for a in AXIS_NAMES[:21]]
HIGHS = [limits_of(a)[1] for a in AXIS_NAMES[:21]]


def axis_table(spark: SparkSession) -> DataFrame:
    """(axis, name, low, high): one row for each of the 23 axes; the base has no limits."""
    rows = [(i, n, *(limits_of(n) if i < 21 else (None, None))) for i, n in enumerate(AXIS_NAMES)]
    return spark.createDataFrame(rows, "axis int, name string, low double, high double")


def motor_table(spark: SparkSession) -> DataFrame:
    """(motor_id, name, low, high, interpolate): one row for each of the 21 motors."""
    order = ("lift", "waist_pitch", "waist_yaw", "head_yaw", "head_pitch", *AXIS_NAMES[:16])
    held = ("lift", "left_gripper", "right_gripper")
    return spark.createDataFrame([(k + 2, n, *limits_of(n), n not in held) for k, n in enumerate(order)], "motor_id int, name string, low double, high double, interpolate boolean")
