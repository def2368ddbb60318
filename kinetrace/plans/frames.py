"""Queries over ``embeddings`` read as 23-axis frames: episode ``label``, frame ``vec_id``. Proxies, as no driver table holds frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions import vectors as v
from kinetrace.operators import control, correlate
from kinetrace.plans import dims
from kinetrace.session import table

ORDER = ["vec_id"]


def _frames(spark, sf_dir: str) -> DataFrame:
    action = F.transform(F.slice("embedding", 1, 23), lambda x: F.round(x.cast("double"), 4))
    state = F.transform(F.slice("embedding", 24, 23), lambda x: F.round(x.cast("double"), 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", action.alias("action"), state.alias("state"))


def vector_limits(spark, sf_dir):
    """Range of each limited axis in each episode, with its limits and whether it keeps them."""
    rows = _frames(spark, sf_dir).select("label", F.posexplode("action").alias("axis", "x"))
    spans = rows.groupBy("label", "axis").agg(F.min(v.finite_or_null(F.col("x"))).alias("low_seen"), F.max(v.finite_or_null(F.col("x"))).alias("high_seen"), F.max(F.abs("x")).alias("peak"))
    held = correlate.with_spec(spans, dims.axis_table(spark), "axis")
    ok = F.when(F.col("axis") < 21, (F.col("low_seen") >= F.col("low")) & (F.col("high_seen") <= F.col("high"))).otherwise(F.col("peak") <= 1e-9)
    return held.select("label", "axis", "name", "low_seen", "high_seen", ok.alias("ok"))


def limited_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", v.items_within(F.slice("action", 1, 21), dims.LOWS, dims.HIGHS, 0.02).alias("ok"), v.all_finite(F.col("action")).alias("finite"))


def mode_projection(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    total = lambda mode: F.round(F.aggregate(F.transform(v.project_mode(F.col("action"), F.col("state"), mode), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias(mode)
    return rows.select("vec_id", total("arms"), total("arms_lift"), total("full"))


def stage_mask(spark, sf_dir):
    stage = F.when(F.col("label") % 3 == 0, "dual_separate_left").when(F.col("label") % 3 == 1, "dual_separate_right").otherwise("single")
    masked = v.mask_stage(F.col("action"), F.col("state"), stage)
    return _frames(spark, sf_dir).select("vec_id", F.round(F.aggregate(F.transform(masked, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"))


def frame_delta(spark, sf_dir):
    a, s = F.col("action"), F.col("state")
    return _frames(spark, sf_dir).select(
        "vec_id",
        F.round(v.distance(a, s), 6).alias("distance"),
        F.round(v.largest_delta(a, s), 6).alias("largest"),
        F.round(correlate.positional_delta(a, s, 14), 6).alias("largest_arm"),
        v.exceeds_delta(s, a, 0.5).alias("too_far"),
    )


def chunk_stats(spark, sf_dir):
    """Statistics of one axis over an episode's chunks of frames, and the distinct rounded gripper values."""
    rows = _frames(spark, sf_dir).withColumn("chunk", F.floor(F.col("vec_id") / 50)).withColumn("lift", F.get("action", F.lit(16))).withColumn("grip", F.round(F.get("action", F.lit(7)), 1))
    return rows.groupBy("chunk").agg(
        F.min("lift").alias("low"), F.max("lift").alias("high"), F.min_by("lift", "vec_id").alias("first"), F.max_by("lift", "vec_id").alias("last"),
        F.array_join(F.sort_array(F.collect_set((F.col("grip") * 10).cast("int"))), ",").alias("grips"),
    )


def chunk_windows(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    return rows.select("vec_id", F.size(v.prefix(F.col("action"), 10)).alias("taken"), F.size(v.suffix(F.col("action"), (F.col("vec_id") % 30).cast("int"))).alias("left_over"))


def snapped(spark, sf_dir):
    near = F.transform("action", lambda x: F.when(F.abs(x) < 0.05, F.lit(5e-8)).otherwise(x))
    out = v.snap_items(F.slice(near, 1, 21), dims.LOWS, dims.HIGHS)
    return _frames(spark, sf_dir).select("vec_id", F.size(F.filter(out, lambda x: x == 0.0)).alias("at_limit"))


def bit_decode(spark, sf_dir):
    names = v.decode_bits((F.col("vec_id") * 2654435761 % 65536).cast("int"), list(dims.FAULT_BITS))
    return _frames(spark, sf_dir).select("vec_id", F.array_join(names, ",").alias("faults"))


def quaternions(spark, sf_dir):
    raw = F.slice("action", 1, 4)
    rows = _frames(spark, sf_dir).withColumn("raw", raw).withColumn("n", v.norm(F.col("raw"))).filter("n > 0").withColumn("q", F.transform("raw", lambda x: x / F.col("n")))
    before = F.lag("q").over(Window.partitionBy("label").orderBy(*ORDER))
    rows = rows.withColumn("before", before)
    return rows.select("vec_id", v.unit_quaternion(F.col("raw")).alias("unit"), F.round(v.quaternion_angle(F.col("q"), F.col("before")), 5).alias("turn"))


def wheel_speeds(spark, sf_dir):
    w = v.wheel_speeds(F.get("action", F.lit(21)), F.get("action", F.lit(22)), 0.0835, 0.379)
    return _frames(spark, sf_dir).select("vec_id", F.round(w["left"], 6).alias("left_speed"), F.round(w["right"], 6).alias("right_speed"))


def eased_ramps(spark, sf_dir):
    points = lambda smooth: F.round(F.aggregate(v.ramp(F.get("state", F.lit(0)), F.get("action", F.lit(0)), 10, smooth), F.lit(0.0), lambda s, x: s + x), 6)
    return _frames(spark, sf_dir).select("vec_id", points(False).alias("linear"), points(True).alias("eased"), F.round(v.duration_at(4.0, F.abs(F.get("action", F.lit(1))) + 0.1), 6).alias("duration"))


def image_geometry(spark, sf_dir):
    box = v.letterbox(F.col("vec_id") % 640 + 100, F.col("vec_id") * 7 % 480 + 100)
    depth = (F.col("vec_id") * 37 % 9000).cast("int")
    return _frames(spark, sf_dir).select("vec_id", box["width"].alias("width"), box["height"].alias("height"), box["left"].alias("pad_left"), box["top"].alias("pad_top"), v.depth_shade(depth).alias("shade"), v.depth_valid(depth).alias("valid"))


def slew_limited(spark, sf_dir):
    rows = _frames(spark, sf_dir).filter("vec_id is not null")
    out = control.slew_limit_rows(rows, ["label"], ORDER, "action", dims.ARM_JOINTS, 0.1)
    return out.select("vec_id", F.round(F.get("limited", F.lit(0)), 6).alias("axis0"), F.round(F.get("limited", F.lit(14)), 6).alias("axis14"), F.round(F.get("limited", F.lit(7)), 6).alias("axis7"))


def slew_report(spark, sf_dir):
    out = control.slew_limit_rows(_frames(spark, sf_dir), ["label"], ORDER, "action", dims.ARM_JOINTS, 0.1)
    return control.slew_report(out, ["label"], ORDER).select("label", "limited_steps", F.array_join("last_axes", ",").alias("last_axes"))


def convergence(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    near = control.converged(F.slice("action", 1, 2), F.slice("state", 1, 2), 0.2)
    return control.runs_of(rows, ["label"], ORDER, near).select("vec_id", F.col("run_length").cast("long").alias("run_length"))


QUERIES = {f.__name__: f for f in (
    vector_limits, limited_frames, mode_projection, stage_mask, frame_delta, chunk_stats, chunk_windows, snapped, bit_decode, quaternions, wheel_speeds, eased_ramps,
    image_geometry, slew_limited, slew_report, convergence,
)}

FRAMES = "f AS (SELECT vec_id, label, list_transform(embedding[1:23], lambda x: round(x::DOUBLE, 4)) AS action, list_transform(embedding[24:46], lambda x: round(x::DOUBLE, 4)) AS state FROM embeddings)"
LIMIT_ROWS = ", ".join(f"({i}, '{n}', {dims.limits_of(n)[0]}::DOUBLE, {dims.limits_of(n)[1]}::DOUBLE)" if i < 21 else f"({i}, '{n}', NULL, NULL)" for i, n in enumerate(dims.AXIS_NAMES))
NAMES = "[" + ", ".join(f"'{n}'" for n in dims.FAULT_BITS) + "]"
LOW_HIGH = f"{dims.LOWS}::DOUBLE[] AS lows, {dims.HIGHS}::DOUBLE[] AS highs"
RANGE = lambda n: f"unnest(range(1, {n + 1}))"
ORACLES = {
    "vector_limits": f"""WITH {FRAMES}, d(axis, name, low, high) AS (VALUES {LIMIT_ROWS}), x AS (SELECT label, (unnest(range(1, 24)) - 1)::INT AS axis, unnest(action) AS x FROM f)
SELECT label, axis, name, min(x) AS low_seen, max(x) AS high_seen, CASE WHEN axis < 21 THEN min(x) >= any_value(low) AND max(x) <= any_value(high) ELSE max(abs(x)) <= 1e-9 END AS ok FROM x JOIN d USING (axis) GROUP BY label, axis, name""",
    "limited_frames": f"WITH {FRAMES}, i AS (SELECT vec_id, {RANGE(21)} AS k, action, {LOW_HIGH} FROM f) SELECT vec_id, bool_and(action[k] >= lows[k] + 0.02 AND action[k] <= highs[k] - 0.02) AS ok, true AS finite FROM i GROUP BY 1",
    "mode_projection": f"""WITH {FRAMES}, i AS (SELECT vec_id, {RANGE(23)} AS k, action, state FROM f)
SELECT vec_id, round(sum(k * CASE WHEN k <= 16 THEN action[k] WHEN k <= 21 THEN state[k] ELSE 0 END), 6) AS arms, round(sum(k * CASE WHEN k <= 17 THEN action[k] WHEN k <= 21 THEN state[k] ELSE 0 END), 6) AS arms_lift, round(sum(k * action[k]), 6) AS "full" FROM i GROUP BY 1""",
    "stage_mask": f"""WITH {FRAMES}, i AS (SELECT vec_id, label, {RANGE(23)} AS k, action, state FROM f)
SELECT vec_id, round(sum(k * CASE WHEN label % 3 = 0 AND k BETWEEN 9 AND 16 THEN state[k] WHEN label % 3 = 1 AND k <= 7 THEN 0 WHEN label % 3 = 1 AND k = 8 THEN 1.5 ELSE action[k] END), 6) AS weighted FROM i GROUP BY 1""",
    "frame_delta": f"""WITH {FRAMES}, i AS (SELECT vec_id, {RANGE(23)} AS k, action, state FROM f)
SELECT vec_id, round(sqrt(sum((action[k] - state[k]) * (action[k] - state[k]))), 6) AS distance, round(max(abs(action[k] - state[k])), 6) AS largest, round(max(abs(action[k] - state[k])) FILTER (k <= 14), 6) AS largest_arm, bool_or(abs(action[k] - state[k]) > 0.5) AS too_far FROM i GROUP BY 1""",
    "chunk_stats": f"""WITH {FRAMES}, c AS (SELECT floor(vec_id / 50)::BIGINT AS chunk, vec_id, action[17] AS lift, (round(action[8], 1) * 10)::INT AS g FROM f)
SELECT chunk, min(lift) AS low, max(lift) AS high, arg_min(lift, vec_id) AS first, arg_max(lift, vec_id) AS last, array_to_string(list_sort(list_distinct(list(g))), ',') AS grips FROM c GROUP BY 1""",
    "chunk_windows": "SELECT vec_id, 10 AS taken, (23 - vec_id % 30 + abs(23 - vec_id % 30)) // 2 AS left_over FROM embeddings",
    "snapped": f"""WITH {FRAMES}, i AS (SELECT vec_id, {RANGE(21)} AS k, action, {LOW_HIGH} FROM f)
SELECT vec_id, count(*) FILTER (abs(action[k]) < 0.05 AND (abs(5e-8 - lows[k]) <= 1e-7 OR abs(5e-8 - highs[k]) <= 1e-7)) AS at_limit FROM i GROUP BY 1""",
    "bit_decode": f"SELECT vec_id, array_to_string(list_filter({NAMES}, lambda n, k: ((vec_id * 2654435761 % 65536)::BIGINT >> (k - 1)) & 1 = 1), ',') AS faults FROM embeddings",
    "quaternions": f"""WITH {FRAMES}, n AS (SELECT vec_id, label, action[1:4] AS r, sqrt(action[1]**2 + action[2]**2 + action[3]**2 + action[4]**2) AS n FROM f), q AS (SELECT *, list_transform(r, lambda x: x / n) AS q FROM n WHERE n > 0),
p AS (SELECT *, lag(q) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM q) SELECT vec_id, abs(n - 1) <= 0.02 AS unit, round(2 * acos(greatest(-1, least(1, abs(q[1] * b[1] + q[2] * b[2] + q[3] * b[3] + q[4] * b[4])))), 5) AS turn FROM p""",
    "wheel_speeds": f"WITH {FRAMES} SELECT vec_id, round((action[22] - action[23] * 0.379::DOUBLE / 2) / 0.0835::DOUBLE, 6) AS left_speed, round((action[22] + action[23] * 0.379::DOUBLE / 2) / 0.0835::DOUBLE, 6) AS right_speed FROM f",
    "eased_ramps": f"""WITH {FRAMES}, i AS (SELECT vec_id, state[1] AS a, action[1] - state[1] AS d, abs(action[2]) + 0.1::DOUBLE AS s, {RANGE(10)} / 10.0::DOUBLE AS p FROM f)
SELECT vec_id, round(sum(a + d * p), 6) AS linear, round(sum(a + d * (p * p * p * (p * (p * 6 - 15) + 10))), 6) AS eased, CASE WHEN any_value(s) BETWEEN 0.2 AND 2.0 THEN round(4.0::DOUBLE / any_value(s), 6) END AS duration FROM i GROUP BY 1""",
    "image_geometry": """WITH s AS (SELECT vec_id, (vec_id % 640 + 100)::DOUBLE AS w, (vec_id * 7 % 480 + 100)::DOUBLE AS h, vec_id * 37 % 9000 AS d FROM embeddings), r AS (SELECT *, greatest(w / 224, h / 224) AS r FROM s), t AS (SELECT *, floor(w / r)::INT AS nw, floor(h / r)::INT AS nh FROM r)
SELECT vec_id, nw AS width, nh AS height, (224 - nw) // 2 AS pad_left, (224 - nh) // 2 AS pad_top, CASE WHEN d = 0 THEN 0 ELSE floor(greatest(0, least(255, d * 0.03::DOUBLE)))::INT END AS shade, d BETWEEN 100 AND 5000 AS valid FROM t""",
    "slew_limited": f"""WITH RECURSIVE {FRAMES}, n AS (SELECT vec_id, label, action[1] AS a, action[15] AS b, action[8] AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM f),
s AS (SELECT vec_id, label, r, a, b, g FROM n WHERE r = 1 UNION ALL SELECT n.vec_id, n.label, n.r, s.a + greatest(-0.1::DOUBLE, least(0.1::DOUBLE, n.a - s.a)), s.b + greatest(-0.1::DOUBLE, least(0.1::DOUBLE, n.b - s.b)), n.g FROM s JOIN n ON n.label = s.label AND n.r = s.r + 1)
SELECT vec_id, round(a, 6) AS axis0, round(b, 6) AS axis14, round(g, 6) AS axis7 FROM s""",
    "slew_report": f"""WITH RECURSIVE {FRAMES}, n AS (SELECT vec_id, label, list_select(action, {[k + 1 for k in dims.ARM_JOINTS]}) AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM f),
s AS (SELECT vec_id, label, r, a AS sent, []::INT[] AS axes FROM n WHERE r = 1 UNION ALL
  SELECT n.vec_id, n.label, n.r, list_transform(n.a, lambda x, i: CASE WHEN x - s.sent[i] > 0.1 THEN s.sent[i] + 0.1::DOUBLE WHEN x - s.sent[i] < -0.1 THEN s.sent[i] - 0.1::DOUBLE ELSE x END),
    list_filter(list_transform(n.a, lambda x, i: CASE WHEN abs(x - s.sent[i]) > 0.1 THEN ({list(dims.ARM_JOINTS)})[i] END), lambda k: k IS NOT NULL) FROM s JOIN n ON n.label = s.label AND n.r = s.r + 1)
SELECT label, count(*) FILTER (len(axes) > 0) AS limited_steps, array_to_string(arg_max(axes, vec_id) FILTER (len(axes) > 0), ',') AS last_axes FROM s GROUP BY label""",
    "convergence": f"""WITH {FRAMES}, o AS (SELECT vec_id, label, coalesce(greatest(abs(action[1] - state[1]), abs(action[2] - state[2])) <= 0.2, false) AS ok FROM f), i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS g FROM o)
SELECT vec_id, CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY label, g ORDER BY vec_id) ELSE 0 END::BIGINT AS run_length FROM i""",
}
