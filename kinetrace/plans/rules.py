"""Queries that apply record rules to ``events`` and ``part`` as proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrace.functions import checks
from kinetrace.session import table


def image_checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = F.when(F.col("event_type") == "click", "rgb").when(F.col("event_type") == "view", "depth").otherwise("other")
    dtype = F.when(F.col("event_id") % 3 == 0, "uint8").otherwise("uint16")
    error = checks.image_error(stream, dtype, F.lit(640), F.when(F.col("event_id") % 5 == 0, 400).otherwise(480), F.when(F.col("event_id") % 3 == 0, 3))
    return e.select("event_id", error.alias("error"))


def plan_checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("event_id") % n).cast("int"))
    prompt, right = pick(4, "use the left hand", "right: pick", "left or right", " "), pick(3, None, "the right one", "  ")
    errors = checks.plan_errors(pick(7, "custom", "single", "dual_separate", "odd", "dual_continuous", "single", "dual_separate"), pick(3, "arms", "full", "arms_lift"), pick(5, "left", "right", None, "up", None), prompt, right)
    return e.select("event_id", F.array_join(errors, ";").alias("errors"))


def setting_checks(spark, sf_dir):
    v = F.col("value")
    errors = checks.setting_errors({"trigger_index": F.floor(v), "delay_initial_steps": F.floor(v / 2), "delay_window": v, "max_guidance_weight": v / 10, "max_observation_age_s": v / 20 - 1})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ";").alias("errors"))


def source_checks(spark, sf_dir):
    v = F.col("value")
    error = checks.source_error(F.col("event_type") != "error", F.when(v < 50, 0.0).otherwise(v), F.when(F.col("event_id") % 2 == 0, "full").otherwise("arms"))
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"), F.round(checks.playback_seconds(v, F.col("event_id") % 4 * 0.5), 6).alias("seconds"), F.round(checks.progress(v, F.col("event_id") % 3), 6).alias("ratio"))


def motor_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ok = checks.motor_valid(F.col("p_partkey").cast("double"), F.col("p_size").cast("double"), F.col("p_retailprice") / 40)
    return p.select("p_partkey", ok.alias("ok"))


def first_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    return checks.first_of_equal(rows, ["p_brand", "p_size"], "p_partkey")


QUERIES = {f.__name__: f for f in (image_checks, plan_checks, setting_checks, source_checks, motor_checks, first_parts)}
ORACLES = {
    "image_checks": """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'stream' WHEN (event_type = 'click') <> (event_id % 3 = 0) THEN 'type' WHEN event_id % 5 = 0 THEN 'size' END AS error FROM events""",
    "plan_checks": """WITH p AS (SELECT event_id, ['custom', 'single', 'dual_separate', 'odd', 'dual_continuous', 'single', 'dual_separate'][event_id % 7 + 1] AS m, ['arms', 'full', 'arms_lift'][event_id % 3 + 1] AS x, ['left', 'right', NULL, 'up', NULL][event_id % 5 + 1] AS h,
event_id % 4 AS p, event_id % 3 AS r FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN m = 'odd' THEN 'mode' END, CASE WHEN x = 'full' AND m = 'dual_separate' THEN 'full needs one prompt' END, CASE WHEN p = 3 THEN 'prompt' END, CASE WHEN h = 'up' THEN 'hand' END, CASE WHEN m = 'single' AND h IS NULL THEN 'single needs a hand' END,
CASE WHEN m <> 'single' AND h IS NOT NULL THEN 'hand not accepted' END, CASE WHEN m = 'dual_separate' AND r = 0 THEN 'right prompt needed' END, CASE WHEN m <> 'dual_separate' AND r > 0 THEN 'right prompt not accepted' END, CASE WHEN r = 2 THEN 'right prompt' END,
CASE WHEN m = 'single' AND CASE WHEN p = 0 THEN 'left' WHEN p = 1 THEN 'right' END IS DISTINCT FROM h THEN 'prompt and hand' END, CASE WHEN m = 'dual_separate' AND NOT (p = 0 AND r = 1) THEN 'left and then right' END], lambda e: e IS NOT NULL), ';') AS errors FROM p""",
    "setting_checks": """SELECT event_id, array_to_string(list_filter([CASE WHEN floor(value) BETWEEN 1 AND 49 THEN NULL ELSE 'trigger_index' END, CASE WHEN floor(value / 2) BETWEEN 0 AND 24 THEN NULL ELSE 'delay_initial_steps' END,
CASE WHEN value = floor(value) AND value BETWEEN 1 AND 1000 THEN NULL ELSE 'delay_window' END, CASE WHEN value / 10 BETWEEN 0 AND 5 THEN NULL ELSE 'max_guidance_weight' END, CASE WHEN value / 20 - 1 > 0 AND value / 20 - 1 <= 2 THEN NULL ELSE 'max_observation_age_s' END], lambda e: e IS NOT NULL), ';') AS errors FROM events""",
    "source_checks": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN event_id % 2 = 0 AND value >= 50 THEN 'base moves' END AS error, CASE WHEN event_id % 4 > 0 THEN round(value / (event_id % 4 * 0.5::DOUBLE), 6) END AS seconds,
round(CASE WHEN event_id % 3 > 0 THEN value / (event_id % 3) ELSE 0 END, 6) AS ratio FROM events""",
    "motor_checks": "SELECT p_partkey, p_retailprice / 40 > p_size AS ok FROM part",
    "first_parts": "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2",
}
