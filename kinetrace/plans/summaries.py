"""Queries that summarise and reshape records: runs, episodes, traces, names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions import checks, text
from kinetrace.functions.clock import micros
from kinetrace.operators import correlate, dialogue, trace
from kinetrace.plans.frames import FRAMES, LIMIT_ROWS, _frames
from kinetrace.sources import audio, episodes
from kinetrace.session import table

KINDS = ("state", "step", "chunk", "fault")


def _pick(*values):
    return F.get(F.lit(list(values)), (F.col("event_id") % len(values)).cast("int"))


def run_summaries(spark, sf_dir):
    """Events of each user's run and the largest refresh gap over all axes of its states; some gaps are null or no number."""
    gap = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), _pick(*KINDS).alias("kind"), F.array(gap, F.lit(None).cast("double"), gap / 2).alias("refresh_gap_ms"))
    return trace.run_summary(rows).select("run_id", "events", "max_refresh_gap_ms")


def speech_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 2000).alias("part"), _pick("start", "partial", "audio", "final", "audio").alias("kind"), (micros("ts") / 1e6).alias("t"), (F.col("event_id") % 9600).alias("size"))
    out = dialogue.speech_metrics(rows, ["user_id", "part"], "kind", "t", "size")
    return out.select("user_id", "part", *[F.round(c, 2).alias(c) for c in ("first_partial_ms", "final_ms", "audio_ms")])


def alias_lookup(spark, sf_dir):
    """Names by which events ask for cameras: present ones, known ones that are absent, and unknown ones."""
    aliases = spark.createDataFrame([("head", "cam_high"), ("cam_high", "cam_high"), ("left", "cam_left"), ("side", "cam_side")], "alias string, name string")
    present = spark.createDataFrame([("cam_high",), ("cam_side",)], "name string")
    rows = table(spark, sf_dir, "events").select("event_id", _pick("head", "left", "cam_high", "rear", "side").alias("camera"))
    return correlate.resolve_alias(rows, aliases, present, "camera").select("event_id", "resolved", "status")


def axis_cells(spark, sf_dir):
    """Traces with arrays of different lengths as one row per axis: what each axis gathers."""
    rows = _frames(spark, sf_dir).select("vec_id", "label", "action", F.slice("state", 1, F.col("label") + 12).alias("state"))
    cells = trace.axis_rows(rows, ["action", "state"], ["vec_id", "label"])
    return cells.groupBy("label", "axis").agg(F.count("action").alias("actions"), F.count("state").alias("states"), F.round(F.sum("action"), 4).alias("sent"), F.round(F.coalesce(F.sum("state"), F.lit(0.0)), 4).alias("held"))


def wide_rows(spark, sf_dir):
    """One row per user and thousand events, a column for each kind of event."""
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 1000).alias("part"), "event_type", "value")
    wide = trace.wide_samples(rows, ["user_id", "part"], ["value"], ["click", "view", "error"], "event_type")
    return wide.select("user_id", "part", F.col("`value.click`").alias("click"), F.col("`value.view`").alias("view"), F.col("`value.error`").alias("error"))


def followed_targets(spark, sf_dir):
    """The axis that follows its target worst in each frame, and whether the frame's plan is that of the frame before."""
    # differences of values of four decimals: without their last bits, so that axes with the same error are equal and the first of them counts
    e = F.transform(checks.tracking_error(F.col("action"), F.col("state")), lambda x: F.round(F.abs(x), 12))
    plan = F.struct((F.col("vec_id") % 3 == 0).alias("a"), F.when(F.col("label") % 2 == 0, F.floor(F.col("vec_id") / 4)).alias("b"))
    rows = _frames(spark, sf_dir).withColumn("e", e).withColumn("plan", plan)
    before = F.lag("plan").over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.select("vec_id", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("axis"), F.round(F.array_max("e"), 4).alias("error"), correlate.same_plan(F.col("plan"), before).alias("same"))


def merged_traces(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("t"), "value")
    merged = trace.merged_series(e.filter("event_id % 3 = 0").select("t", "event_id"), e.filter("event_id % 3 <> 0"))
    before = F.lag("series").over(Window.partitionBy(F.floor(F.col("event_id") / 500)).orderBy("t", "series", "event_id"))
    return merged.select("event_id", "series", F.round("value", 2).alias("value"), before.alias("before"))


def run_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = checks.run_id(F.col("ts"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 8))
    said = text.acknowledgement(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "zh").otherwise("en"), {("click", "zh"): "好的", ("click", "en"): "OK", ("view", "en"): "Looking"})
    return e.select("event_id", name.alias("run"), said.alias("said"))


def grouped_frames(spark, sf_dir):
    """Frames in five parts as wire vectors; one part of some has another width."""
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    source = F.struct(F.slice(v, 1, 14).alias("arm"), F.slice(v, 15, 2).alias("effector"), F.slice(v, 17, F.when(F.col("vec_id") % 9 == 0, 2).otherwise(3)).alias("waist"), F.slice(v, 20, 2).alias("head"), F.when(F.col("vec_id") % 13 > 0, F.slice(v, 22, 2)).alias("base"))
    rows = episodes.frames_from_groups(table(spark, sf_dir, "embeddings").select("vec_id", source.alias("state")), "state")
    return rows.select("vec_id", F.get("vector", F.lit(7)).alias("grip"), F.get("vector", F.lit(8)).alias("first_right"), F.get("vector", F.lit(22)).alias("turn"), F.size("vector").alias("n"))


def aligned_episodes(spark, sf_dir):
    """Episodes of frames that are named by numbers: the first fault of each, and the first axis out of its limits."""
    rows = _frames(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    name = F.when((F.col("label") == 1) & (F.col("place") == 3), "03").when((F.col("label") == 2) & (F.col("place") >= 5), (F.col("place") + 1).cast("string")).when((F.col("label") == 3) & (F.col("place") == 4), "3").otherwise(F.col("place").cast("string"))
    vector = F.when((F.col("label") == 4) & (F.col("place") == 1), F.slice("action", 1, 22)).when((F.col("label") == 5) & (F.col("place") == 2), F.transform("action", lambda x, i: F.when(i == 4, float("nan")).otherwise(x))).otherwise(F.col("action"))
    rows = rows.withColumn("name", name).withColumn("vector", vector)
    found = episodes.check_aligned(rows, ["label"], "name", "vector")
    off = episodes.range_errors(rows, ["label"], "action", "full")
    return found.join(off, "label", "left").select("label", "frames", "error", F.col("axis_name").alias("axis"))


def byte_frames(spark, sf_dir):
    """Whole texts as bytes in frames of 1000: how many, the size of the last, and a digest of all of them in order."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    frames = audio.frames_of(raw, 1000)
    rows = table(spark, sf_dir, "documents").select("doc_id", frames.alias("f"))
    whole = F.md5(F.array_join(F.transform("f", lambda x: F.hex(x)), ""))
    return rows.select("doc_id", F.size("f").alias("n"), F.coalesce(F.octet_length(F.try_element_at("f", F.lit(-1))), F.lit(0)).alias("last"), whole.alias("digest"))


QUERIES = {f.__name__: f for f in (run_summaries, speech_times, alias_lookup, axis_cells, wide_rows, followed_targets, merged_traces, run_names, grouped_frames, aligned_episodes, byte_frames)}

_of = lambda *values: "[" + ", ".join(f"'{v}'" for v in values) + f"][event_id % {len(values)} + 1]"
ORACLES = {
    "run_summaries": f"""WITH g AS (SELECT user_id, {_of(*KINDS)} AS k, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS g FROM events)
SELECT user_id AS run_id, count(*) AS events, greatest(0, coalesce(max(g) FILTER (k = 'state'), 0)) AS max_refresh_gap_ms FROM g GROUP BY 1""",
    "speech_times": f"""WITH e AS (SELECT user_id, event_id // 2000 AS part, {_of('start', 'partial', 'audio', 'final', 'audio')} AS k, epoch_us(ts) / 1e6 AS t, event_id % 9600 AS size FROM events),
s AS (SELECT user_id, part, min(t) FILTER (k = 'start') AS s, min(t) FILTER (k = 'partial') AS p, min(t) FILTER (k = 'final') AS f, coalesce(sum(size) FILTER (k = 'audio'), 0) AS a FROM e GROUP BY 1, 2)
SELECT user_id, part, round((p - s) * 1000, 2) AS first_partial_ms, round((f - s) * 1000, 2) AS final_ms, round(a / 48000 * 1000, 2) AS audio_ms FROM s""",
    "alias_lookup": "SELECT event_id, ['cam_high', 'cam_left', 'cam_high', NULL, 'cam_side'][event_id % 5 + 1] AS resolved, ['present', 'absent', 'present', 'unknown', 'present'][event_id % 5 + 1] AS status FROM events",
    "axis_cells": f"""WITH {FRAMES}, c AS (SELECT label, unnest(range(1, 24)) AS i, action, state FROM f)
SELECT label, (i - 1)::INT AS axis, count(*) AS actions, count(*) FILTER (i <= label + 12) AS states, round(sum(action[i]), 4) AS sent, round(coalesce(sum(state[i]) FILTER (i <= label + 12), 0), 4) AS held FROM c GROUP BY 1, 2""",
    "wide_rows": "SELECT user_id, event_id // 1000 AS part, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1, 2",
    "followed_targets": f"""WITH {FRAMES}, i AS (SELECT vec_id, label, unnest(range(1, 24)) AS k, action, state FROM f), m AS (SELECT vec_id, label, arg_max(k, (round(abs(action[k] - state[k]), 12), -k)) AS k, max(abs(action[k] - state[k])) AS e FROM i GROUP BY 1, 2),
p AS (SELECT *, vec_id % 3 = 0 AS a, CASE WHEN label % 2 = 0 THEN vec_id // 4 END AS b FROM m), w AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, (k - 1)::INT AS axis, round(e, 4) AS error, r > 1 AND a = a0 AND b IS NOT DISTINCT FROM b0 AS same FROM w""",
    "merged_traces": """WITH m AS (SELECT event_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN 'held' ELSE 'sent' END AS series, CASE WHEN event_id % 3 <> 0 THEN round(value, 2) END AS value FROM events)
SELECT event_id, series, value, lag(series) OVER (PARTITION BY event_id // 500 ORDER BY t, series, event_id) AS before FROM m""",
    "run_names": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || md5(event_id::VARCHAR)[1:8] AS run, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN '好的' WHEN event_type = 'click' THEN 'OK' WHEN event_type = 'view' AND event_id % 2 = 1 THEN 'Looking' END AS said FROM events""",
    "grouped_frames": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS v, vec_id % 9 <> 0 AND vec_id % 13 <> 0 AS ok FROM embeddings)
SELECT vec_id, CASE WHEN ok THEN v[15] END AS grip, CASE WHEN ok THEN v[8] END AS first_right, CASE WHEN ok THEN v[23] END AS turn, CASE WHEN ok THEN 23 END AS n FROM v""",
    "aligned_episodes": f"""WITH {FRAMES}, d(axis, name, low, high) AS (VALUES {LIMIT_ROWS}), i AS (SELECT label, unnest(range(23)) AS axis, unnest(action) AS x FROM f), r AS (SELECT label, axis, min(x) AS a, max(x) AS b FROM i GROUP BY 1, 2),
o AS (SELECT label, arg_min(name, axis) AS name FROM r JOIN d USING (axis) WHERE a < low OR b > high OR axis >= 21 AND greatest(abs(a), abs(b)) > 1e-9 GROUP BY 1), n AS (SELECT label, count(*) AS frames FROM f GROUP BY 1)
SELECT label, frames, CASE label WHEN 1 THEN 'frame name' WHEN 2 THEN 'frame gap' WHEN 3 THEN 'frame gap' WHEN 4 THEN 'width' WHEN 5 THEN 'not finite' END AS error, name AS axis FROM n LEFT JOIN o USING (label)""",
    "byte_frames": "WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents) SELECT doc_id, (octet_length(b) + 999) // 1000 AS n, CASE WHEN octet_length(b) > 0 THEN (octet_length(b) - 1) % 1000 + 1 ELSE 0 END AS last, md5(hex(b)) AS digest FROM t",
}
