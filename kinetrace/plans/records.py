"""Queries over ``events``, ``embeddings`` and ``conversations`` that gate, clean and resample records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinetrace.functions import paths, vectors
from kinetrace.functions.clock import micros
from kinetrace.functions.nested import finite_tree
from kinetrace.operators import cameras, correlate, health, policy, rewrite
from kinetrace.plans import dims
from kinetrace.plans.frames import FRAMES, _frames
from kinetrace.sources import audio
from kinetrace.session import table

NESTED = "struct<id:bigint,axes:array<struct<x:double,tag:string>>,groups:map<string,array<double>>,inner:struct<peak:double,n:int>>"


def finite_trees(spark, sf_dir):
    """Numbers that are not finite become null within arrays of structs, maps of arrays and structs; here they are planted by remainders."""
    e = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 13 == 0, float("nan")).when((F.col("vec_id") + i) % 17 == 0, float("-inf")).otherwise(x.cast("double")))
    tree = F.struct(
        F.col("vec_id").alias("id"),
        F.transform(e, lambda x: F.struct(x.alias("x"), F.lit("a").alias("tag"))).alias("axes"),
        F.create_map(F.lit("low"), F.slice(e, 1, 10), F.lit("high"), F.slice(e, 11, 54)).alias("groups"),
        F.struct(F.when(F.col("vec_id") % 5 == 0, float("inf")).otherwise(F.col("vec_id") * 0.5).alias("peak"), F.lit(1).alias("n")).alias("inner"),
    )
    clean = table(spark, sf_dir, "embeddings").select(finite_tree(tree.cast(NESTED), T.StructType.fromDDL(NESTED[7:-1])).alias("r"))
    count = lambda v: F.size(F.filter(v, lambda x: x.isNotNull()))
    total = F.aggregate(F.transform("r.axes", lambda x: F.coalesce(x["x"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return clean.select(F.col("r.id").alias("vec_id"), count(F.transform("r.axes", lambda x: x["x"])).alias("axes"), count(F.col("r.groups")["low"]).alias("low"), count(F.col("r.groups")["high"]).alias("high"), F.round(total, 6).alias("total"), F.col("r.inner.peak").alias("peak"))


# Paths that the events ask for in turn, and where they lead below /data/set, of which link is a link to /data/other and near one to a/b.
ASKED = ("a/b.h5", "./a//./b.H5", "a/../b.hdf5", "../x.h5", "../set/b.h5", "/data/set/b.h5", "  ", "a/../../set/c.h5", "link/b.h5", "near/b.h5", "near/../b.h5", "a/b.txt", "..", "a/link/../b.h5")
LEADS = ("a/b.h5", "a/b.H5", "b.hdf5", None, "b.h5", None, None, "c.h5", None, "a/b/b.h5", "a/b.h5", "a/b.txt", None, "a/b.h5")


def contained_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = F.get(F.lit(list(ASKED)), (F.col("event_id") % len(ASKED)).cast("int"))
    links = F.create_map(F.lit("/data/set/link"), F.lit("/data/other"), F.lit("/data/set/near"), F.lit("/data/set/a/b"))
    source = F.when(F.col("event_id") % 5 == 0, "ACTION").when(F.col("event_id") % 5 == 1, "sensor").otherwise("state")
    fault = paths.choice_fault(F.lit("/data/set"), asked, source, F.when(F.col("user_id") % 7 == 0, "legs").otherwise(" Arms"), F.col("value") / 50, F.when(F.col("event_id") % 3 == 0, "absolute"), links)
    return e.select("event_id", paths.contained(F.lit("/data/set"), asked, links).alias("path"), fault.alias("fault"))


def policy_targets(spark, sf_dir):
    """Frames as targets of a mode: some too short, some not finite, some out of limits on an axis that the mode drives or holds."""
    pick = F.col("vec_id") % 11
    mode = F.get(F.lit(["arms", "arms_lift", "full", "legs"]), (F.col("vec_id") % 4).cast("int"))
    moved = F.transform("action", lambda x, i: F.when((pick == 1) & (i == 3), F.lit(2.0)).when((pick == 2) & (i == 16), F.lit(-0.5)).when((pick == 3) & (i == 20), F.lit(0.9)).when((i == 16) | (i == 17) | (i == 7) | (i == 15), F.abs(x)).when(((pick != 4) & (i >= 21)), F.lit(0.0)).otherwise(x))
    action = F.when(pick == 5, F.slice(moved, 1, 22)).when(pick == 6, F.transform(moved, lambda x, i: F.when(i == 22, float("nan")).otherwise(x))).otherwise(moved)
    rows = _frames(spark, sf_dir).select("vec_id", mode.alias("mode"), action.alias("action"), "state")
    return policy.policy_targets(rows, "mode").select("vec_id", "mode", "error")


def gripper_gates(spark, sf_dir):
    start, way = F.abs(F.get("action", F.lit(7))), F.get("state", F.lit(7)) * 2
    fault = policy.gripper_fault(start, F.when(F.col("vec_id") % 3 == 0, F.abs(way)), way, 0.25, F.when(F.col("vec_id") % 10 > 0, F.col("label") % 8 * 0))
    return _frames(spark, sf_dir).select("vec_id", fault.alias("fault"))


def ring_rate(spark, sf_dir):
    """Arrivals of each kind among the last 180 that are at most a day old."""
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") % 2).alias("camera"), micros("ts").alias("us"))
    out = health.trailing_rate(rows, ["camera"], "us", 86_400_000_000, 180, ["event_id"])
    return out.select("event_id", F.round(F.col("rate") * 1e9, 6).alias("per_1000_s"))


def resampled_signal(spark, sf_dir):
    """The values of each user as a signal in blocks of uneven length, at 16 of 44.1 samples."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") - 20) / 30).cast("float").alias("x"))
    blocks = e.groupBy("user_id", F.floor(F.sqrt("event_id")).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "x"))), lambda s: s["x"]).alias("samples"))
    parts = audio.resample_blocks(blocks, ["user_id"], ["block"], "samples", 44_100, 16_000)
    heard = parts.select("user_id", "start", F.posexplode(audio.pcm_numbers("pcm")).alias("k", "value"))
    return heard.select("user_id", (F.col("start") + F.col("k")).alias("place"), F.col("value").cast("int").alias("value"))


def table_corrections(spark, sf_dir):
    """The 40 most frequent words of all conversations, each turned around, one after another."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0)).alias("source")).groupBy("source").count()
    first = words.orderBy(F.desc("count"), "source").limit(40)
    pairs = first.select(F.row_number().over(Window.orderBy(F.desc("count"), "source")).alias("place"), "source", F.reverse("source").alias("replacement"))
    return rewrite.correct_from(rows, "text", pairs).select("conv_id", "turn", F.md5("text").alias("digest"))


def camera_catalogue(spark, sf_dir):
    """Cameras named after users and kinds of events: what each offers, and by which names it goes."""
    e = table(spark, sf_dir, "events")
    name = F.get(F.lit(["robot/cam_high", " cam_left_wrist ", "", "side/cam_side", "cam_high"]), (F.col("user_id") % 5).cast("int"))
    kinds = F.lit(["color", " Depth", "infra", "RGB", "depth"])
    streams = F.transform(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int")), lambda k: F.struct(F.get(kinds, (F.col("user_id") + k).cast("int") % 5).alias("type"), k.alias("width")))
    configs = e.select("user_id").distinct().select(F.concat(F.when(F.trim(name) != "", F.concat(F.lit("u"), "user_id", F.lit("/"))).otherwise(""), F.trim(name)).alias("camera"), streams.alias("streams"))
    return cameras.discover(configs).select("camera", "logical", "kind", F.col("stream.width").cast("int").alias("width"))


def task_plans(spark, sf_dir):
    task = F.get(F.lit(["single", "dual_separate", "dual"]), (F.col("event_id") % 3).cast("int"))
    pick = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("event_id") % n).cast("int"))
    plan = policy.task_plan(task, pick(4, "cup", "", "can", None), pick(5, "right", "left", None, "right", "up"), pick(7, "box", "", "pen", "cap", None, "jar", "box"), pick(2, "lid", ""), pick(11, None, " wave ", "", None, "  ", None, "", None, None, "", None))
    form = pick(13, "legacy", "a90", "plain", "a90", "legacy", "a90", "a90", "plain", "legacy", "a90", "a90", "a90", "legacy")
    rows = table(spark, sf_dir, "events").select("event_id", plan.alias("p"), form.alias("form"))
    fault = policy.request_format_fault(F.col("form"), F.col("p.mode"), F.col("p.hand"), F.when(F.col("event_id") % 6 == 0, "open"))
    return rows.select("event_id", F.col("p.mode").alias("mode"), F.col("p.hand").alias("hand"), F.col("p.prompt").alias("prompt"), F.col("p.right_prompt").alias("right_prompt"), fault.alias("fault"))


def audio_attachments(spark, sf_dir):
    """Sound that comes for a conversation goes to its newest reply that has none yet."""
    rows = table(spark, sf_dir, "conversations")
    sounds = rows.filter("conv_id % 5 <> 0").select("conv_id").distinct()
    return correlate.attach_to_newest(rows, sounds, ["conv_id"], "turn", (F.col("role") == "assistant") & (F.col("turn") % 4 != 3)).select("conv_id", "turn")


def chunk_parts(spark, sf_dir):
    """Chunks of an episode's frames: the steps that are taken first, and what is left behind a cursor."""
    frames = _frames(spark, sf_dir).withColumn("chunk", F.floor(F.col("vec_id") / 50))
    chunks = frames.groupBy("label", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "action"))), lambda x: x["action"]).alias("actions"))
    first, rest = vectors.prefix(F.col("actions"), (F.col("label") % 4 + 1).cast("int")), vectors.suffix(F.col("actions"), (F.col("chunk") % 7).cast("int"))
    end = lambda a, k: F.get(F.try_element_at(a, F.lit(k)), F.lit(2))
    return chunks.select("label", "chunk", F.size(first).alias("taken"), end(first, -1).alias("last_taken"), F.size(rest).alias("left_over"), end(rest, 1).alias("first_left"))


QUERIES = {f.__name__: f for f in (audio_attachments, chunk_parts, finite_trees, contained_paths, policy_targets, gripper_gates, ring_rate, resampled_signal, table_corrections, camera_catalogue, task_plans)}

_texts = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
ORACLES = {
    "audio_attachments": "SELECT conv_id, max(turn) FILTER (role = 'assistant' AND turn % 4 <> 3) AS turn FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1",
    "chunk_parts": f"""WITH {FRAMES}, c AS (SELECT label, vec_id // 50 AS chunk, list(action[3] ORDER BY vec_id) AS a FROM f GROUP BY ALL)
SELECT label, chunk, least(len(a), label % 4 + 1) AS taken, a[least(len(a), label % 4 + 1)] AS last_taken, greatest(0, len(a) - chunk % 7) AS left_over, CASE WHEN len(a) > chunk % 7 THEN a[chunk % 7 + 1] END AS first_left FROM c""",
    "finite_trees": """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), f AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 13 <> 0 AND (vec_id + i) % 17 <> 0 THEN x END AS x FROM x)
SELECT vec_id, count(x) AS axes, count(x) FILTER (i < 10) AS low, count(x) FILTER (i >= 10) AS high, round(sum(x), 6) AS total, CASE WHEN vec_id % 5 <> 0 THEN vec_id * 0.5::DOUBLE END AS peak FROM f GROUP BY vec_id""",
    "contained_paths": f"""WITH p AS (SELECT *, ({_texts(ASKED)})[event_id % {len(ASKED)} + 1] AS asked, ({_texts(LEADS)})[event_id % {len(ASKED)} + 1] AS path FROM events)
SELECT event_id, path, CASE WHEN trim(asked) = '' THEN 'no path' WHEN asked LIKE '/%' THEN 'absolute path' WHEN path IS NULL THEN 'outside the folder' WHEN path LIKE '%.txt' THEN 'no episode file' WHEN event_id % 5 = 1 THEN 'source'
  WHEN user_id % 7 = 0 THEN 'mode' WHEN NOT value / 50 BETWEEN 0.5 AND 2 THEN 'speed' WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN 'actions are not absolute' END AS fault FROM p""",
    "policy_targets": f"""WITH {FRAMES}, m AS (SELECT *, ['arms', 'arms_lift', 'full', 'legs'][vec_id % 4 + 1] AS mode, [16, 17, 21][vec_id % 4 + 1] AS n, vec_id % 11 AS p FROM f),
i AS (SELECT vec_id, mode, n, p, unnest(range(1, 24)) AS k, unnest(action) AS a FROM m),
a AS (SELECT *, CASE WHEN p = 1 AND k = 4 THEN 2.0 WHEN p = 2 AND k = 17 THEN -0.5 WHEN p = 3 AND k = 21 THEN 0.9 WHEN k IN (17, 18, 8, 16) THEN abs(a) WHEN p <> 4 AND k >= 22 THEN 0 ELSE a END AS x FROM i),
o AS (SELECT vec_id, mode, p, min(k) FILTER (k <= n AND k <= 21 AND (x < ({dims.LOWS}::DOUBLE[])[k] OR x > ({dims.HIGHS}::DOUBLE[])[k])) AS bad, bool_or(k >= 22 AND x <> 0) AS moves FROM a GROUP BY ALL)
SELECT vec_id, mode, CASE WHEN mode = 'legs' THEN 'mode' WHEN p = 5 THEN 'width' WHEN p = 6 THEN 'not finite' WHEN bad IS NOT NULL THEN ({_texts(dims.AXIS_NAMES)})[bad] WHEN mode <> 'full' AND moves THEN 'base' END AS error FROM o""",
    "gripper_gates": f"""WITH {FRAMES}, g AS (SELECT vec_id, abs(action[8]) AS s, state[8] * 2 AS w FROM f), t AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN abs(w) ELSE s + w END AS t FROM g)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'fault flag' WHEN NOT t BETWEEN 0 AND 1.5 THEN 'target' WHEN abs(t - s) > 0.25 THEN 'way' END AS fault FROM t""",
    "ring_rate": """WITH e AS (SELECT event_id, floor(value % 2)::BIGINT AS c, epoch_us(ts) AS us FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY us, event_id) AS r FROM e),
w AS (SELECT a.event_id, count(*) AS n, min(b.us) AS first, any_value(a.us) AS last FROM n a JOIN n b ON b.c = a.c AND b.r <= a.r AND b.r > a.r - 180 AND b.us >= a.us - 86400000000 GROUP BY a.event_id)
SELECT event_id, round(CASE WHEN n < 2 OR last <= first THEN 0 ELSE (n - 1) / (last - first) END * 1e9, 6) AS per_1000_s FROM w""",
    "resampled_signal": """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, ((value - 20) / 30)::FLOAT::DOUBLE AS x FROM events), p AS (SELECT user_id, i, x, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS y FROM s),
n AS (SELECT user_id, max(i) AS last FROM s GROUP BY 1), k AS (SELECT user_id, unnest(range(0, (last * 16000 + 44099) // 44100)) AS k FROM n WHERE last > 0), v AS (SELECT k.user_id, k, greatest(-1, least(1, x * (1 - (k * 44100 % 16000) / 16000) + y * ((k * 44100 % 16000) / 16000))) AS v FROM k JOIN p ON p.user_id = k.user_id AND p.i = k * 44100 // 16000)
SELECT user_id, k AS place, trunc(v * CASE WHEN v < 0 THEN 32768 ELSE 32767 END)::INT AS value FROM v""",
    "table_corrections": r"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), c AS (SELECT unnest(regexp_extract_all(x, '[a-z]{4,}')) AS w FROM t), n AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM c GROUP BY w QUALIFY r <= 40),
d AS (SELECT conv_id, turn, x, 0 AS r FROM t UNION ALL SELECT conv_id, turn, replace(x, w, reverse(w)), n.r FROM d JOIN n ON n.r = d.r + 1)
SELECT conv_id, turn, md5(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS digest FROM d WHERE r = (SELECT max(r) FROM n)""",
    "camera_catalogue": """WITH u AS (SELECT DISTINCT user_id AS u FROM events), n AS (SELECT u, ['robot/cam_high', 'cam_left_wrist', '', 'side/cam_side', 'cam_high'][u % 5 + 1] AS name, unnest(range(0, u % 3 + 1)) AS k FROM u),
s AS (SELECT 'u' || u || '/' || name AS camera, CASE u % 5 WHEN 0 THEN 'head' WHEN 1 THEN 'left_wrist' WHEN 4 THEN 'head' END AS logical, k, ['rgb', 'depth', 'infra', 'rgb', 'depth'][(u + k) % 5 + 1] AS kind FROM n WHERE name <> '')
SELECT camera, logical, kind, max(k)::INT AS width FROM s WHERE kind <> 'infra' GROUP BY ALL""",
    "task_plans": """WITH e AS (SELECT event_id AS i, ['single', 'dual_separate', 'dual_continuous'][event_id % 3 + 1] AS mode, coalesce(['cup', '', 'can', NULL][event_id % 4 + 1], '') AS item, CASE WHEN event_id % 5 IN (0, 3) THEN 'right' ELSE 'left' END AS h,
  coalesce(['box', '', 'pen', 'cap', NULL, 'jar', 'box'][event_id % 7 + 1], '') AS l, ['lid', ''][event_id % 2 + 1] AS r, CASE WHEN event_id % 11 = 1 THEN 'wave' ELSE '' END AS own,
  ['legacy', 'a90', 'plain', 'a90', 'legacy', 'a90', 'a90', 'plain', 'legacy', 'a90', 'a90', 'a90', 'legacy'][event_id % 13 + 1] AS form FROM events)
SELECT i AS event_id, mode, CASE WHEN mode = 'single' THEN h END AS hand,
  CASE WHEN mode = 'dual_separate' THEN CASE WHEN l <> '' THEN 'Grasp ' || l || ' with the left hand' ELSE '' END WHEN own <> '' THEN own WHEN mode = 'single' THEN CASE WHEN item <> '' THEN 'Grasp ' || item || ' with the ' || h || ' hand' ELSE '' END
    WHEN l <> '' AND r <> '' THEN 'Grasp ' || l || ' with the left hand and then grasp ' || r || ' with the right hand.' ELSE '' END AS prompt,
  CASE WHEN mode = 'dual_separate' THEN CASE WHEN r <> '' THEN 'Grasp ' || r || ' with the right hand' ELSE '' END END AS right_prompt,
  CASE WHEN form = 'legacy' AND i % 6 = 0 THEN 'entry action' WHEN form = 'a90' AND (mode = 'dual_separate' OR mode = 'single' AND h = 'right') THEN 'task' END AS fault FROM e""",
}
