"""Queries that hold JSON built from ``events`` against the wire's contract; a remainder of ``event_id`` decides which rule a payload breaks.

The texts that build the payloads are the same in Spark and DuckDB; the rules are not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrace.functions import typed_json as j
from kinetrace.functions import wire
from kinetrace.session import table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(of: str, texts: dict, other: str) -> str:
    return f"CASE {of} {' '.join(f'WHEN {k} THEN {v}' for k, v in texts.items())} ELSE {other} END"


def action_text(m: str) -> str:
    """The SQL of a structured action that breaks the rule with number ``m``."""
    v = "(value || '')"
    side = lambda first, last: f"'\"joint1\": ' || {first} || ', \"joint2\": -' || {v} || ', \"joint3\": ' || event_id || ', \"joint4\": 0, \"joint5\": 1e2, \"joint6\": -0.5, \"gripper\": 1.5' || {last}"
    left = side(_case(m, {3: "'\"0.0\"'", 7: "'1e39'", 4: "'null'"}, v), _case(m, {0: "''", 11: "', \"joint8\": 2'"}, "', \"joint7\": 0.25'"))
    right = side(_case(m, {5: "'true'", 6: "'[1]'"}, v), "', \"joint7\": 0.75'")
    lift = _case(m, {1: "'2'", 2: "'null'"}, "'{\"height\": 0.3}'")
    waist = _case(m, {9: "'{\"pitch\": 0.1, \"roll\": 0}'"}, "'{\"yaw\": 0.2, \"pitch\": 0.1}'")
    head = _case(m, {10: "'{\"yaw\": \"x\", \"pitch\": false}'", 14: "'{\"yaw\": NaN, \"pitch\": 1}'"}, "'{\"yaw\": 0.3, \"pitch\": ' || event_id % 7 || '}'")
    speed = f"', \"speed\": {{\"linear\": 0.5, \"angular\": ' || {v} || '}}'"
    whole = f"'{{' || {_case(m, {8: _quoted('\"odd\": {}, ')}, _quoted(''))} || '\"left\": {{' || {left} || '}}, \"right\": {{' || {right} || '}}, \"lift\": ' || {lift} || ', \"waist\": ' || {waist} || ', \"head\": ' || {head} || {_case(m, {15: _quoted('')}, speed)} || '}}'"
    return f"({_case(m, {12: _quoted('[]'), 13: _quoted('{\"left\"')}, whole)})"


ACTION, CHUNK_ACTION = action_text("(event_id % 19)"), action_text("(CASE WHEN event_id % 397 = 5 THEN event_id % 19 ELSE 99 END)")
CHUNK = "(event_id - event_id % 50)"
REPLY_HEAD = "'{\"type\": ' || CASE WHEN chunk % 11 = 3 THEN '\"error\"' WHEN chunk % 17 = 3 THEN '\"other\"' ELSE '\"action_chunk\"' END || CASE chunk % 7 WHEN 1 THEN ', \"is_success\": true' WHEN 2 THEN ', \"is_success\": 1' ELSE '' END || ', \"actions\": '"


def structured_actions(spark, sf_dir):
    """The first broken rule of each action, or its vector."""
    found = wire.flatten(j.parsed(F.expr(ACTION)))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("found"))
    total = F.aggregate(F.transform("found.vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("event_id", F.col("found.error").alias("error"), F.size("found.vector").alias("n"), F.round(total, 2).alias("total"))


def action_chunks(spark, sf_dir):
    """Replies of 50 actions each: the first broken rule, or the sum of one axis over the chunk."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(CHUNK).alias("first"), F.expr(CHUNK_ACTION).alias("action"))
    chunks = rows.filter(~((F.col("first") % 650 == 200) & (F.col("event_id") % 50 == 49))).groupBy("first").agg(F.sort_array(F.collect_list(F.struct("event_id", "action"))).alias("held"))
    text = F.concat(F.lit("["), F.array_join(F.transform("held", lambda x: x["action"]), ", "), F.lit("]"))
    reply = F.concat(F.expr(REPLY_HEAD), F.when(F.col("chunk") % 29 == 5, F.lit("{}")).otherwise(text), F.lit("}"))
    found = chunks.withColumn("chunk", F.expr("first div 50")).select("chunk", wire.action_chunk(j.parsed(reply)).alias("found"))
    total = F.aggregate(F.transform("found.actions", lambda a: F.get(a, F.lit(10)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return found.select("chunk", F.col("found.error").alias("error"), F.size("found.actions").alias("n"), F.round(total, 2).alias("total"))


_names = "[" + ", ".join(f'"{n}"' for n in wire.ORDER) + "]"
_aliased = _names
for _old, _new in wire.ALIASES.items():
    _aliased = _aliased.replace(f'"{_new}"', f'"{_old}"')
_m = "(event_id % 37)"
METADATA = (
    "('{\"rtc_supported\": ' || " + _case(_m, {0: "'false'", 1: "'1'", 2: "'\"true\"'"}, "'true'")
    + " || ', \"rtc_protocol_version\": ' || " + _case(_m, {3: "'1.0'", 4: "'true'", 5: "'2'"}, "'1'")
    + " || ', \"action_horizon\": 50, \"wire_state_dim\": ' || " + _case(_m, {6: "'\"23\"'"}, "'23'")
    + " || ', \"wire_action_dim\": ' || " + _case(_m, {7: "'18'"}, "'23'")
    + " || ', \"model_action_dim\": 32, \"rtc_history_trained_dim\": ' || " + _case(_m, {8: "'15'", 9: "'16'", 10: "'17.0'"}, "'17'")
    + " || ', \"rtc_padding_start\": ' || " + _case(_m, {9: "'16'", 11: "'16'", 12: "'17.0'", 13: "'null'"}, "'17'")
    + " || " + _case(_m, {14: "', \"policy_dim\": 16'", 15: "', \"policy_dim\": 17'", 16: "', \"model_policy_dim\": \"17\"'"}, "''")
    + " || ', \"input_gripper_binary\": ' || " + _case(_m, {17: "'1'"}, "'true'")
    + " || " + _case(_m, {18: "''"}, "', \"output_gripper_binary\": false'")
    + " || ', \"rtc_action_space_id\": ' || " + _case(_m, {19: "'\"\"'", 20: "'3'"}, "'\"space-' || user_id || '\"'")
    + " || ', \"state_order\": ' || " + _case(_m, {21: "'[]'", 22: _quoted(_aliased)}, _quoted(_names))
    + " || ', \"action_order\": ' || " + _case(_m, {23: "'null'", 24: _quoted(_names.replace('"left.joint1"', '"left.joint2"')), 25: _quoted(_aliased)}, _quoted(_names)) + " || '}')"
)


def schedule_metadata(spark, sf_dir):
    found = wire.schedule_metadata(j.parsed(F.expr(METADATA)))
    return table(spark, sf_dir, "events").select("event_id", found.alias("found")).select("event_id", "found.error", "found.trained_width", "found.padding_start", "found.action_space")


_S = "CAST(CASE WHEN event_id % 3 = 0 AND event_id % 5 < 4 THEN 0 ELSE event_id % 53 - 1 END AS INT)"
_D = "CAST(CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN -1 END AS INT)"
_OPTIONS = "CASE event_id % 11 WHEN 0 THEN '{\"trigger_index\": 20, \"max_guidance_weight\": 2.5}' WHEN 1 THEN 'null' ELSE '{\"safety_reserve_steps\": 4}' END"
_SESSION = "CASE WHEN event_id % 41 = 0 THEN '' ELSE 's' || user_id END"


def _requests(spark, sf_dir):
    """Events as requests: bootstraps, and guided ones with what is left of a chunk, some of a wrong shape or with padding that is not zero."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.expr(_S).alias("s"), F.expr(_D).alias("d"), F.expr(_SESSION).alias("session"), F.expr(_OPTIONS).alias("options"))
    left = F.lit(50) - F.col("s") + F.when(F.col("event_id") % 31 == 0, 1).otherwise(0)
    form = F.when(F.col("event_id") % 43 == 1, "both").when(F.col("event_id") % 3 == 1, "actions").when(F.col("event_id") % 3 == 2, "model")
    row = lambda w, at: F.transform(F.sequence(F.lit(1), F.lit(w)), lambda i: F.when(i == at, F.col("value")).otherwise(F.lit(0.0)))
    odd = F.when(F.col("event_id") % 47 == 2, 20).otherwise(1)
    held = e.withColumn("actions", F.when(form.isin("actions", "both"), F.array_repeat(row(wire.WIDTH, F.lit(1)), left))).withColumn("model", F.when(form.isin("model", "both"), F.array_repeat(row(wire.MODEL_WIDTH, odd), left)))
    found = wire.request(F.col("session"), F.col("event_id"), F.col("user_id") % 3, F.lit(0).cast("long"), F.col("s"), F.col("d"), wire.settings(j.parsed(F.col("options"))), F.col("actions"), F.col("model"))
    return held.withColumn("found", found)


def request_envelopes(spark, sf_dir):
    """The first broken rule of each request, or fields of the envelope that goes with it."""
    field = lambda path, kind="long": F.get_json_object("found.envelope", f"$.{path}").cast(kind)
    history = lambda name: F.size(F.from_json(F.get_json_object("found.envelope", f"$.rtc.{name}"), "array<array<double>>"))
    return _requests(spark, sf_dir).select(
        "event_id", F.col("found.error").alias("error"), field("session_id", "string").alias("session_id"), field("request_id").alias("request_id"), field("rtc.episode_epoch").alias("episode_epoch"),
        field("rtc.executed_steps").alias("executed_steps"), field("rtc.estimated_delay_steps").alias("delay"), field("rtc.execution_horizon").alias("horizon"), field("rtc.safety_reserve_steps").alias("reserve"),
        field("rtc.max_guidance_weight", "double").alias("weight"), history("previous_actions").alias("actions"), history("previous_chunk_model").alias("model"),
    )


_r = "(event_id % 29)"
_row = lambda first, behind: f"'[' || {first} || repeat(', 0', 16) || ', ' || {behind} || repeat(', 0.0', 14) || ']'"
REPLY = (
    "('{\"type\": ' || " + _case(_r, {0: "'\"error\"'", 1: "'null'"}, "'\"action_chunk\"'")
    + " || ', \"session_id\": ' || " + _case(_r, {2: "'7'", 3: "'\"old\"'"}, "'\"s' || user_id || '\"'")
    + " || ', \"request_id\": ' || event_id || " + _case(_r, {4: "'.0'", 5: "'1'"}, "''")
    + " || ', \"episode_epoch\": ' || " + _case(_r, {6: "'true'", 7: "'9'"}, "(user_id % 3 || '')")
    + " || " + _case(_r, {8: "''"}, "', \"phase_epoch\": 0'")
    + " || ', \"rtc\": ' || " + _case(_r, {9: "'[]'"}, "'{\"action_time_origin\": ' || " + _case(_r, {10: "'\"arrival\"'"}, "'\"request_observation\"'")
    + " || ', \"client_must_discard_elapsed_prefix\": ' || " + _case(_r, {11: "'1'"}, "'true'") + " || " + _case(_r, {12: "''", 13: "', \"guided\": 0'"}, "', \"guided\": ' || CASE WHEN event_id % 23 = 5 THEN 'false' ELSE 'true' END")
    + " || " + _case(_r, {14: "', \"rtc_action_space_id\": \"other\"'", 15: "', \"rtc_action_space_id\": \"space\"'"}, "''") + " || '}'")
    + " || ', \"actions_model\": [' || repeat(" + _row("value", "0") + " || ', ', " + _case(_r, {16: "48", 17: "50"}, "49") + ") || " + _row(_case(_r, {18: "'null'", 19: "'\"x\"'", 20: "'true'", 21: "'[1]'"}, "(value || '')"), _case(_r, {22: "'0.5'"}, "'0'")) + " || ']}')"
)
SERVER = '{"rtc_padding_start": 17, "rtc_action_space_id": "space"}'


def reply_contract(spark, sf_dir):
    """Replies of a server held against the guided requests that they answer: the first broken rule, or the sum of the chunk's first axis."""
    e = table(spark, sf_dir, "events")
    asked = F.concat(F.lit('{"session_id": "s'), "user_id", F.lit('", "request_id": '), "event_id", F.lit(', "rtc": {"episode_epoch": '), F.col("user_id") % 3, F.lit(', "phase_epoch": 0, "previous_actions": []}}'))
    requests = e.select("event_id", asked.alias("envelope"), F.lit(SERVER).alias("metadata"))
    replies = e.filter("event_id % 61 <> 7").select("event_id", F.expr(REPLY).alias("reply"))
    found = wire.check_replies(requests, replies, ["event_id"])
    total = F.aggregate(F.transform("model", lambda r: F.get(r, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    return found.select("event_id", "error", F.size("model").alias("n"), F.round(total, 3).alias("total"))


QUERIES = {f.__name__: f for f in (structured_actions, action_chunks, schedule_metadata, request_envelopes, reply_contract)}

_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
NUMBER = "IN ('UBIGINT', 'BIGINT', 'DOUBLE')"


def _object(path: str, said: str) -> str:
    return f"WHEN coalesce(json_type(j, '{path}'), '') <> 'OBJECT' THEN '{said}: no object'"


def _keys(path: str, said: str, expected) -> str:
    held, wanted = f"json_keys(j, '{path}')", _list(sorted(expected))
    less = lambda a, b: f"array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ',')"
    return f"WHEN list_sort({held}) <> {wanted} THEN '{said}: missing ' || {less(wanted, held)} || '; unexpected ' || {less(held, wanted)}"


LEAVES = [(part, leaf) for part, leaves in wire.ACTION.items() for leaf in leaves]
ACTION_ERROR = f"""CASE WHEN j IS NULL THEN 'action: no object' {_object('$', 'action')} {_keys('$', 'action', wire.ACTION)}
{' '.join(_object(f'$.{p}', f'action.{p}') for p in wire.ACTION)}
{' '.join(_keys(f'$.{p}', f'action.{p}', leaves) for p, leaves in wire.ACTION.items())}
{' '.join(f"WHEN coalesce(json_type(j, '$.{p}.{k}'), '') NOT {NUMBER} THEN 'action.{p}.{k}: no finite number'" for p, k in LEAVES)}
WHEN greatest({', '.join(f"abs(try_cast(json_extract_string(j, '$.{p}.{k}') AS DOUBLE))" for p, k in LEAVES)}) > 3.4028235e38 THEN 'action: out of range' END"""
VECTOR = "[" + ", ".join(f"try_cast(json_extract_string(j, '$.{p}.{k}') AS FLOAT)" for p, k in LEAVES) + "]"
VALID = "CASE WHEN json_valid(p) AND NOT contains(p, 'NaN') THEN p::JSON END AS j"
_text = lambda key: f"coalesce(json_type(j, '$.{key}'), '')"
_value = lambda key: f"json_extract_string(j, '$.{key}')"
_exact = lambda key, kinds, value: f"WHEN {_text(key)} NOT IN ({kinds}) OR {_value(key)} <> '{value}' THEN '{key}'"
_ordered = lambda key: f"WHEN {_text(key)} <> 'ARRAY' OR list_transform(from_json(json_extract(j, '$.{key}'), '[\"VARCHAR\"]'), lambda x: {_case('x', {_quoted(a): _quoted(b) for a, b in wire.ALIASES.items()}, 'x')}) <> {_list(wire.ORDER)} THEN '{key}'"
WHOLE = "'UBIGINT', 'BIGINT'"
TRAINED = f"CASE WHEN {_text('rtc_history_trained_dim')} IN ({WHOLE}) THEN {_value('rtc_history_trained_dim')}::INT END"
_equal = lambda key: f"({_text(key)} {NUMBER} AND try_cast({_value(key)} AS DOUBLE) = trained)"
ORACLES = {
    "structured_actions": f"""WITH a AS (SELECT event_id, {ACTION} AS p FROM events), b AS (SELECT event_id, {VALID} FROM a), c AS (SELECT event_id, {ACTION_ERROR} AS error, {VECTOR} AS v FROM b)
SELECT event_id, error, CASE WHEN error IS NULL THEN len(v) END AS n, CASE WHEN error IS NULL THEN round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 2) END AS total FROM c""",
    "action_chunks": f"""WITH a AS (SELECT event_id, event_id // 50 AS chunk, {CHUNK_ACTION} AS p FROM events), b AS (SELECT event_id, chunk, {VALID} FROM a WHERE NOT (chunk * 50 % 650 = 200 AND event_id % 50 = 49)),
c AS (SELECT event_id, chunk, j IS NULL AS broken, {ACTION_ERROR} AS error, ({VECTOR})[11]::DOUBLE AS x FROM b),
d AS (SELECT chunk, count(*) AS k, bool_or(broken) AS broken, arg_min((event_id % 50) || ' ' || error, event_id) FILTER (error IS NOT NULL) AS error, sum(x) AS total FROM c GROUP BY chunk),
e AS (SELECT *, CASE WHEN broken AND chunk % 29 <> 5 THEN 'reply: no object' WHEN chunk % 11 = 3 THEN 'server error' WHEN chunk % 17 = 3 THEN 'type' WHEN chunk % 7 = 2 THEN 'is_success: no boolean' WHEN chunk % 29 = 5 THEN 'actions: no array'
  WHEN k <> 50 THEN 'actions: ' || k ELSE error END AS e FROM d)
SELECT chunk, e AS error, CASE WHEN e IS NULL THEN 50 END AS n, CASE WHEN e IS NULL THEN round(total, 2) END AS total FROM e""",
    "schedule_metadata": f"""WITH a AS (SELECT event_id, {METADATA}::JSON AS j FROM events), b AS (SELECT *, {TRAINED} AS trained FROM a),
c AS (SELECT *, CASE {_exact('rtc_supported', "'BOOLEAN'", 'true')} {' '.join(_exact(k, WHOLE, v) for k, v in wire.EXACT_METADATA.items() if v is not True)}
WHEN coalesce(trained NOT IN (16, 17), true) OR NOT {_equal('rtc_padding_start')} THEN 'trained width'
{' '.join(f"WHEN {_text(k)} <> '' AND NOT {_equal(k)} THEN '{k}'" for k in ('model_policy_dim', 'policy_dim'))}
{' '.join(f"WHEN {_text(k)} <> 'BOOLEAN' THEN '{k}'" for k in ('input_gripper_binary', 'output_gripper_binary'))}
WHEN {_text('rtc_action_space_id')} <> 'VARCHAR' OR {_value('rtc_action_space_id')} = '' THEN 'rtc_action_space_id' {_ordered('state_order')} {_ordered('action_order')} END AS error FROM b)
SELECT event_id, error, CASE WHEN error IS NULL THEN trained END AS trained_width, CASE WHEN error IS NULL THEN trained END AS padding_start, CASE WHEN error IS NULL THEN {_value('rtc_action_space_id')} END AS action_space FROM c""",
    "request_envelopes": f"""WITH a AS (SELECT event_id, user_id, value, {_S} AS s, {_D} AS given, {_SESSION} AS session, event_id % 11 AS o, CASE WHEN event_id % 43 = 1 THEN 'both' WHEN event_id % 3 = 1 THEN 'actions' WHEN event_id % 3 = 2 THEN 'model' ELSE '' END AS form FROM events),
b AS (SELECT *, coalesce(given, 6) AS d, CASE WHEN o = 0 THEN 20 ELSE 15 END AS trigger, CASE WHEN o IN (0, 1) THEN 2 ELSE 4 END AS reserve, CASE WHEN o = 0 THEN 2.5 ELSE 5.0 END AS weight, event_id % 31 = 0 AS wrong FROM a),
c AS (SELECT *, CASE WHEN session = '' THEN 'session_id' WHEN s < 0 THEN 'executed_steps' WHEN d < 0 THEN 'delay' WHEN form = 'both' THEN 'two histories'
  WHEN form <> '' AND NOT (s BETWEEN 1 AND 49 AND d <= s AND s + d <= 50 AND s + d + reserve <= 50) THEN 'schedule' WHEN form = '' AND s <> 0 THEN 'bootstrap after steps' WHEN form = '' AND NOT (d <= trigger AND trigger + d + reserve <= 50) THEN 'schedule'
  WHEN form = 'actions' AND wrong THEN 'previous_actions' WHEN form = 'model' AND wrong THEN 'previous_chunk_model' WHEN form = 'model' AND event_id % 47 = 2 AND value <> 0 THEN 'history padding' END AS error FROM b)
SELECT event_id, error, CASE WHEN error IS NULL THEN session END AS session_id, CASE WHEN error IS NULL THEN event_id END AS request_id, CASE WHEN error IS NULL THEN user_id % 3 END AS episode_epoch, CASE WHEN error IS NULL THEN s END AS executed_steps,
  CASE WHEN error IS NULL THEN d END AS delay, CASE WHEN error IS NULL THEN CASE WHEN form = '' THEN trigger ELSE s END END AS horizon, CASE WHEN error IS NULL THEN reserve END AS reserve, CASE WHEN error IS NULL THEN weight::DOUBLE END AS weight,
  CASE WHEN error IS NULL AND form = 'actions' THEN 50 - s END AS actions, CASE WHEN error IS NULL AND form = 'model' THEN 50 - s END AS model FROM c""",
    "reply_contract": f"""WITH a AS (SELECT event_id, user_id, value, CASE WHEN event_id % 61 <> 7 THEN {REPLY} END AS p FROM events), b AS (SELECT *, p::JSON AS j FROM a), m AS (SELECT *, try_cast(json_extract(j, '$.actions_model') AS DOUBLE[][]) AS model FROM b),
c AS (SELECT *, CASE WHEN p IS NULL THEN 'no reply' WHEN {_text('type')} <> 'VARCHAR' OR {_value('type')} <> 'action_chunk' THEN 'type' WHEN {_text('session_id')} <> 'VARCHAR' OR {_value('session_id')} <> 's' || user_id THEN 'session_id'
  WHEN {_text('request_id')} NOT IN ({WHOLE}) OR {_value('request_id')} <> event_id || '' THEN 'request_id' WHEN {_text('episode_epoch')} NOT IN ({WHOLE}) OR {_value('episode_epoch')}::INT <> user_id % 3 THEN 'episode_epoch'
  WHEN {_text('phase_epoch')} NOT IN ({WHOLE}) THEN 'phase_epoch' WHEN {_text('rtc')} <> 'OBJECT' OR {_value('rtc.action_time_origin')} <> 'request_observation' OR {_text('rtc.client_must_discard_elapsed_prefix')} <> 'BOOLEAN' THEN 'origin or prefix'
  WHEN {_text('rtc.guided')} <> 'BOOLEAN' THEN 'guided: no boolean' WHEN {_value('rtc.guided')} <> 'true' THEN 'branch' WHEN {_value('rtc.rtc_action_space_id')} <> 'space' THEN 'action space'
  WHEN model IS NULL OR len(model) <> 50 OR len(list_filter(flatten(model), lambda x: x IS NULL)) > 0 OR list_min(list_transform(model, lambda r: len(r))) <> 32 OR list_max(list_transform(model, lambda r: len(r))) <> 32 THEN 'chunk'
  WHEN len(list_filter(model, lambda r: len(list_filter(r[18:], lambda x: x <> 0)) > 0)) > 0 THEN 'padding' END AS error FROM m)
SELECT event_id, error, CASE WHEN error IS NULL THEN 50 END AS n, CASE WHEN error IS NULL THEN round(list_sum(list_transform(model, lambda r: r[1])), 3) END AS total FROM c""",
}
