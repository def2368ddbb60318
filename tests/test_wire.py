"""Each rule of the wire's contract, broken alone and together with a later one: the first is reported."""

import copy
import json
import math

import pytest
from pyspark.sql import functions as F

from kinetrace.functions import typed_json as j
from kinetrace.functions import wire
from kinetrace.plans import contracts


def checked(spark, column, *payloads):
    """``column(values)`` of rows of JSON texts, in order."""
    texts = [[p if isinstance(p, str) or p is None else json.dumps(p) for p in (row if isinstance(row, tuple) else (row,))] for row in payloads]
    names = [f"c{k}" for k in range(len(texts[0]))]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], ", ".join(["n int", *(f"{c} string" for c in names)]))
    return [r.found for r in rows.select("n", column(*[j.parsed(F.col(c)) for c in names]).alias("found")).orderBy("n").collect()]


def changed(value, path, to="gone"):
    out = copy.deepcopy(value)
    inner = out
    for key in path[:-1]:
        inner = inner[key]
    if to == "gone":
        del inner[path[-1]]
    else:
        inner[path[-1]] = to
    return out


ACTION = {part: {leaf: round(0.1 * k + len(part), 3) for k, leaf in enumerate(leaves)} for part, leaves in wire.ACTION.items()}


def test_kinds_are_told_apart_without_coercion(spark):
    texts = ["1", "1.0", "1e2", "-0", "true", '"1"', "null", "[1]", "{}", "NaN", '{"a":1,"a":2}', "1 2", "1,2", '{"a":1} x', "", "[1,]", None, "123456789012345678901"]
    want = ["integer", "real", "real", "integer", "boolean", "string", "null", "array", "object"] + ["missing"] * 8 + ["real"]
    assert checked(spark, j.kind, *texts) == want
    assert checked(spark, j.number, "1", "1.5", "true", '"1"', "null", "1e400") == [1.0, 1.5, None, None, None, None]
    assert checked(spark, j.whole, "1", "1.0", "true") == [1, None, None]
    assert checked(spark, lambda v: j.kind(j.at(v, "a.b", "it's")), {"a.b": {"it's": 1}}, {"a": {"b": 1}}) == ["integer", "missing"]


def test_sound_actions_are_flattened_in_order_as_floats(spark):
    whole = changed(ACTION, ("lift", "height"), 2)
    shuffled = {k: dict(reversed(v.items())) for k, v in reversed(ACTION.items())}
    for found, action in zip(checked(spark, wire.flatten, ACTION, whole, shuffled), (ACTION, whole, ACTION), strict=True):
        assert found.error is None
        assert found.vector == pytest.approx([action[part][leaf] for part, leaves in wire.ACTION.items() for leaf in leaves], rel=1e-6)


FAULTS = [
    ("[]", "action: no object"), ("7", "action: no object"), ("{", "action: no object"), (None, "action: no object"),
    (changed(ACTION, ("head",)), "action: missing head; unexpected "),
    (changed(changed(ACTION, ("more",), {}), ("also",), 1), "action: missing ; unexpected also,more"),
    (changed(changed(ACTION, ("waist",), 1), ("left", "joint7")), "action.waist: no object"),
    (changed(ACTION, ("lift",), None), "action.lift: no object"),
    (changed(changed(ACTION, ("left", "joint7")), ("left", "joint8"), 1), "action.left: missing joint7; unexpected joint8"),
    (changed(changed(ACTION, ("speed", "angular")), ("left", "joint1"), "x"), "action.speed: missing angular; unexpected "),
    (changed(ACTION, ("right", "joint1"), "0.0"), "action.right.joint1: no finite number"),
    (changed(ACTION, ("head", "yaw"), True), "action.head.yaw: no finite number"),
    (changed(ACTION, ("head", "pitch"), None), "action.head.pitch: no finite number"),
    (changed(ACTION, ("left", "gripper"), [1]), "action.left.gripper: no finite number"),
    (changed(ACTION, ("left", "joint2"), 1e39), "action: out of range"),
    (json.dumps(changed(ACTION, ("left", "joint2"), 5)).replace("5", "1e400", 1), "action.left.joint2: no finite number"),
    (json.dumps(changed(ACTION, ("head", "yaw"), math.nan)), "action: no object"),
]


def test_each_fault_of_an_action_is_named(spark):
    found = checked(spark, wire.flatten, *[f for f, _ in FAULTS])
    assert [(x.error, x.vector) for x in found] == [(e, None) for _, e in FAULTS]


def test_other_trees_nest_as_deep_as_they_like(spark):
    tree = {"a": {"b": ("x", "y"), "c": {"d": ("z",)}}, "e": ("w",)}
    good = {"a": {"b": {"x": 1, "y": 2.5}, "c": {"d": {"z": 3}}}, "e": {"w": 4}}
    found = checked(spark, lambda v: wire.flatten(v, tree, "t"), good, changed(good, ("a", "c", "d"), 3), changed(good, ("a", "b", "y")), changed(good, ("a", "c", "q"), 1))
    assert [(x.error, x.vector) for x in found] == [(None, [1, 2.5, 3, 4]), ("t.a.c.d: no object", None), ("t.a.b: missing y; unexpected ", None), ("t.a.c: missing ; unexpected q", None)]


def test_chunks_have_their_horizon_and_a_boolean_flag(spark):
    good = {"type": "action_chunk", "actions": [changed(ACTION, ("lift", "height"), k) for k in range(50)]}
    cases = [
        (good, None), (good | {"is_success": False}, None), ("[]", "reply: no object"), (good | {"type": "error", "error": "x"}, "server error"), (good | {"type": "metadata"}, "type"), (changed(good, ("type",)), "type"),
        (good | {"is_success": 1}, "is_success: no boolean"), (good | {"is_success": None}, "is_success: no boolean"), (good | {"actions": {}}, "actions: no array"), (changed(good, ("actions",)), "actions: no array"),
        (good | {"actions": good["actions"][:49]}, "actions: 49"), (good | {"actions": [*good["actions"], ACTION]}, "actions: 51"), (good | {"actions": []}, "actions: 0"),
        (changed(changed(good, ("actions", 7, "left", "joint1")), ("actions", 9), 1), "7 action.left: missing joint1; unexpected "),
        (changed(good, ("actions", 2, "head", "yaw"), "1"), "2 action.head.yaw: no finite number"),
    ]
    found = checked(spark, wire.action_chunk, *[c for c, _ in cases])
    assert [x.error for x in found] == [e for _, e in cases]
    assert [a[16] for a in found[0].actions] == list(range(50)) and found[2].actions is None


META = {
    **wire.EXACT_METADATA, "rtc_history_trained_dim": 17, "rtc_padding_start": 17, "input_gripper_binary": True, "output_gripper_binary": False, "rtc_action_space_id": "space",
    "state_order": list(wire.ORDER), "action_order": list(wire.ORDER), "robot": "any",
}
ALIASED = [dict(zip(wire.ALIASES.values(), wire.ALIASES, strict=True)).get(n, n) for n in wire.ORDER]


def test_metadata_allow_scheduling_only_if_each_value_is_exactly_right(spark):
    cases = [(META, None), (META | {"rtc_history_trained_dim": 16, "rtc_padding_start": 16, "policy_dim": 16}, None), (META | {"action_order": ALIASED}, None), (META | {"rtc_padding_start": 17.0, "model_policy_dim": 17}, None), ("[]", "metadata: no object")]
    for key, value in wire.EXACT_METADATA.items():
        wrong = [1, "true", None, False] if value is True else [float(value), str(value), value + 1, True]
        cases += [(META | {key: w}, key) for w in wrong] + [(changed(META, (key,)), key)]
    cases += [(META | {"rtc_history_trained_dim": w}, "trained width") for w in (15, 17.0, "17", True, None, 16)]
    cases += [(META | {"rtc_padding_start": w}, "trained width") for w in (16, "17", None)] + [(changed(META, ("rtc_padding_start",)), "trained width")]
    cases += [(META | {key: w}, key) for key in ("model_policy_dim", "policy_dim") for w in (16, None, "17")]
    cases += [(META | {key: w}, key) for key in ("input_gripper_binary", "output_gripper_binary") for w in (1, "true", None)] + [(changed(META, ("input_gripper_binary",)), "input_gripper_binary")]
    cases += [(META | {"rtc_action_space_id": w}, "rtc_action_space_id") for w in ("", 3, None)]
    cases += [(META | {key: w}, key) for key in ("state_order", "action_order") for w in ([], list(wire.ORDER)[::-1], [*wire.ORDER, "x"], [*wire.ORDER[:-1], 3], "left", None)]
    cases += [(META | {"rtc_supported": False, "action_order": []}, "rtc_supported")]
    found = checked(spark, wire.schedule_metadata, *[c for c, _ in cases])
    assert [x.error for x in found] == [e for _, e in cases]
    assert (found[1].trained_width, found[1].padding_start, found[1].action_space) == (16, 16, "space")
    replies = [({"type": "metadata", "metadata": {"k": 1}}, None), ({"type": "error"}, "server error"), ({"type": "x"}, "type"), ({"type": "metadata", "metadata": []}, "metadata: no object"), ("3", "reply: no object")]
    assert [x.error for x in checked(spark, wire.metadata_reply, *[r for r, _ in replies])] == [e for _, e in replies]


def test_settings_have_defaults_types_ranges_and_a_feasible_schedule(spark):
    cases = [("{}", None), ("null", None), (None, None), ({"trigger_index": 20, "max_guidance_weight": 0}, None), ({"odd": 1}, "unknown settings"), ("[]", "unknown settings")]
    for key, (_, low, high) in wire.WHOLE_SETTINGS.items():
        cases += [({key: w}, key) for w in (low - 1, high + 1, float(low), str(low), True, None)]
    cases += [({key: w}, f"{key}: not finite") for key in wire.REAL_SETTINGS for w in ("1", True, None)]
    cases += [({"max_guidance_weight": 5.1}, "max_guidance_weight"), ({"max_observation_age_s": 0}, "age or warm-up"), ({"max_observation_age_s": 2.5}, "age or warm-up"), ({"warmup_timeout_s": 601}, "age or warm-up"), ({"trigger_index": 49}, "schedule"), ({"trigger_index": 3}, "schedule"), ({"safety_reserve_steps": 40}, "schedule")]
    found = checked(spark, wire.settings, *[c for c, _ in cases])
    assert [x.error for x in found] == [e for _, e in cases]
    assert (found[0].trigger_index, found[0].delay_window, found[0].max_observation_age_s, found[3].trigger_index, found[3].max_guidance_weight) == (15, 20, 0.25, 20, 0.0)


def test_requests_are_bootstraps_or_guided_with_an_exact_history(spark):
    zeros = lambda n, w: [[0.0] * w for _ in range(n)]
    model = zeros(35, 32)
    model[0][0], padded, odd = 15.0, zeros(35, 32), zeros(35, 23)
    padded[3][17], odd[2][2] = 1.0, math.nan
    cases = [
        (("s", 0, 0, 0, 0, None, None, None), None), (("s", 4, 1, 2, 15, None, None, model), None), (("s", 4, 1, 2, 15, 7, zeros(35, 23), None), None), (("s", 4, 1, 2, 18, None, None, zeros(32, 32)), None),
        (("", 0, 0, 0, 0, None, None, None), "session_id"), ((None, -1, 0, 0, 0, None, None, None), "session_id"), (("s", -1, 0, 0, 0, None, None, None), "request_id"), (("s", None, 0, 0, 0, None, None, None), "request_id"),
        (("s", 0, -1, 0, 0, None, None, None), "episode_epoch"), (("s", 0, 0, -1, 0, None, None, None), "phase_epoch"), (("s", 0, 0, 0, -1, None, None, None), "executed_steps"), (("s", 0, 0, 0, 0, -1, None, None), "delay"),
        (("s", 0, 0, 0, 15, None, zeros(35, 23), model), "two histories"), (("s", 0, 0, 0, 1, None, None, None), "bootstrap after steps"), (("s", 0, 0, 0, 0, 16, None, None), "schedule"), (("s", 0, 0, 0, 3, None, zeros(47, 23), None), "schedule"), (("s", 0, 0, 0, 28, 28, zeros(22, 23), None), "schedule"),
        (("s", 0, 0, 0, 15, None, zeros(34, 23), None), "previous_actions"), (("s", 0, 0, 0, 15, None, zeros(35, 22), None), "previous_actions"), (("s", 0, 0, 0, 15, None, odd, None), "previous_actions"),
        (("s", 0, 0, 0, 15, None, None, zeros(50, 32)), "previous_chunk_model"), (("s", 0, 0, 0, 15, None, None, padded), "history padding"),
    ]
    ddl = "n int, session string, request long, episode long, phase long, s int, d int, actions array<array<double>>, model array<array<double>>"
    rows = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], ddl)
    chosen = wire.settings(j.parsed(F.lit('{"max_guidance_weight": 2.5}')))
    columns = [F.col(c) for c in ("session", "request", "episode", "phase", "s", "d")]
    found = [r.found for r in rows.select("n", wire.request(*columns, chosen, F.col("actions"), F.col("model")).alias("found")).orderBy("n").collect()]
    assert [x.error for x in found] == [e for _, e in cases]
    fixed = {"enabled": True, "protocol_version": 1, "safety_reserve_steps": 2, "num_denoising_steps": 10, "max_guidance_weight": 2.5}
    boot, guided, physical, late = (json.loads(x.envelope) for x in found[:4])
    assert boot == {"session_id": "s", "request_id": 0, "rtc": fixed | {"episode_epoch": 0, "phase_epoch": 0, "executed_steps": 0, "estimated_delay_steps": 6, "execution_horizon": 15}}
    assert guided == {"session_id": "s", "request_id": 4, "rtc": fixed | {"episode_epoch": 1, "phase_epoch": 2, "executed_steps": 15, "estimated_delay_steps": 6, "execution_horizon": 15, "previous_chunk_model": model}}
    assert physical["rtc"]["estimated_delay_steps"] == 7 and physical["rtc"]["previous_actions"] == zeros(35, 23) and "previous_chunk_model" not in physical["rtc"]
    assert late["rtc"]["execution_horizon"] == 18


ASKED = {"session_id": "s", "request_id": 3, "rtc": {"episode_epoch": 0, "phase_epoch": 2}}
REPLY = {
    "type": "action_chunk", "session_id": "s", "request_id": 3, "episode_epoch": 0, "phase_epoch": 2, "actions_model": [[0.5] * 17 + [0.0] * 15 for _ in range(50)],
    "rtc": {"guided": False, "action_time_origin": "request_observation", "client_must_discard_elapsed_prefix": True},
}


def test_replies_answer_their_request_in_the_branch_asked_for(spark):
    rtc = lambda **kw: REPLY | {"rtc": REPLY["rtc"] | kw}
    guided = changed(ASKED, ("rtc", "previous_actions"), [])
    narrow = META | {"rtc_padding_start": 16}
    chunk = ("actions_model",)
    cases = [
        ((REPLY, ASKED, META), None), ((rtc(guided=True), guided, META), None), ((rtc(rtc_action_space_id="space"), ASKED, META), None), ((changed(REPLY, ("actions_model", 0, 0), True), ASKED, META), None), ((changed(REPLY, ("actions_model", 0, 0), "1.5"), ASKED, META), None),
        (("{", ASKED, META), "type"), ((REPLY | {"type": "error", "error": "x"}, ASKED, META), "type"), ((changed(REPLY, ("type",)), ASKED, META), "type"),
        ((REPLY | {"session_id": "old", "request_id": 9}, ASKED, META), "session_id"), ((REPLY | {"session_id": None}, ASKED, META), "session_id"), ((changed(REPLY, ("session_id",)), ASKED, META), "session_id"),
        ((REPLY | {"request_id": 2}, ASKED, META), "request_id"), ((REPLY | {"request_id": "3"}, ASKED, META), "request_id"), ((REPLY | {"request_id": 3.0}, ASKED, META), "request_id"),
        ((REPLY | {"episode_epoch": False}, ASKED, META), "episode_epoch"), ((REPLY | {"episode_epoch": 1}, ASKED, META), "episode_epoch"), ((REPLY | {"phase_epoch": 2.0}, ASKED, META), "phase_epoch"), ((changed(REPLY, ("phase_epoch",)), ASKED, META), "phase_epoch"),
        ((REPLY | {"rtc": [1]}, ASKED, META), "origin or prefix"), ((changed(REPLY, ("rtc",)), ASKED, META), "origin or prefix"), ((rtc(action_time_origin="arrival"), ASKED, META), "origin or prefix"), ((rtc(client_must_discard_elapsed_prefix=1), ASKED, META), "origin or prefix"), ((rtc(client_must_discard_elapsed_prefix=False), ASKED, META), "origin or prefix"),
        ((changed(REPLY, ("rtc", "guided")), ASKED, META), "guided: no boolean"), ((rtc(guided=0), ASKED, META), "guided: no boolean"), ((rtc(guided=True), ASKED, META), "branch"), ((REPLY, guided, META), "branch"), ((REPLY, changed(ASKED, ("rtc", "previous_chunk_model"), None), META), "branch"),
        ((rtc(rtc_action_space_id="other"), ASKED, META), "action space"), ((rtc(rtc_action_space_id=None), ASKED, META), "action space"),
        ((changed(REPLY, ("actions_model", 49)), ASKED, META), "chunk"), ((changed(REPLY, ("actions_model", 9, 31)), ASKED, META), "chunk"), ((changed(REPLY, ("actions_model", 9, 3), None), ASKED, META), "chunk"), ((changed(REPLY, ("actions_model", 9, 3), "x"), ASKED, META), "chunk"), ((changed(REPLY, ("actions_model", 9, 3), [0]), ASKED, META), "chunk"), ((changed(REPLY, chunk), ASKED, META), "chunk"), ((changed(REPLY, chunk, "x"), ASKED, META), "chunk"),
        ((changed(REPLY, ("actions_model", 0, 17), 1), ASKED, META), "padding"), ((REPLY, ASKED, narrow), "padding"),
        ((changed(rtc(guided=True), ("actions_model", 0, 17), 1) | {"phase_epoch": 0}, ASKED, META), "phase_epoch"),
    ]
    found = checked(spark, wire.reply_fault, *[c for c, _ in cases])
    assert [x.error for x in found] == [e for _, e in cases]
    assert found[0].model == REPLY["actions_model"] and found[4].model[0][0] == 1.5 and found[-1].model is None


def test_replies_meet_their_request_in_a_slot(spark):
    text = json.dumps
    requests = spark.createDataFrame([(1, text(ASKED), text(META)), (2, text(ASKED), text(META)), (3, text(ASKED), text(META))], "slot int, envelope string, metadata string")
    replies = spark.createDataFrame([(1, text(REPLY)), (1, text(REPLY | {"session_id": "late"})), (2, "no json"), (9, text(REPLY))], "slot int, reply string")
    got = wire.check_replies(requests, replies, ["slot"]).select("slot", "error", F.size("model").alias("n")).collect()
    assert sorted((r.slot, r.error or "", r.n) for r in got) == [(1, "", 50), (1, "session_id", None), (2, "type", None), (3, "no reply", None)]


def test_texts_of_replies_are_not_broadcast(spark):
    """The table that they are made from is small, and the texts are not."""
    held = contracts.reply_contract(spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_texts_of_replies_are_not_sorted(spark):
    """They pass by the requests of their partition: neither they nor what is read from them is sorted or kept."""
    plan = contracts.reply_contract(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_chunks_are_read_apart_from_their_replies(spark):
    """No variant is made of a chunk whose leaves are no objects, and what is told of a reply is what is told of the whole text."""
    good, old = json.dumps(REPLY), json.dumps(REPLY | {"session_id": "old"})
    leaf = lambda text, to: text.replace("[[0.5,", f"[[{to},", 1)
    inner = lambda value: good.replace('"guided"', f'"actions_model": {value}, "guided"')
    cases = [(leaf(good, x), True, e) for x, e in (("0.5", None), ("-1e5", None), ("true", None), ('"1.5"', None), ('"true"', "chunk"), ("null", "chunk"), ('"x"', "chunk"), ("[1]", "chunk"), ("1e400", "chunk"))]
    cases += [(leaf(good, x), True, "type") for x in ("01", "1.", "tru", "1 2", "[1,,2]", "1true", "")]
    cases += [(leaf(old, x), True, e) for x, e in (("0.5", "session_id"), ("null", "session_id"), ('"x"', "session_id"), ("[1]", "session_id"), ("01", "type"), ("[1,,2]", "type"))]
    cases += [(leaf(good, "{}"), False, "chunk"), (leaf(good, '{"a": 1, "a": 2}'), False, "type"), (leaf(good, r'"\u0031"'), False, None), (good.replace("[[", "", 1), False, "type"), (good.replace("], [", "] [", 1), False, "type")]
    # the rest is parsed as ever: what lies behind, repeated keys, further chunks and texts like the mark
    cases += [(good + " x", False, "type"), (good[:-1] + ', "type": "action_chunk"}', False, "type"), (good[:-1] + ', "actions_model": [[1]]}', False, "type"), (inner("[[1]]"), True, None), (inner("[[1, ]]"), False, "type")]
    cases += [(good[:-1] + ', "m": "@@@@"}', False, None), (inner("[[1]]").replace(json.dumps(REPLY["actions_model"]), r'"\u0040@@@"'), False, "chunk"), (good.replace(json.dumps(REPLY["actions_model"]), '"@@@@"'), False, "chunk")]
    rows = spark.createDataFrame([(k, t, json.dumps(ASKED), json.dumps(META)) for k, (t, *_) in enumerate(cases)], "slot int, reply string, envelope string, metadata string")
    cut = wire._cut(rows, "reply").select("slot", "_cut.apart", F.length(F.to_json("_cut.reply")).alias("n")).orderBy("slot").collect()
    assert [r.apart for r in cut] == [a for _, a, _ in cases] and max(r.n for r in cut if r.apart) < 400
    whole = [r.found for r in rows.select("slot", wire.reply_fault(*[j.parsed(F.col(c)) for c in ("reply", "envelope", "metadata")]).alias("found")).orderBy("slot").collect()]
    got = wire.check_replies(rows.drop("reply"), rows.select("slot", "reply"), ["slot"]).orderBy("slot").collect()
    assert [r.error for r in got] == [e for *_, e in cases]
    assert [(r.error, r.model) for r in got] == [(r.error, r.model) for r in whole]
