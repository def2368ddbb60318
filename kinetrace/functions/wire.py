"""The contract of a policy server's wire: structured actions, replies, metadata, request envelopes.

Each check gives the first broken rule in a fixed order as ``error``, which is null for sound input, and what was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import typed_json as j

# The tree of an action, its horizon and widths, and the settings of the schedule with their ranges and defaults.
SIDE = ("joint1", "joint2", "joint3", "joint4", "joint5", "joint6", "joint7", "gripper")
ACTION = {"left": SIDE, "right": SIDE, "lift": ("height",), "waist": ("pitch", "yaw"), "head": ("yaw", "pitch"), "speed": ("linear", "angular")}
HORIZON, WIDTH, MODEL_WIDTH, MODEL_AXES = 50, 23, 32, 17
ORDER = tuple(f"{part}.{leaf}" for part, leaves in ACTION.items() for leaf in leaves)
ALIASES = {"lift.target_height": "lift.height", "base.linear_velocity": "speed.linear", "base.angular_velocity": "speed.angular"}
EXACT_METADATA = {"rtc_supported": True, "rtc_protocol_version": 1, "action_horizon": 50, "wire_state_dim": 23, "wire_action_dim": 23, "model_action_dim": 32}
TRAINED_WIDTHS = (16, 17)
WHOLE_SETTINGS = {
    "trigger_index": (15, 1, 49), "delay_initial_steps": (6, 0, 24), "safety_reserve_steps": (2, 0, 49), "num_denoising_steps": (10, 1, 50),
    "delay_window": (20, 1, 1000), "delay_margin_steps": (1, 0, 49), "dry_run_chunks": (3, 2, 20),
}
REAL_SETTINGS = {"max_guidance_weight": 5.0, "max_observation_age_s": 0.25, "warmup_timeout_s": 120.0}


def _result(error: Column, **read: Column) -> Column:
    return j.bind(error, lambda e: F.struct(e.alias("error"), *[F.when(e.isNull(), v).alias(k) for k, v in read.items()]))


def _leaves(tree: dict, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    return [leaf for k, sub in tree.items() for leaf in (_leaves(sub, (*path, k)) if isinstance(sub, dict) else [(*path, k, name) for name in sub])]


def _shape(tree: dict | tuple) -> str:
    """The pattern of the type of a sound object, whose keys a variant keeps sorted."""
    inner = {k: _shape(sub) for k, sub in tree.items()} if isinstance(tree, dict) else dict.fromkeys(tree, r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))")
    return "OBJECT<" + ", ".join(f"{k}: {inner[k]}" for k in sorted(inner)) + ">"


def flatten(value: Column, tree: dict = ACTION, root: str = "action") -> Column:
    """``error, vector``: the leaves of a tree of objects in its order, as 32-bit floats.

    The keys at every level are exactly those of ``tree``: a dict of parts, or a tuple of leaves that are finite numbers. Objects are
    checked before keys, outer levels before inner ones, and leaves last, in order. A sound tree is told by its type alone, so
    the rules are gone through for broken ones only.
    """
    return j.bind(value, lambda v: _flattened(v, tree, root))


def _flattened(value: Column, tree: dict, root: str) -> Column:
    rules, level = [(~j.is_kind(value, "object"), f"{root}: no object")], [((), tree)]
    while level:
        rules += [(~j.is_kind(j.at(value, *p), "object"), f"{'.'.join((root, *p))}: no object") for p, _ in level if p]
        for p, sub in level:
            fault = j.key_fault(j.at(value, *p) if p else value, tuple(sub), ".".join((root, *p)))
            rules.append((fault.isNotNull(), fault))
        level = [((*p, k), below) for p, sub in level if isinstance(sub, dict) for k, below in sub.items()]
    leaves = _leaves(tree)
    rules += [(j.number(j.at(value, *p)).isNull(), f"{'.'.join((root, *p))}: no finite number") for p in leaves]
    # kinds are known once the type is
    vector = F.array(*[F.try_variant_get(value, j.path(p), "double").cast("float") for p in leaves])
    narrow = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    typed = F.when(F.schema_of_variant(value).rlike(f"^{_shape(tree)}$"), vector)
    error = lambda v: F.when(v.isNull() | narrow(v), F.coalesce(j.first_fault(*rules), F.lit(f"{root}: out of range")))
    return j.bind(typed, lambda v: _result(error(v), vector=v))


def action_chunk(reply: Column, tree: dict = ACTION, horizon: int = HORIZON) -> Column:
    """``error, actions``: the vectors of a reply of exactly ``horizon`` structured actions."""
    actions = lambda r: j.items(j.at(r, "actions"))
    flat = lambda r: F.when(F.size(actions(r)) == horizon, F.transform(actions(r), lambda a: flatten(a, tree)))
    return j.bind(reply, lambda r: j.bind(flat(r), lambda f: _chunk(r, f, horizon)))


def _chunk(reply: Column, flat: Column, horizon: int) -> Column:
    kind, done, actions = j.string(j.at(reply, "type")), j.at(reply, "is_success"), j.at(reply, "actions")
    faults = F.filter(F.transform(flat, lambda x, i: F.concat(i.cast("string"), F.lit(" "), x["error"])), lambda e: e.isNotNull())
    fault = F.get(faults, F.lit(0))
    error = j.first_fault(
        (~j.is_kind(reply, "object"), "reply: no object"),
        (kind == "error", "server error"),
        (F.coalesce(kind != "action_chunk", F.lit(True)), "type"),
        (done.isNotNull() & ~j.is_kind(done, "boolean"), "is_success: no boolean"),
        (~j.is_kind(actions, "array"), "actions: no array"),
        (F.size(j.items(actions)) != horizon, F.concat(F.lit("actions: "), F.size(j.items(actions)).cast("string"))),
        (fault.isNotNull(), fault),
    )
    return _result(error, actions=F.transform(flat, lambda x: x["vector"]))


def metadata_reply(reply: Column) -> Column:
    """``error, metadata``: what a metadata reply holds; its contents are not looked at."""
    return j.bind(reply, _metadata)


def _metadata(reply: Column) -> Column:
    kind = j.string(j.at(reply, "type"))
    error = j.first_fault(
        (~j.is_kind(reply, "object"), "reply: no object"),
        (kind == "error", "server error"),
        (F.coalesce(kind != "metadata", F.lit(True)), "type"),
        (~j.is_kind(j.at(reply, "metadata"), "object"), "metadata: no object"),
    )
    return _result(error, metadata=j.at(reply, "metadata"))


def _same(value: Column, wanted: bool | int) -> Column:
    return F.coalesce((j.flag(value) if isinstance(wanted, bool) else j.whole(value)) == F.lit(wanted), F.lit(False))


def _equal_number(value: Column, wanted: Column) -> Column:
    """Equality of values as numbers: a real that is whole counts, and true counts as 1."""
    found = F.when(j.is_kind(value, "integer", "real", "boolean"), F.try_variant_get(value, "$", "double"))
    return F.coalesce(found == wanted, F.lit(False))


def _in_order(value: Column, order: tuple[str, ...]) -> Column:
    names = F.transform(j.items(value), lambda x: _alias(j.string(x)))
    return F.coalesce(names == F.array(*map(F.lit, order)), F.lit(False))


def _alias(name: Column) -> Column:
    out = name
    for old, new in ALIASES.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def schedule_metadata(value: Column) -> Column:
    """``error, trained_width, padding_start, action_space``: whether a server's metadata allow chunks to be scheduled ahead.

    Keys of EXACT_METADATA hold exactly these values, of their type; the trained width is 16 or 17, padding starts there, and policy widths do not
    contradict it; gripper flags are boolean; the action space has a name; state and action have the order of the wire, but for aliases.
    """
    return j.bind(value, lambda v: j.bind(j.whole(j.at(v, "rtc_history_trained_dim")), lambda trained: _schedule(v, trained)))


def _schedule(value: Column, trained: Column) -> Column:
    padding = j.at(value, "rtc_padding_start")
    space = j.string(j.at(value, "rtc_action_space_id"))
    rules = [(~j.is_kind(value, "object"), "metadata: no object")]
    rules += [(~_same(j.at(value, k), v), k) for k, v in EXACT_METADATA.items()]
    rules += [(F.coalesce(~trained.isin(*TRAINED_WIDTHS), F.lit(True)) | ~_equal_number(padding, trained.cast("double")), "trained width")]
    rules += [(j.at(value, k).isNotNull() & ~_equal_number(j.at(value, k), trained.cast("double")), k) for k in ("model_policy_dim", "policy_dim")]
    rules += [(~j.is_kind(j.at(value, k), "boolean"), k) for k in ("input_gripper_binary", "output_gripper_binary")]
    rules += [(F.coalesce(space == "", F.lit(True)), "rtc_action_space_id")]
    rules += [(~_in_order(j.at(value, k), ORDER), k) for k in ("state_order", "action_order")]
    return _result(j.first_fault(*rules), trained_width=trained, padding_start=F.try_variant_get(padding, "$", "int"), action_space=space)


def feasible(s: Column, d: Column, reserve: Column, horizon: int = HORIZON) -> Column:
    """Whether a chunk lasts until the next one takes over after ``s`` steps with a delay of ``d``."""
    return F.coalesce((s > 0) & (s < horizon) & (d >= 0) & (d <= s) & (s <= horizon - d) & (s + d + reserve <= horizon), F.lit(False))


def settings(options: Column) -> Column:
    """``error`` and the settings of a schedule: the defaults, with what an object of options sets; null or JSON null sets nothing."""
    return j.bind(options, _settings)


def _settings(given: Column) -> Column:
    read = {k: F.coalesce(j.whole(j.at(given, k)), F.when(j.at(given, k).isNull(), F.lit(v[0]).cast("bigint"))) for k, v in WHOLE_SETTINGS.items()}
    read |= {k: F.coalesce(j.number(j.at(given, k)), F.when(j.at(given, k).isNull(), F.lit(v))) for k, v in REAL_SETTINGS.items()}
    known = F.lit([*WHOLE_SETTINGS, *REAL_SETTINGS])
    odd = ~j.is_kind(given, "object") | (F.size(F.array_except(j.keys(given), known)) > 0)
    return j.bind(F.struct(*[v.alias(k) for k, v in read.items()]), lambda r: _result(_settings_fault(~j.is_kind(given, "missing", "null") & odd, r), **{k: r[k] for k in read}))


def _settings_fault(odd: Column, read: Column) -> Column:
    rules = [(odd, "unknown settings")]
    rules += [(~F.coalesce(read[k].between(low, high), F.lit(False)), k) for k, (_, low, high) in WHOLE_SETTINGS.items()]
    rules += [(read[k].isNull(), f"{k}: not finite") for k in REAL_SETTINGS]
    rules += [(~read["max_guidance_weight"].between(0, 5), "max_guidance_weight")]
    age, warm = read["max_observation_age_s"], read["warmup_timeout_s"]
    rules += [((age <= 0) | (age > 2) | (warm <= 0) | (warm > 600), "age or warm-up")]
    rules += [(~feasible(read["trigger_index"], read["delay_initial_steps"], read["safety_reserve_steps"]), "schedule")]
    return j.first_fault(*rules)


def _matrix_fault(rows: Column, n: Column, width: int) -> Column:
    """Whether a matrix is not ``n`` by ``width`` finite numbers; not-a-number is the largest of an array, and an overlap is unknown where a null is."""
    shape = (F.size(rows) == n) & F.forall(rows, lambda r: F.size(r) == width)
    flat = F.flatten(rows)
    full = (F.array_max(flat) < float("inf")) & ~F.arrays_overlap(flat, F.array(F.lit(float("-inf"))))
    return ~F.coalesce(shape & full, F.lit(False))


def _padding_fault(rows: Column, start: Column) -> Column:
    """Whether a matrix of numbers is not zero from an axis on."""
    left = lambda r: F.greatest(F.size(r) - start, F.lit(0))
    return F.coalesce(F.exists(rows, lambda r: F.slice(r, start + 1, left(r)) != F.array_repeat(F.lit(0.0), left(r))), F.lit(False))


def request(session: Column, request_id: Column, episode: Column, phase: Column, s: Column, d: Column, chosen: Column, actions: Column, model: Column) -> Column:
    """``error, envelope``: the JSON that goes with a request for the next chunk.

    ``chosen`` is a sound result of :func:`settings`, ``d`` is null for its initial delay, and ``actions`` and ``model`` are two forms of what is left
    of the chunk that runs, at most one of them. Without either the request is a bootstrap: no step has been executed and the horizon is the
    trigger's; with one it is guided, and the history has exactly the steps behind ``s``.
    """
    given = F.struct(session.alias("session"), request_id.alias("request"), episode.alias("episode"), phase.alias("phase"), s.alias("s"), d.alias("d"), chosen.alias("chosen"), actions.alias("actions"), model.alias("model"))
    return j.bind(given, lambda g: _request(*[g[k] for k in ("session", "request", "episode", "phase", "s", "d", "chosen", "actions", "model")]))


def _request(session: Column, request_id: Column, episode: Column, phase: Column, s: Column, d: Column, chosen: Column, actions: Column, model: Column) -> Column:
    delay, guided = F.coalesce(d, chosen["delay_initial_steps"]), actions.isNotNull() | model.isNotNull()
    reserve, left = chosen["safety_reserve_steps"], F.lit(HORIZON) - s
    below = lambda x: F.coalesce(x < 0, F.lit(True))
    error = j.first_fault(
        (F.coalesce(session == "", F.lit(True)), "session_id"),
        (below(request_id), "request_id"),
        (below(episode), "episode_epoch"),
        (below(phase), "phase_epoch"),
        (below(s), "executed_steps"),
        (below(delay), "delay"),
        (actions.isNotNull() & model.isNotNull(), "two histories"),
        (guided & ~feasible(s, delay, reserve), "schedule"),
        (~guided & (s != 0), "bootstrap after steps"),
        (~guided & ~feasible(chosen["trigger_index"], delay, reserve), "schedule"),
        (actions.isNotNull() & _matrix_fault(actions, left, WIDTH), "previous_actions"),
        (model.isNotNull() & _matrix_fault(model, left, MODEL_WIDTH), "previous_chunk_model"),
        (model.isNotNull() & _padding_fault(model, F.lit(MODEL_AXES)), "history padding"),
    )
    inner = F.struct(
        F.lit(True).alias("enabled"), F.lit(1).alias("protocol_version"), episode.alias("episode_epoch"), phase.alias("phase_epoch"), s.alias("executed_steps"), delay.alias("estimated_delay_steps"),
        F.when(guided, s).otherwise(chosen["trigger_index"]).alias("execution_horizon"), reserve.alias("safety_reserve_steps"), chosen["num_denoising_steps"].alias("num_denoising_steps"), chosen["max_guidance_weight"].alias("max_guidance_weight"),
        actions.alias("previous_actions"), model.alias("previous_chunk_model"),
    )
    return _result(error, envelope=F.to_json(F.struct(session.alias("session_id"), request_id.alias("request_id"), inner.alias("rtc"))))


def reply_fault(reply: Column, asked: Column, metadata: Column) -> Column:
    """``error, model``: whether a reply answers the request that it is held against, in the branch that was asked for, with a sound chunk.

    ``asked`` is the envelope of the request and ``metadata`` the server's, whose ``rtc_padding_start`` and ``rtc_action_space_id`` count. Ids have
    the same type and value. The chunk is read as numbers wherever its leaves can be, as the server's own arrays are; that of a reply that is wrong
    before it is not looked at.
    """
    chunk = lambda g: F.struct(_numbers(j.at(g["reply"], "actions_model")).alias("model"), _padding_start(g["metadata"]).alias("start"))
    read = lambda g: j.bind(chunk(g), lambda c: _result(_chunk_fault(c["model"], c["start"]), model=c["model"]))
    told = lambda g, error: F.when(error.isNull(), read(g)).otherwise(_result(error, model=F.lit(None).cast(MATRIX)))
    return j.bind(F.struct(reply.alias("reply"), asked.alias("asked"), metadata.alias("metadata")), lambda g: j.bind(_answer_fault(g["reply"], g["asked"], g["metadata"]), lambda e: told(g, e)))


MATRIX = "array<array<double>>"


def _numbers(chunk: Column) -> Column:
    """A chunk's leaves as numbers; a text of plain numbers is read several times as fast as a tree of variants."""
    return j.bind(chunk, lambda c: F.coalesce(F.from_json(F.to_json(c), MATRIX), F.try_variant_get(c, "$", MATRIX)))


def _row_numbers(rows: Column) -> Column:
    """Rows of a chunk, given as texts, as numbers: a tree of variants is made only of a row with other leaves."""
    return F.transform(rows, lambda r: F.coalesce(F.from_json(r, "array<double>"), F.try_variant_get(F.try_parse_json(r), "$", "array<double>")))


def _chunk_fault(model: Column, start: Column) -> Column:
    return j.first_fault((_matrix_fault(model, F.lit(HORIZON), MODEL_WIDTH), "chunk"), (_padding_fault(model, start), "padding"))


def _padding_start(metadata: Column) -> Column:
    return F.try_variant_get(j.at(metadata, "rtc_padding_start"), "$", "int")


def _answer_fault(reply: Column, asked: Column, metadata: Column) -> Column:
    """The first broken rule of a reply but for its chunk."""
    inner, theirs = j.at(reply, "rtc"), j.at(asked, "rtc")
    guided = j.at(theirs, "previous_actions").isNotNull() | j.at(theirs, "previous_chunk_model").isNotNull()
    same = lambda key: (j.kind(j.at(reply, key)) == j.kind(j.at(asked, key))) & F.try_variant_get(j.at(reply, key), "$", "string").eqNullSafe(F.try_variant_get(j.at(asked, key), "$", "string"))
    epoch = lambda key: F.coalesce(j.whole(j.at(reply, key)) == j.whole(j.at(theirs, key)), F.lit(False))
    origin = (j.string(j.at(inner, "action_time_origin")) == "request_observation") & j.flag(j.at(inner, "client_must_discard_elapsed_prefix"))
    space = j.at(inner, "rtc_action_space_id")
    return j.first_fault(
        (F.coalesce(j.string(j.at(reply, "type")) != "action_chunk", F.lit(True)), "type"),
        (~same("session_id"), "session_id"),
        (~same("request_id"), "request_id"),
        (~epoch("episode_epoch"), "episode_epoch"),
        (~epoch("phase_epoch"), "phase_epoch"),
        (~j.is_kind(inner, "object") | ~F.coalesce(origin, F.lit(False)), "origin or prefix"),
        (~j.is_kind(j.at(inner, "guided"), "boolean"), "guided: no boolean"),
        (j.flag(j.at(inner, "guided")) != guided, "branch"),
        (space.isNotNull() & ~F.coalesce(j.string(space) == j.string(j.at(metadata, "rtc_action_space_id")), F.lit(False)), "action space"),
    )


# A chunk within the text of a reply: rows in brackets, whose leaves are anything but objects and texts with escapes. Brackets match, so nothing lies behind the value; the JSON reader
# tells whether it is sound.
_RUN = r"[-+.,0123456789truefalsnE \t\r\n]*"
_ROW = rf'\[{_RUN}(?:(?:"[^"\\\x00-\x1f]*+"|\[{_RUN}\]){_RUN})*+\]'
CHUNK = rf'"actions_model"\s*+:\s*+(\[\s*+{_ROW}(?:\s*+,\s*+{_ROW})*+\s*+\])'
MARK, ESCAPED_MARK = "@@@@", "\\u0040"


def _cut(rows: DataFrame, reply: str) -> DataFrame:
    """``rows`` with the chunk of the text ``reply`` as ``_chunk`` and, as ``_cut.reply``, a variant of the text, without the chunk if ``_cut.apart``.

    A mark takes the place of the chunk. If the mark is there once, in other letters neither, and is what the rest holds as its chunk, then the whole is
    sound JSON just if the rest and the chunk are. Texts for which that cannot be told are parsed as a whole.
    """
    parts = lambda value, apart: F.struct(value.alias("reply"), F.lit(apart).alias("apart"))
    once = (F.size(F.split("_rest", MARK)) == 2) & ~F.contains(F.col("_rest"), F.lit(ESCAPED_MARK))
    held = lambda rest: F.coalesce(j.string(j.at(rest, "actions_model")) == MARK, F.lit(False))
    cut = j.bind(F.when(once, j.parsed(F.col("_rest"))), lambda rest: F.when(held(rest), parts(rest, True)).otherwise(parts(j.parsed(F.col(reply)), False)))
    found = rows.withColumn("_chunk", F.regexp_extract(reply, CHUNK, 1))
    return found.withColumn("_rest", F.when(F.col("_chunk") != "", F.replace(F.col(reply), F.col("_chunk"), F.lit(f'"{MARK}"')))).withColumn("_cut", cut).drop("_rest")


def _read(rows: DataFrame, right: Column) -> DataFrame:
    """``_model``, the chunk of :func:`_cut` as numbers where the rest is ``right``, and ``_known``, whether it has turned out to be JSON."""
    chunk, apart, plain, texts = F.col("_chunk"), F.col("_cut.apart"), F.col("_plain"), F.col("_texts")
    found = rows.withColumn("_plain", F.when(apart & right, F.from_json(chunk, MATRIX)))
    found = found.withColumn("_texts", F.when(apart & right & plain.isNull(), F.from_json(chunk, "array<string>")))
    model = F.when(apart, F.coalesce(plain, _row_numbers(texts))).otherwise(_numbers(j.at(F.col("_cut.reply"), "actions_model")))
    return found.withColumns({"_model": F.when(right, model), "_known": ~apart | plain.isNotNull() | texts.isNotNull()}).drop("_plain", "_texts")


def check_replies(requests: DataFrame, replies: DataFrame, on: list[str], asked: str = "envelope", reply: str = "reply", metadata: str = "metadata") -> DataFrame:
    """Each request with ``error`` of its reply and the ``model`` chunk of a sound one.

    ``on`` is the slot of a connection, of which a server answers one request at a time; a request without a reply has the error ``no reply``, and a
    reply that is no JSON ``type``. Payloads are texts; a slot with several replies gives a row for each.
    """
    # texts are far larger than what Spark takes them for, so they are never broadcast, and pass by the requests of their partition without being sorted
    found = requests.hint("shuffle_hash").join(replies, on, "left")
    server = j.parsed(F.col(metadata))
    answered = F.struct(F.col("_cut.reply").alias("reply"), j.parsed(F.col(asked)).alias("asked"), server.alias("metadata"))
    told = _cut(found, reply).withColumn("_fault", F.when(F.col(reply).isNull(), "no reply").otherwise(j.bind(answered, lambda g: _answer_fault(g["reply"], g["asked"], g["metadata"]))))
    read = _read(told.withColumn("_start", _padding_start(server)), F.col("_fault").isNull())
    sound = F.col("_known") | F.json_array_length("_chunk").isNotNull()
    fault = F.when(F.col("_fault").isin("no reply", "type"), F.col("_fault")).when(~sound, "type").when(F.col("_fault").isNotNull(), F.col("_fault"))
    checked = read.withColumn("_error", F.coalesce(fault, _chunk_fault(F.col("_model"), F.col("_start"))))
    return checked.select(*requests.columns, *[c for c in replies.columns if c not in on], F.col("_error").alias("error"), F.when(F.col("_error").isNull(), F.col("_model")).alias("model"))
