import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import checks, paths, protocol, text, vectors
from kinetrace.functions.nested import finite_columns, finite_tree
from kinetrace.operators import cameras, correlate, health, policy, rewrite, timeline
from kinetrace.plans import dims
from kinetrace.sources import audio, episodes, traces
from kinetrace.streaming import stateful
from test_streaming import run  # noqa: F401

NAN, INF = math.nan, math.inf


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers_that_are_not_finite_become_null_at_any_depth(spark):
    ddl = "a double, `b.c` array<struct<x:float,m:map<string,array<double>>>>, s struct<n:int,inner:struct<v:double,w:array<array<double>>>>, t string, e array<double>"
    rows = [(NAN, [(INF, {"k": [1.0, -INF, None]}), None, (1.5, None)], (1, (NAN, [[NAN, 2.0], None])), "x", []), (1.0, None, None, None, None), (-INF, [], (2, None), "y", [NAN])]
    got = [tuple(r) for r in finite_columns(spark.createDataFrame(rows, ddl)).collect()]
    assert got == [(None, [(None, {"k": [1.0, None, None]}), None, (1.5, None)], (1, (None, [[None, 2.0], None])), "x", []), (1.0, None, None, None, None), (None, [], (2, None), "y", [None])]
    plain = F.col("t")
    assert finite_tree(plain, T.StringType()) is plain


def test_no_sink_writes_a_number_that_is_not_finite(spark, tmp_path):
    rows = spark.createDataFrame([("r", NAN, [(1.0, [INF, 2.0])])], "run_id string, t double, deep array<struct<x:double,y:array<double>>>")
    traces.write_events(rows, str(tmp_path / "out"))
    (line,) = [json.loads(x) for f in (tmp_path / "out").rglob("*.json") for x in f.read_text().splitlines()]
    assert line == {"t": None, "deep": [{"x": 1.0, "y": [None, 2.0]}]}


@pytest.mark.parametrize(
    "asked,want",
    [("a/b.h5", "a/b.h5"), ("./a//b.h5", "a/b.h5"), ("a/../b.h5", "b.h5"), ("../x.h5", None), ("../set/b.h5", "b.h5"), ("a/../../../../../etc/b.h5", None), ("/data/set/b.h5", None), ("", None), ("  ", None), (None, None), (".", None), ("..", None), ("out/b.h5", None), ("in/c.h5", "a/b/c.h5"), ("in/../c.h5", "a/c.h5"), ("out/../set/c.h5", "c.h5"), ("../setting/b.h5", None)],
)
def test_paths_stay_below_their_folder(spark, asked, want):
    links = F.create_map(F.lit("/data/set/out"), F.lit("/data/other"), F.lit("/data/set/in"), F.lit("/data/set/a/b"))
    for root in ("/data/set", "/data/./x/../set/"):
        assert value(spark, paths.contained(F.lit(root), F.lit(asked).cast("string"), links)) == want


def test_choices_name_their_first_fault(spark):
    good = ["/d", "a/b.h5", "action", "full", 1.0, "Absolute"]
    cases = [(None, None, None), (1, None, "no path"), (1, "/d/b.h5", "absolute path"), (1, "../b.h5", "outside the folder"), (1, "a/b.txt", "no episode file"), (1, ".h5", "no episode file"), (2, "sensor", "source"), (3, "legs", "mode"), (4, 2.5, "speed"), (4, NAN, "speed"), (4, None, "speed"), (5, "delta", "actions are not absolute"), (5, None, "actions are not absolute")]
    for place, to, want in cases:
        row = [to if k == place else v for k, v in enumerate(good)]
        assert value(spark, paths.choice_fault(*[F.lit(v) if not isinstance(v, str) and v is not None else F.lit(v).cast("double" if k == 4 else "string") for k, v in enumerate(row)])) == want
    assert value(spark, paths.choice_fault(F.lit("/d"), F.lit("b.hdf5"), F.lit("state"), F.lit("arms"), F.lit(0.5), F.lit("delta"))) is None


def test_targets_are_gated_on_the_axes_of_their_mode(spark):
    rest = [0.0] * 23
    at = lambda k, x: [x if i == k else 0.0 for i in range(23)]
    cases = [
        ("arms", rest, rest, None), ("full", at(22, 0.3), rest, None), ("arms", at(22, 0.3), rest, "base"), ("arms_lift", at(21, -0.1), rest, "base"), ("arms", at(16, -1.0), rest, None), ("arms_lift", at(16, -1.0), rest, "lift"), ("full", at(20, 0.8), rest, "head_pitch"), ("arms_lift", at(20, 0.8), rest, None),
        ("arms", [9.0] * 23, rest, dims.AXIS_NAMES[0]), ("arms", at(15, 1.6), rest, "right_gripper"), ("arms", rest[:22], rest, "width"), ("arms", rest, None, "width"), ("arms", at(18, NAN), rest, "not finite"), ("arms", rest, at(3, INF), "not finite"), ("legs", rest, rest, "mode"), (None, rest, rest, "mode"),
    ]
    rows = spark.createDataFrame([(k, m, a, s) for k, (m, a, s, _) in enumerate(cases)], "n int, mode string, action array<double>, state array<double>")
    got = policy.policy_targets(rows, "mode").orderBy("n").collect()
    assert [r.error for r in got] == [e for *_, e in cases] and got[0].asDict().keys() == {"n", "mode", "action", "state", "error"}


def test_grippers_move_no_further_than_they_may(spark):
    lit = lambda v: F.lit(v).cast("double")
    gate = lambda start, position, delta, flag=0: value(spark, policy.gripper_fault(lit(start), lit(position), lit(delta), 0.5, F.lit(flag)))
    assert [gate(1.0, 1.2, 9.0), gate(1.0, None, -0.5), gate(1.0, 1.6, None), gate(1.0, None, None), gate(1.0, 0.4, None), gate(None, 1.0, None), gate(NAN, 1.0, None), gate(1.0, 1.0, None, 4), gate(1.0, 1.0, None, None)] == [None, None, "target", "target", "way", "feedback", "feedback", "fault flag", "fault flag"]


def test_ring_and_span_bound_a_rate_in_batch_and_stream(spark, run):  # noqa: F811
    rng = np.random.default_rng(3)
    rows = [{"cam": c, "seq": k, "t": float(t)} for c, times in (("a", np.sort(rng.integers(0, 40, 120)) / 4), ("b", [0.0]), ("c", [1.0, 1.0, 9.0])) for k, t in enumerate(times)]
    want = {}
    for cam in "abc":
        own = [r for r in rows if r["cam"] == cam]
        for k, r in enumerate(own):
            recent = [x["t"] for x in own[max(0, k - 5) : k + 1] if r["t"] - x["t"] <= 2]
            want[cam, k] = (len(recent) - 1) / (recent[-1] - recent[0]) if recent[-1] > recent[0] else 0.0
    batch = health.trailing_rate(spark.createDataFrame(rows, "cam string, seq long, t double"), ["cam"], "t", 2, 6, ["seq"]).collect()
    assert {(r.cam, r.seq): r.rate for r in batch} == pytest.approx(want)
    stream = run("cam string, seq long, t double", [rows[:50], rows[50:70], rows[70:]], lambda s: stateful.trailing_rates(s, "cam", "seq", "t", 2.0, 6))
    assert {(r.cam, r.seq): r.rate for r in stream} == pytest.approx(want)


def put_together(parts):
    out, at = b"", 0
    for start, pcm in sorted(parts):
        assert start == at
        out, at = out + bytes(pcm), at + len(pcm) // 2
    return out


@pytest.mark.parametrize("rate,to", [(48_000, 16_000), (44_100, 16_000), (8_000, 24_000), (3, 7)])
def test_any_cutting_of_a_signal_gives_the_samples_of_one_block(spark, run, rate, to):  # noqa: F811
    rng = np.random.default_rng(rate)
    signal = (rng.standard_normal(500) * 0.8).astype(np.float32)
    signal[[3, 40]] = [1.5, -1.5]
    _, whole = audio.resampled_part(signal, 0, rate, to, len(signal))
    place = np.arange(len(whole)) * rate / to
    straight = np.interp(place, np.arange(len(signal)), signal.astype(float)).clip(-1, 1)
    assert len(whole) == math.ceil((len(signal) - 1) * to / rate) and np.abs(whole / np.where(whole < 0, 32768, 32767) - straight).max() < 1 / 32767 + 1e-9
    cuts = [0, *np.sort(rng.integers(0, 500, 12)).tolist(), 1, 2, 500]
    cuts.sort()
    blocks = [{"key": "s", "seq": k, "samples": signal[a:b].tolist()} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = spark.createDataFrame([*blocks, {"key": "none", "seq": 0, "samples": []}, {"key": "none", "seq": 1, "samples": None}], "key string, seq long, samples array<float>")
    batch = audio.resample_blocks(rows, ["key"], ["seq"], "samples", rate, to).collect()
    assert {r.key for r in batch} == {"s"} and put_together((r.start, r.pcm) for r in batch) == whole.tobytes()
    stream = run("key string, seq long, samples array<float>", [blocks[:4], blocks[4:9], blocks[9:]], lambda s: stateful.resampled_stream(s, "key", "seq", "samples", rate, to))
    assert put_together((r.start, r.pcm) for r in stream) == whole.tobytes()


def test_a_null_block_ends_a_signal(spark, run):  # noqa: F811
    rows = [{"key": "s", "seq": k, "samples": x} for k, x in enumerate([[0.1, 0.2, 0.3], None, [0.5, 0.25], []])]
    got = run("key string, seq long, samples array<float>", [rows[:2], rows[2:]], lambda s: stateful.resampled_stream(s, "key", "seq", "samples", 1, 1))
    assert sorted((r.start, len(r.pcm)) for r in got) == [(0, 2), (0, 4)]


def episode_table(n=4, **broken):
    part = lambda w: [[0.1] * w for _ in range(n)]
    whole = {s: {p: part(w) for p, w in episodes.WIDTHS.items()} | {"base": [[0.0, -0.25]] * n} for s in ("state", "action")}
    for s, parts in broken.items():
        whole[s].update(parts)
    return pa.table({s: pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.float64())) for v in parts.values()], list(parts)) for s, parts in whole.items()})


def test_a_scan_turns_broken_files_into_rows(spark, tmp_path):
    def put(name, table, **meta):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(table.replace_schema_metadata({k: str(v) for k, v in meta.items()}), tmp_path / name)

    good = episode_table()
    aligned = pa.table({"action": pa.StructArray.from_arrays([pa.array([[0.0] * 22 + [0.5]] * 3)], ["vector"])})
    put("a/good.parquet", good, control_frequency=50, action_mode="absolute")
    put("a/timed.parquet", good.append_column("t", pa.array([1_700_000_000_000.0, 1_700_000_000_100.0, 1_700_000_000_100.0, 1_700_000_002_000.0])), rate_hz=10)
    put("a/half.parquet", episode_table(state={"arm": [[0.0] * 13] * 4}))
    put("a/aligned.parquet", aligned, fps=20)
    put("b/backward.parquet", good.append_column("t", pa.array([3.0, 2.0, 4.0, 5.0])))
    put("b/both.parquet", episode_table(state={"waist": [[0.0] * 3, None, [0.0] * 3, [0.0] * 3]}, action={"base": [[NAN, 0.0]] * 4}))
    put("b/none.parquet", good.slice(0, 0))
    put("b/other.parquet", pa.table({"x": [1]}))
    put("b/rate.parquet", good, control_frequency="fast")
    put("b/high.parquet", good, control_frequency=501)
    put(".hidden/good.parquet", good)
    (tmp_path / "b/broken.parquet").write_bytes(b"PAR1 and no more")
    (tmp_path / "b/empty.h5").write_bytes(b"")
    (tmp_path / "b/notes.txt").write_text("no episode")
    found = {r.path.rsplit("/", 1)[1]: r for r in episodes.scan_episodes(spark, str(tmp_path)).collect()}
    assert len(found) == 12 and {n for n, r in found.items() if r.error is None} == {"good.parquet", "timed.parquet", "half.parquet", "aligned.parquet"}
    r = found["good.parquet"]
    assert (r.format, r.frames, r.rate_hz, r.duration_s, r.basis, r.action_mode, r.sources["state"].base_abs_max) == ("episode", 4, 50.0, 0.08, "nominal_rate", "absolute", 0.25)
    assert (found["timed.parquet"].duration_s, found["timed.parquet"].basis, found["timed.parquet"].rate_hz) == (pytest.approx(2.0), "timestamp", 10.0)
    assert (found["half.parquet"].sources["state"].valid, found["half.parquet"].sources["state"].error, found["half.parquet"].sources["action"].frames) == (False, "state.arm is not 14 wide", 4)
    assert (found["aligned.parquet"].format, found["aligned.parquet"].rate_hz, found["aligned.parquet"].sources["action"].base_abs_max, found["aligned.parquet"].sources["state"].error) == ("aligned", 20.0, 0.5, "no state")
    want = {"backward.parquet": "times are not finite or run backward", "both.parquet": "action: action.base is not finite; state: state.waist is not 3 wide", "none.parquet": "action: no frames; state: no frames", "other.parquet": "action: no action; state: no state", "rate.parquet": "rate is no number", "high.parquet": "rate out of range"}
    assert {n: found[n].error for n in want} == want and found["broken.parquet"].error.startswith("cannot be read") and found["empty.h5"].error == "empty file"
    valid, invalid = episodes.scan_report(episodes.scan_episodes(spark, str(tmp_path)))
    assert (valid.count(), invalid.count(), invalid.columns) == (4, 8, ["path", "error"])
    with pytest.raises(ValueError, match="more than 3"):
        episodes.scan_episodes(spark, str(tmp_path), most=3)


def test_listings_say_that_they_are_cut_and_folders_hold_named_files(spark, tmp_path):
    for name in ("x/episode.h5", "x/states/aligned_joints.h5", "y/episode.hdf5", ".z/episode.h5", "w/other.h5"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    files = episodes.list_files(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.truncated) for r in files.collect()] == [("other.h5", False), ("episode.h5", False), ("aligned_joints.h5", False), ("episode.hdf5", False)]
    assert [r.truncated for r in episodes.list_files(spark, str(tmp_path), most=2).collect()] == [True, True]
    assert [(r.folder.rsplit("/", 1)[1], r.truncated) for r in episodes.dataset_folders(files).collect()] == [("x", False), ("y", False)]
    assert [r.truncated for r in episodes.dataset_folders(files, 1).collect()] == [True]


def test_parts_of_a_source_are_as_wide_and_as_long_as_they_must(spark):
    def fault(**changed):
        parts = {k: [[0.5] * w] * 3 for k, w in episodes.WIDTHS.items()} | changed
        rows = spark.createDataFrame([tuple(parts.values())], ", ".join(f"{k} array<array<double>>" for k in parts))
        return rows.select(episodes.shape_fault({k: F.col(k) for k in parts}).alias("f")).first().f

    assert [fault(), fault(head=None), fault(arm=[]), fault(waist=[[0.0] * 3, [0.0] * 2, [0.0] * 3]), fault(waist=[[0.0] * 3, None, [0.0] * 3]), fault(base=[[0.0] * 2] * 4)] == [None, "head: no frames", "arm: no frames", "waist: width", "waist: width", "base: length"]


def test_runs_have_folders_of_their_own(spark):
    folder = lambda run: value(spark, traces.run_folder(F.lit("/runs"), F.lit(run).cast("string")))
    assert [folder("20260831_120000_0a1b2c3d"), folder("../20260831_120000_0a1b2c3d"), folder("20260831_120000_0A1B2C3D"), folder(None)] == ["20260831_120000_0a1b2c3d", None, None, None]


def test_episodes_are_described_and_counted(spark):
    rows = spark.createDataFrame([("e", k * 0.5, [0.0] * 21 + [0.0, -0.25 * k]) for k in range(3)] + [("f", 0.0, [0.0] * 23)], "ep string, t double, v array<double>")
    timed = {r.ep: r for r in episodes.inspect(rows, ["ep"], "v", "t").collect()}
    assert (timed["e"].frames, timed["e"].duration_s, timed["e"].base_abs_max, timed["e"].base_rests, timed["e"].basis, timed["f"].base_rests) == (3, 1.0, 0.5, False, "timestamp", True)
    plain = {r.ep: r for r in episodes.inspect(rows, ["ep"], "v", rate=F.lit(20.0)).collect()}
    assert (plain["e"].duration_s, plain["e"].rate, plain["e"].basis) == (pytest.approx(0.15), 20.0, "nominal_rate")
    assert tuple(episodes.valid_and_invalid(spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "p string, error string")).first()) == (2, 1)


def test_corrections_are_folded_in_the_order_of_their_table(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"ab": "b", "b": "ccc", "": "x", "cccc": "d"}', encoding="utf-8")
    pairs = rewrite.read_corrections(spark, str(tmp_path / "c.json"))
    rows = spark.createDataFrame([(1, " abc "), (2, None), (3, ""), (4, "bb ab")], "n int, text string")
    assert [r.text for r in rewrite.correct_from(rows, "text", pairs).orderBy("n").collect()] == ["d", None, "", "cccccc ccc".replace("cccc", "d", 1)]
    back = spark.createDataFrame([(2, "ab", "b"), (1, "b", None), (3, None, "y")], "place int, source string, replacement string")
    assert [r.text for r in rewrite.correct_from(rows, "text", back).orderBy("n").collect()] == ["ac", None, "", "a"]
    assert [r.text for r in rewrite.correct_from(rows, "text", back.limit(0)).orderBy("n").collect()] == ["abc", None, "", "bb ab"]


def test_cameras_are_found_by_their_names_and_missed_if_expected(spark):
    ddl = "camera string, streams array<struct<type:string,width:int>>"
    rows = [(" top/cam_high ", [("color", 1), ("RGB", 2), ("Depth", 3), ("infra", 4)]), ("cam_left_wrist", [("rgb", 5)]), ("", [("rgb", 6)]), ("side", [("infra", 7)]), (None, [("rgb", 8)]), ("spare", None), ("odd", [("depth", 9), (None, 1)])]
    found = cameras.discover(spark.createDataFrame(rows, ddl))
    assert sorted((r.camera, r.logical or "", r.kind, r.stream.width) for r in found.collect()) == [("cam_left_wrist", "left_wrist", "rgb", 5), ("odd", "", "depth", 9), ("top/cam_high", "head", "depth", 3), ("top/cam_high", "head", "rgb", 2)]
    assert {r.alias: r.camera for r in cameras.aliases(found).collect()} == {"top/cam_high": "top/cam_high", "cam_high": "top/cam_high", "head": "top/cam_high", "cam_left_wrist": "cam_left_wrist", "left_wrist": "cam_left_wrist", "odd": "odd"}
    assert sorted((r.logical, r.kind or "") for r in cameras.absent(found).collect()) == [("left_wrist", "depth"), ("right_wrist", "")]
    shallow = cameras.discover(spark.createDataFrame(rows, ddl), depth=False)
    assert {r.kind for r in shallow.collect()} == {"rgb"} and [(r.logical, r.kind) for r in cameras.absent(shallow, depth=False).collect()] == [("right_wrist", None)]


def test_small_rules_have_their_values(spark):
    assert value(spark, vectors.finite_items_or_null(F.lit([1.0, NAN, INF]))) == [1.0, None, None]
    point = value(spark, vectors.back_project(F.lit(420.0), F.lit(140.0), F.lit(2.0), 500.0, 400.0, 320.0, 240.0))
    assert tuple(point) == pytest.approx((0.4, -0.5, 2.0))
    gate = lambda d, a: value(spark, checks.pose_gate(F.lit(d), F.lit(a), 0.1, 0.5))
    assert [gate(0.1, 0.5), gate(0.11, 0.1), gate(0.05, 0.6), gate(NAN, 0.1)] == [True, False, False, False]
    for same in (correlate.same_plan, checks.coherent):
        assert [value(spark, same(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("x", "x"), ("x", "y"), (None, None), ("x", None))] == [True, False, True, False]
    assert value(spark, checks.task_prompt(F.lit("cup"), F.lit("left"))) == "Grasp cup with the left hand"
    assert json.loads(value(spark, protocol.envelope(a=F.lit(1), b=F.lit(None).cast("string"), c=F.lit(True)))) == {"a": 1, "c": True}
    motors = spark.createDataFrame([(3, None, None, None, None, 0.0), (4, "k", "l", "g", "u", 0.5)], "id int, key string, label string, group string, unit string, step double")
    assert [tuple(r) for r in checks.motor_defaults(motors).orderBy("id").collect()] == [(3, "motor_3", "motor 3", "", "", None), (4, "k", "l", "g", "u", 0.5)]
    messages = spark.createDataFrame([("c", 1, "assistant", None), ("c", 2, "user", None), ("c", 3, "assistant", b"1"), ("c", 4, "user", None), ("d", 1, "user", None)], "conv string, turn int, role string, audio binary")
    sounds = spark.createDataFrame([("c", b"9"), ("d", b"8")], "conv string, sound binary")
    got = correlate.attach_to_newest(messages, sounds, ["conv"], "turn", (F.col("role") == "assistant") & F.col("audio").isNull()).collect()
    assert sorted((r.conv, r.turn) for r in got) == [("c", 1), ("d", None)]
    actions = F.lit([[float(k)] for k in range(5)])
    assert value(spark, vectors.prefix(actions, 3)) == [[0.0], [1.0], [2.0]] and value(spark, vectors.prefix(actions, 9))[-1] == [4.0]
    assert [value(spark, vectors.suffix(actions, F.lit(k))) for k in (3, 5)] == [[[3.0], [4.0]], []]


def test_the_unit_of_times_hangs_on_their_median(spark):
    cases = {"odd": [0.0, 1e12, 2e12], "low": [0.0, 1.0, 2e12], "even": [9.9e10, 1.02e11], "even_low": [9.7e10, 1.02e11], "plain": [5.0, 6.5], "one": [3e12]}
    rows = spark.createDataFrame([(k, n, t) for k, times in cases.items() for n, t in enumerate(times)], "ep string, n int, t double")
    got = {(r.ep, r.n): r.elapsed for r in timeline.elapsed(rows, ["ep"], ["n"], "t").collect()}
    for ep, times in cases.items():
        unit = 1000.0 if np.median(times) > 1e11 else 1.0
        assert [got[ep, k] for k in range(len(times))] == [(t - times[0]) / unit for t in times]


def test_decimals_follow_the_step(spark):
    for step, want in ((1.0, "1234.57"), (0.01, "1234.57"), (0.001, "1234.568"), (0.0001, "1234.5679"), (0.5, "1234.57"), (0.00001, "1234.5679")):
        assert value(spark, text.decimals(F.lit(1234.56789), F.lit(step))) == want
