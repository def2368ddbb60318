import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import protocol, vectors
from kinetrace.operators import control, dialogue, health, timeline
from kinetrace.plans import dims
from kinetrace.sources import audio, episodes, traces


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_vectors(spark):
    lit = lambda *x: F.lit(list(map(float, x)))
    assert value(spark, vectors.quaternion_angle(lit(0, 0, 0, 1), lit(0, 0, 0, -1))) == 0
    half = 2**-0.5
    assert value(spark, vectors.quaternion_angle(lit(0, 0, 0, 1), lit(0, 0, half, half))) == pytest.approx(np.pi / 2)
    assert not value(spark, vectors.unit_quaternion(lit(0, 0, 0, 2))) and not value(spark, vectors.unit_quaternion(lit(0, 0, 0, float("nan"))))
    assert value(spark, vectors.decode_bits(F.lit(0b1001), list(dims.FAULT_BITS))) == ["disconnected", "overheat"]
    for x, ok in ((0.5, True), (0.0, False), (1.5, False), (float("nan"), False)):
        assert value(spark, vectors.within(F.lit(x), 0.0, 1.5, 0.02)) is ok
    for x, ok in ((0.0, True), (0.8, True), (-0.001, False), (0.801, False)):
        assert value(spark, vectors.within(F.lit(x), 0.0, 0.8)) is ok
    wheels = value(spark, vectors.wheel_speeds(F.lit(0.5), F.lit(0.2), 0.0835, 0.379))
    assert wheels.left == pytest.approx((0.5 - 0.2 * 0.379 / 2) / 0.0835)
    assert value(spark, vectors.snap(F.lit(5e-8), F.lit(0.0), F.lit(1.0))) == 0
    assert value(spark, vectors.depth_shade(F.lit(6000))) == 180 and value(spark, vectors.depth_shade(F.lit(65535))) == 0


def episode(spark, times, columns):
    return spark.createDataFrame([("e", k, float(t), *map(float, c)) for k, (t, c) in enumerate(zip(times, columns, strict=True))], "ep string, frame long, t double, held double, value double")


def test_resampling_and_diagnostics(spark):
    t = [0, 1 / 30, 6 / 30, 7 / 30]
    rows = episode(spark, t, [(0, t[0]), (0, t[1]), (1, t[2]), (1, t[3])])
    got = timeline.resample(rows, ["ep"], ["frame"], "t", ["held"], ["value"], 30.0).orderBy("step").collect()
    assert [r.held for r in got] == [0, 0, 0, 0, 0, 0, 1, 1] and np.allclose([r.value for r in got], np.arange(8) / 30)
    d = timeline.diagnostics(rows, ["ep"], ["frame"], "t", 30.0).first()
    assert (d.frames, d.gaps, d.duplicates, d.valid) == (4, 1, 0, True)
    rng = np.random.default_rng(2)
    t = np.sort(rng.random(30))
    x = rng.random(30)
    got = timeline.resample(episode(spark, t, list(zip(x, x, strict=True))), ["ep"], ["frame"], "t", ["held"], ["value"], 97.0).orderBy("step").collect()
    n = max(1, round((t[-1] - t[0]) * 97))
    grid = np.linspace(t[0], t[-1], n + 1)
    assert np.allclose([r.value for r in got], np.interp(grid, t, x), atol=1e-12) and len(got) == n + 1
    same = episode(spark, [0, 0, 0.1, 0.2], [(k, k) for k in (1, 2, 3, 4)])
    kept = timeline.keep_last_of_equal(same, ["ep"], ["frame"], "t").orderBy("frame").collect()
    assert [r.value for r in kept] == [2, 3, 4]
    assert not timeline.diagnostics(episode(spark, [0, 0.1, 0.09, 0.2], [(0, 0)] * 4), ["ep"], ["frame"], "t", 30.0).first().valid
    assert len(timeline.resample(episode(spark, [10], [(3, 4)]), ["ep"], ["frame"], "t", ["held"], ["value"], 30.0).collect()) == 1
    long = episode(spark, [0, 10_000], [(0, 0)] * 2)
    assert timeline.resample(long, ["ep"], ["frame"], "t", ["held"], ["value"], 30.0).count() == 300_001
    with pytest.raises(Exception, match="more than 1000 frames"):
        timeline.resample(long, ["ep"], ["frame"], "t", ["held"], ["value"], 30.0, 1000).collect()
    ms = episode(spark, [1788921000000, 1788921000033, 1788921000200], [(0, 0)] * 3)
    assert timeline.diagnostics(ms, ["ep"], ["frame"], "t", 30.0).first().duration_s == pytest.approx(0.2)


def test_control(spark):
    rng = np.random.default_rng(1)
    runs = [(k, rng.normal(size=23).cumsum().tolist()) for k in range(40)]
    rows = spark.createDataFrame([("r", k, v) for k, v in runs], "run string, k long, v array<double>")
    got = control.slew_limit_rows(rows, ["run"], ["k"], "v", dims.ARM_JOINTS, 0.2).orderBy("k").collect()
    last = np.array(runs[0][1])
    for r, (_, target) in zip(got, runs, strict=True):
        want = np.array(target)
        for a in dims.ARM_JOINTS:
            want[a] = last[a] + max(-0.2, min(0.2, want[a] - last[a]))
        assert np.allclose(r.limited, want)
        last = want
    short = value(spark, control.slew_limit(F.lit(0.0), F.lit([1.0, 0.1, -3.0]), 0.5))
    assert np.allclose(short, [0.5, 0.1, -0.4])
    delays = spark.createDataFrame([("a", 1, 27), ("a", 2, 3), ("b", 1, 0)], "g string, k long, steps long")
    assert [r.delay for r in control.rolling_delay(delays, ["g"], ["k"], "steps").orderBy("g", "k").collect()] == [28, 28, 6]
    assert not value(spark, control.schedule_fits(F.lit(28), F.lit(28), F.lit(0)))
    assert [value(spark, control.handoff(F.lit(100), F.lit(h))) for h in (106, 109, 150, 99)] == [6, 9, None, None]


def test_health_and_memory(spark):
    for p, fresh, ok in ((0.0, True, True), (100.0, True, True), (-1.0, True, False), (101.0, True, False), (float("nan"), True, False), (62.0, False, False)):
        assert (value(spark, health.battery(F.lit(p), F.lit(True), F.lit(fresh))) is not None) is ok
    rows = spark.createDataFrame([("c", k, "u", t) for k, t in enumerate("一二三")] + [("c", 9, "u", " 　")], "conv string, turn int, role string, text string")
    assert [r.text for r in dialogue.trim_memory(rows, ["conv"], ["turn"], "text", 1).orderBy("turn").collect()] == ["二", "三"]
    long = spark.createDataFrame([("c", k, "x" * n) for k, n in enumerate((9, 30, 5, 60))], "conv string, turn int, text string")
    assert [r.turn for r in dialogue.trim_memory(long, ["conv"], ["turn"], "text", 9, 40).orderBy("turn").collect()] == [2, 3]


def test_payloads(spark):
    assert value(spark, protocol.number_of(F.lit('{"k": 4.5e1}'), "k")) == 45
    for odd in ('{"k": true}', '{"k": "3"}', '{"k": null}', "{}", "no"):
        assert value(spark, protocol.number_of(F.lit(odd), "k")) is None
    flat = lambda s: value(spark, protocol.flatten_action(F.lit(s), {"a": 2, "b": 1}))
    assert flat('{"a": [1, 2.5], "b": [3]}') == [1, 2.5, 3]
    assert [flat(s) for s in ('{"a": [1, true], "b": [3]}', '{"a": [1, 2, 3], "b": [3]}', '{"a": [1, 2], "b": [3], "c": 1}', '{"a": ["1", 2], "b": [3]}', "{}")] == [None] * 5
    row = "[" + ",".join(["0.1"] * 23) + "]"
    reply = lambda n, flag: '{"is_success": %s, "actions": [%s]}' % (flag, ",".join([row] * n))
    assert len(value(spark, protocol.chunk_rows(F.lit(reply(50, "true"))))) == 50
    assert value(spark, protocol.chunk_rows(F.lit(reply(49, "true")))) is None and value(spark, protocol.chunk_rows(F.lit(reply(50, "1")))) is None
    assert value(spark, protocol.metadata_errors(F.lit('{"a": 1, "b": true, "c": "1"}'), {"a": 1, "b": 1, "c": 1})) == ["b", "c"]
    assert value(spark, protocol.allowed_command(F.lit('so {"command": "wave", "direct": true} ok'), ["wave"])) == "wave"
    assert value(spark, protocol.response_text(F.lit('{"output": [{"content": [{"type": "t", "text": "a"}, {"text": "b"}]}, {}]}'))) == "ab"


def test_traces_round_trip(spark, tmp_path):
    run = tmp_path / "20260101_000000_abcdef01"
    run.mkdir()
    (run / "metadata.json").write_text("{}")
    (run / "events.jsonl").write_text('{"kind": "state", "t": 0.5, "error": [0.5, null], "refresh_gap_ms": [3.5]}\nbroken\n{"kind": "step", "t": 1.0, "actions": [[1.0]]}\n')
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "metadata.json").write_text("{}")
    events = traces.read_events(spark, str(tmp_path))
    assert [(r.run_id, r.kind, r.t) for r in events.orderBy("line_no").collect()] == [(run.name, "state", 0.5), (run.name, "step", 1.0)]
    assert [r.run_id for r in traces.list_runs(spark, str(tmp_path)).collect()] == [run.name]
    traces.write_events(events, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and "torque" in back.columns
    from kinetrace.operators import trace

    cells = trace.axis_rows(events.filter("kind = 'state'"), ["error", "refresh_gap_ms"], ["run_id"])
    assert trace.error_summary(cells, ["axis"], F.col("error")).orderBy("axis").first().rmse == 0.5
    assert trace.run_summary(events).first().max_refresh_gap_ms == 3.5 and trace.shown_events(events).count() == 2
    traces.write_wide(trace.wide_samples(cells, ["run_id"], ["error"], [0, 1]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["run_id", "error.0", "error.1"]


def test_episodes(spark):
    vector = [*(k / 100 for k in range(16)), 0.8, *([0.0] * 6)]
    rows = spark.createDataFrame([("good", str(k), k / 20, vector) for k in range(12)] + [("gap", str(k), k / 20, vector) for k in (0, 2)] + [("nan", "0", 0.0, [float("nan")] * 23), ("far", "0", 0.0, [9.0] * 23)], "ep string, frame string, t double, v array<double>")
    errors = {r.ep: r.error for r in episodes.check_aligned(rows, ["ep"], "frame", "v").collect()}
    assert errors == {"good": None, "gap": "frame gap", "nan": "not finite", "far": None}
    assert {r.ep: r.axis_name for r in episodes.range_errors(rows, ["ep"], "v", "arms").collect()}["far"] == "left_shoulder_pitch"
    loaded = episodes.load_episode(rows, ["ep"], "frame", "v", "t", 20.0, "full")
    assert loaded.select("ep").distinct().collect()[0].ep == "good" and loaded.count() == 12 * 23
    parts = spark.createDataFrame([([k / 1000 for k in range(14)], [0.0, 1.5], [0.4, 0.1, -0.1], [0.2, -0.2], [0.0, 0.0])], "arm array<double>, effector array<double>, waist array<double>, head array<double>, base array<double>")
    got = episodes.frames_from_groups(parts.select(F.struct("*").alias("state")), "state").first().vector
    assert got == [*(k / 1000 for k in range(7)), 0.0, *(k / 1000 for k in range(7, 14)), 1.5, 0.4, 0.1, -0.1, 0.2, -0.2, 0.0, 0.0]


def test_audio(spark, tmp_path):
    import wave

    pcm = audio.floats_to_pcm(np.full(2400, 2.0, np.float32))
    x = np.frombuffer(pcm, "<i2")
    assert x[0] == x[-1] == 0 and x.max() <= 32767
    df = spark.createDataFrame([(pcm,), (None,)], "pcm binary")
    out = df.select(audio.frames_of(F.col("pcm"), 1000).alias("f"), audio.decode_pcm("pcm").alias("x"), audio.encode_pcm(audio.change_rate(audio.decode_pcm("pcm"), 24000, 16000)).alias("y")).collect()[0]
    assert b"".join(map(bytes, out.f)) == pcm and len(out.x) == 2400 and len(out.y) == 3200
    for name, rate in (("a.wav", 16000), ("b.wav", 8000)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0\1" * 10)
    got = {r.path[-5:]: (r.pcm, r.error) for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert bytes(got["a.wav"][0]) == b"\0\1" * 10 and got["b.wav"] == (None, "format")
    lines = spark.createDataFrame([('data: {"type": "response.output_text.delta", "delta": "x"}',), ("data: [DONE]",), ("",), ("event: y",)], "value string")
    assert [r.delta for r in audio.stream_deltas(lines).collect()] == ["x"]
    (tmp_path / "words.txt").write_text("one\n\n# no\n two \n")
    assert [r.word for r in audio.read_words(spark, str(tmp_path / "words.txt")).collect()] == ["one", "two"]
