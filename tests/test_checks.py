from pyspark.sql import functions as F

from kinetrace.functions import checks, clock
from kinetrace.operators import correlate, dialogue


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rules(spark):
    assert value(spark, checks.image_error(F.lit("rgb"), F.lit("uint8"), F.lit(640), F.lit(480), F.lit(3))) is None
    assert value(spark, checks.image_error(F.lit("depth"), F.lit("uint8"), F.lit(640), F.lit(480), F.lit(None).cast("int"))) == "type"
    none = F.lit(None).cast("string")
    assert value(spark, checks.plan_errors(F.lit("single"), F.lit("arms"), F.lit("left"), F.lit("pick with the left hand"), none)) == []
    assert value(spark, checks.plan_errors(F.lit("dual_continuous"), F.lit("full"), none, F.lit("pick"), none)) == []
    assert value(spark, checks.plan_errors(F.lit("single"), F.lit("arms"), F.lit("left"), F.lit("left or right"), none)) == ["prompt and hand"]
    assert value(spark, checks.plan_errors(F.lit("dual_separate"), F.lit("arms"), none, F.lit("the left"), F.lit("the right"))) == []
    assert value(spark, checks.plan_errors(F.lit("dual_separate"), F.lit("arms"), none, F.lit("the left"), F.lit(" "))) == ["right prompt", "left and then right"]
    assert "full needs one prompt" in value(spark, checks.plan_errors(F.lit("dual_separate"), F.lit("full"), none, F.lit("pick"), F.lit("place")))
    assert value(spark, checks.source_error(F.lit(True), F.lit(0.1), F.lit("full"))) == "base moves" and value(spark, checks.source_error(F.lit(True), F.lit(0.1), F.lit("arms"))) is None
    assert value(spark, checks.setting_errors({"trigger_index": F.lit(20.5), "warmup_timeout_s": F.lit(0.0)})) == ["trigger_index", "warmup_timeout_s"]
    assert value(spark, checks.motor_valid(F.lit(2.0), F.lit(0.0), F.lit(0.0))) is False
    assert value(spark, checks.tracking_error(F.lit([1.0, 2.0]), F.lit([0.5, 2.5]))) == [0.5, -0.5]
    assert value(spark, checks.progress(F.lit(3), F.lit(0))) == 0


def test_clocks(spark):
    assert value(spark, clock.next_tick(F.lit(100.01), F.lit(100.013), 0.01)) > 100.019
    assert abs(value(spark, clock.next_tick(F.lit(100.02), F.lit(100.058), 0.01)) - 100.06) < 1e-9
    assert value(spark, clock.tick(F.lit(1.0), F.lit(2.0), 30)) == 0
    assert value(spark, clock.age_ms(F.lit(1.0), F.lit(2.0))) == 0


def test_alias_and_audio_matching(spark):
    aliases = spark.createDataFrame([("front", "head_left"), ("wrist", "wrist_left")], "alias string, name string")
    present = spark.createDataFrame([("head_left",)], "name string")
    rows = spark.createDataFrame([("front",), ("wrist",), ("odd",)], "camera string")
    got = {r.camera: r.status for r in correlate.resolve_alias(rows, aliases, present, "camera").collect()}
    assert got == {"front": "present", "wrist": "absent", "odd": "unknown"}
    messages = spark.createDataFrame([("c", 0, "user", False), ("c", 1, "assistant", False), ("c", 3, "assistant", True)], "conv string, turn int, role string, spoken boolean")
    audio = spark.createDataFrame([("c", b"x"), ("d", b"y")], "conv string, pcm binary")
    out = correlate.attach_to_newest(messages, audio, ["conv"], "turn", (F.col("role") == "assistant") & ~F.col("spoken")).collect()
    assert {r.conv: r.turn for r in out} == {"c": 1, "d": None}
    events = spark.createDataFrame([("u", "start", 1.0, 0), ("u", "partial", 1.4, 0), ("u", "final", 2.0, 0), ("u", "audio", 2.1, 48000)], "utterance string, kind string, t double, size int")
    m = dialogue.speech_metrics(events, ["utterance"], "kind", "t", "size").first()
    assert (round(m.first_partial_ms), round(m.final_ms), m.audio_ms) == (400, 1000, 1000)
