import json

import pytest
from pyspark.sql import functions as F

from kinetrace.operators import health
from kinetrace.sources.audio import frames_of
from kinetrace.streaming import stateful


@pytest.fixture
def run(spark, tmp_path):
    """Rows of several micro-batches, in the order given, through a streaming operator."""

    def go(schema, batches, make, mode="append"):
        folder = tmp_path / "in"
        folder.mkdir()
        import os

        for k, rows in enumerate(batches):
            path = folder / f"{k}.json"
            path.write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        name = f"out_{tmp_path.name}".replace("-", "_")
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.table(name).collect()

    return go


def test_adjacent_repeats_match_the_batch_form(spark, run):
    rows = [{"cam": c, "seq": k, "stamp": s} for k, (c, s) in enumerate([("a", 1.0), ("a", 1.0), ("b", 1.0), ("a", 2.0), ("a", 1.0), ("b", 1.0), ("a", 1.0), ("b", 3.0)])]
    got = run("cam string, seq long, stamp double", [rows[:2], rows[2:5], rows[5:]], lambda s: stateful.drop_adjacent_repeats(s, "cam", "seq", "stamp"))
    marked = health.mark_repeats(spark.createDataFrame(rows, "cam string, seq long, stamp double"), ["cam"], ["seq"], "stamp").filter("not repeat")
    assert sorted((r.cam, r.seq) for r in got) == sorted((r.cam, r.seq) for r in marked.collect())
    last = max((r for r in got if r.cam == "a"), key=lambda r: r.seq)
    assert (last.polls, last.repeats) == (4, 1)


def test_latest_value_of_each_key(run):
    rows = [{"k": "a", "seq": 1, "v": 1.0}, {"k": "b", "seq": 2, "v": 5.0}, {"k": "a", "seq": 3, "v": 2.0}]
    got = run("k string, seq long, v double", [rows[:2], rows[2:]], lambda s: stateful.latest_values(s, "k", "seq"), "complete")
    assert sorted((r.k, r.v) for r in got) == [("a", 2.0), ("b", 5.0)]


def test_phrases_across_batches(run):
    rows = [{"c": 1, "seq": k, "d": d} for k, d in enumerate(["你好，我是小达。今", "天想聊什么", None])]
    got = run("c long, seq long, d string", [[r] for r in rows], lambda s: stateful.phrases_of_deltas(s, "c", "seq", "d", 4, 20))
    assert [r.phrase for r in got] == ["你好，我是小达。", "今天想聊什么"]


def test_blocks_end_once_and_match_the_batch_form(spark, run):
    texts = ["abcde", "fghijklm", "no", None, "late", None]
    rows = [{"c": 1, "seq": k, "p": t} for k, t in enumerate(texts)]
    got = run("c long, seq long, p string", [rows[:2], rows[2:4], rows[4:]], lambda s: stateful.full_blocks(s.withColumn("p", F.col("p").cast("binary")), "c", "seq", "p", 4))
    whole = spark.createDataFrame([(b"abcdefghijklmno",)], "p binary").select(frames_of(F.col("p"), 4).alias("f")).first().f
    assert [bytes(r.block) for r in got] == [bytes(x) for x in whole]


def test_stale_generations_go(run):
    rows = [{"s": "x", "seq": k, "g": g} for k, g in enumerate([1, 2, 1, 2, 3, 2])]
    got = run("s string, seq long, g long", [rows[:3], rows[3:]], lambda s: stateful.current_only(s, "s", "seq", "g"))
    assert sorted(r.seq for r in got) == [0, 1, 3, 4]
