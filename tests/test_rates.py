import random

import pytest

from kinetrace.operators import health


@pytest.mark.parametrize("most", [None, 5])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_rates_across_slots_of_time_equal_a_plain_count(spark, most, kind):
    r = random.Random(3)
    times = [r.randint(-60, 60) + r.choice([0, 0, 7, 14]) for _ in range(300)] + [None, None]
    rows = [(k % 3, k, t if t is None else (t if kind == "long" else t * 0.5)) for k, t in enumerate(times)]
    span = 14 if kind == "long" else 7
    want = {}
    for key in range(3):
        own = sorted((x for x in rows if x[0] == key and x[2] is not None), key=lambda x: (x[2], x[1]))
        for place, (_, k, t) in enumerate(own):
            held = [x[2] for x in (own if most is None else own[max(0, place + 1 - most) : place + 1]) if t - span <= x[2] <= t]
            want[k] = (len(held) - 1) / (t - held[0]) if t > held[0] else 0.0
    frame = spark.createDataFrame(rows, f"key int, seq long, t {kind}")
    got = {x.seq: x.rate for x in health.trailing_rate(frame, ["key"], "t", span, most, ["seq"] if most else None).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if k < 300} == pytest.approx(want)


def test_no_frame_slides_over_the_rows_of_a_span(spark):
    frame = spark.createDataFrame([(1, 1, 1)], "key int, seq long, t long")
    for most in (None, 5):
        plan = health.trailing_rate(frame, ["key"], "t", 14, most, ["seq"])._jdf.queryExecution().executedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, -" not in plan and "-14" not in plan and "specifiedwindowframe(RowFrame, -4, currentrow" not in plan
