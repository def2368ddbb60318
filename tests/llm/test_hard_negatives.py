import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinetrace.llm import blocks
from kinetrace.llm.hard_negatives import HIGHEST, LOWEST, hard_negatives, products

DDL = "vec_id long, embedding array<double>, label int, id long, uid string, none int"


def brute(rows, anchor, positives=5, negatives=5):
    held = [(k, i, [math.floor(256 * x) for x in v], lab) for k, (i, v, lab, *_) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, lab in held:
        if not anchor(i):
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), LOWEST), HIGHEST), j is None, j or 0, m, j, other) for m, j, w, other in held if m != k and len(w) == len(v)]
        for s, _, _, _, p, _ in sorted(x for x in scored if x[5] == lab)[:positives]:
            window = sorted(x for x in scored if x[5] != lab and -80 * s <= -100 * x[0] <= -100 * s)[:negatives]
            out += [(i, p, r, x[4], -s, -x[0]) for r, x in enumerate(window, 1)]
    return out


def key(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_equals_all_pairs_with_ties_repeats_nulls_and_other_lengths(spark, monkeypatch):
    rng = random.Random(5)
    vector = lambda d=6: [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0, 0.999]) for _ in range(d)]
    rows = [(k, vector(), rng.choice([1, 1, 1, 2, 3])) for k in range(300)]
    rows += [(k, rows[7][1], 1) for k in range(300, 420)]  # a hot vector
    rows += [(10, vector(), 1), (10, rows[10][1], 2), (None, vector(), 1), (None, vector(), 2), (20, None, 1), (30, vector(), None), (40, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (50, [1.0, float("nan")], 1), (60, [float("inf")] * 6, 2), (70, [], 1), (80, [], 1), (90, [], 3)]
    rows += [(k, vector(3), k % 2) for k in range(1000, 1040)]
    rows = [(*r, k, "x", 5) for k, r in enumerate(rows)]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    for sent in (blocks.SENT_BYTES, 1500):
        monkeypatch.setattr(blocks, "SENT_BYTES", sent)
        got = hard_negatives(spark.createDataFrame(rows, DDL), F.col("vec_id") % 10 == 0).collect()
        assert key(got) == key(brute(rows, lambda i: i is not None and i % 10 == 0))


def test_large_components_are_multiplied_exactly_and_end_at_the_range_of_a_long(spark):
    rows = [(0, [2.0**30 + 0.5, 3.0], 1), (1, [2.0**31 + 1, 1.0], 1), (2, [2.0**31, 1.0], 2), (3, [2.0**30 * 1.7, 7.0], 2), (100, [1e300, 1.0], 1), (101, [1e300, 2.0], 1), (102, [1e300, 2.0], 2)]
    rows = [(*r, 0, "", 0) for r in rows]
    got = hard_negatives(spark.createDataFrame(rows, DDL), F.col("vec_id") % 100 == 0).collect()
    assert key(got) == key(brute(rows, lambda i: i % 100 == 0))
    a = np.array([[2.0**27, 1.0], [3.0, -5.0]])
    assert products(a, a).tolist() == [[2**54 + 1, 3 * 2**27 - 5], [3 * 2**27 - 5, 34]]


def test_tables_without_anchors_or_rows(spark):
    one = spark.createDataFrame([(100, [1.0], 1, 0, "", 0)], DDL)
    for rows in (one, one.limit(0), one.withColumn("vec_id", F.lit(7))):
        assert hard_negatives(rows, F.col("vec_id") % 100 == 0).count() == 0
