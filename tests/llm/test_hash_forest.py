import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import blocks, hash_forest
from kinetrace.llm.hash_forest import GRID, SLOTS, SYMBOLS, nearest, strings, symbol_chances

DDL = "vec_id long, embedding array<double>, score double, uid string, rank int"


def brute(rows, query, most):
    """(query row, found rows) by exact products; rows are told apart by their place."""
    held = [(k, i, v) for k, (i, v, *_) in enumerate(rows) if v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v in held:
        if query(i):
            scored = [(-float(np.cumsum(np.array(w) * np.array(v))[-1]), j is None, j or 0, m, j) for m, j, w in held if m != k and len(w) == len(v)]
            out.append((i, [(x[4], -x[0]) for x in sorted(scored)[:most]]))
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def some_vectors(n, d, seed):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["random", "cluster", "lengths"])
def test_recall_against_all_products_and_exact_scores(spark, monkeypatch, kind):
    v = some_vectors(6000, 32, 1)
    if kind == "cluster":  # a third of all rows lies about one vector
        v[:2000] = v[0] + 0.01 * some_vectors(2000, 32, 2)
    if kind == "lengths":
        v *= np.exp(np.random.default_rng(3).normal(0, 1, (6000, 1)))
    rows = [(k, x.tolist(), 0.0, "", 1) for k, x in enumerate(v)]
    monkeypatch.setattr(hash_forest, "FOREST_ROWS", 2500)
    monkeypatch.setattr(blocks, "SENT_BYTES", 40_000)
    got = by_query(nearest(spark.createDataFrame(rows, DDL), F.col("vec_id") % 100 == 0, most=10).collect())
    want = dict(brute(rows, lambda i: i % 100 == 0, 10))
    assert got.keys() == want.keys()
    share = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(share) >= 0.93 and min(share) >= 0.5
    for q, found in got.items():
        assert len(found) == 10 and all(s == float(np.cumsum(v[i] * v[q])[-1]) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_ties_repeats_nulls_and_other_lengths_equal_all_products(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.choice([-1.0, 0.5, 1.0], 6).tolist()) for k in range(200)]
    rows += [(k, rows[40][1]) for k in range(200, 300)]  # one vector a hundred times
    rows += [(20, rows[20][1]), (None, rows[5][1]), (None, rows[6][1]), (400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None]), (480, [float("nan")] * 6), (500, [float("inf")] * 6), (520, [1.0, 2.0]), (540, [2.0, 1.0]), (560, [3.0]), (580, [1e200] * 6), (600, [-1e200] * 6)]
    rows = [(*r, 0.0, "", 1) for r in rows]
    got = nearest(spark.createDataFrame(rows, DDL), F.col("vec_id") % 20 == 0).collect()
    want = [(q, k, i, s) for q, found in brute(rows, lambda i: i is not None and i % 20 == 0, 20) for k, (i, s) in enumerate(found, 1)]
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key((r.query_id, r.rank, r.vec_id, r.score) for r in got) == key(want)


def test_tables_without_queries_or_rows(spark):
    one = spark.createDataFrame([(20, [1.0], 0.0, "", 1)], DDL)
    for rows in (one, one.limit(0), one.withColumn("vec_id", F.lit(7))):
        assert nearest(rows, F.col("vec_id") % 20 == 0).count() == 0


def test_symbols_agree_as_often_as_simulated():
    chances = symbol_chances()
    assert chances[-1] == 1 and chances[0] == 0 and abs(chances[len(GRID) // 2] - 1 / (2 * SLOTS)) < 0.005 and (np.diff(chances) >= -0.01).all()
    a, b = some_vectors(2, 24, 5)
    b = b - (a @ b) * a
    b = 0.75 * a + math.sqrt(1 - 0.75**2) * b / np.linalg.norm(b)
    x, y = strings(np.stack([a, b]), 7)
    first = (x >> 5 * (SYMBOLS - 1)) == (y >> 5 * (SYMBOLS - 1))
    assert abs(first.mean() - np.interp(0.75, GRID, chances)) < 0.1
