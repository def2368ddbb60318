from kinetrace.plans import registry


def test_of_axes_with_the_same_error_the_first_counts(spark, tmp_path):
    """0.3 - 0.1 and 0.2 - 0.0 differ in their last bits only."""
    action, state = [0.3, 0.2] + [0.0] * 21, [0.1, 0.0] + [0.0] * 21
    vectors = [(1, action + state + [0.0] * 18, 1), (2, state + action + [0.0] * 18, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = registry.queries()["followed_targets"](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [(r.axis, r.error) for r in rows] == [(0, 0.2), (0, 0.2)]
