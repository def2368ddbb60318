import hashlib
from collections import Counter

from kinetrace.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, keep_id string, _sha int, kept int"


def test_matches_grouping_by_text_with_salted_and_plain_groups(spark):
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(["hot"] * 50 + ["pair", "pair", None, "", "a" * 100_000, "a" * 100_000, "one", "Pair"])]
    for hot_rows in (5, 1000):
        got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, DOCS), hot_rows=hot_rows).collect()}
        last, size = {r[1] or "": r[0] for r in rows}, Counter(r[1] or "" for r in rows)
        assert len(got) == len(rows)
        for doc, text, *_ in rows:
            r = got[doc]
            assert (r.keep_id, r.group_size, r.kept) == (last[text or ""], size[text or ""], doc == last[text or ""])
            assert r.text_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_null_and_repeated_ids_keep_one_row(spark):
    rows = [(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
