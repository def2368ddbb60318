import random

import corpus_pipeline
import test_line_dedup
import test_minhash

from kinetrace.llm import language_id


def corpus():
    rng = random.Random(8)
    words = {"aa": "the of and thing there when over".split(), "bb": "der die und nicht straße über wenn".split()}
    rows = []
    for k in range(1, 90):
        lang = rng.choice(list(words))
        line = lambda lang=lang: " ".join(rng.choice(words[lang]) + rng.choice(["", "en", "ing", "s"]) for _ in range(rng.randint(4, 9)))
        rows.append([k, "\n".join(line() for _ in range(rng.randint(1, 6))), rng.choice([lang, lang, None]), "src", 0])
    rows.append([90, rows[3][1], "aa", "src", 0])
    rows.append([91, rows[5][1].replace(" ", "  ") + " zz", None, "src", 0])
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150))
    rows += [[92, long, "aa", "src", 0], [93, long.replace("wordaa", "other words"), "aa", "src", 0], [94, None, "aa", None, None], [95, "12 34", None, "s", 5], [96, "", None, "s", 0]]
    return rows


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.identify_languages(spark, docs, str(tmp_path))
    models = language_id.fit(docs.selectExpr("doc_id as key", "text", "lang"))
    verdicts = {r[0]: models.classify([r[1] or ""])[0] for r in rows}
    got = {r.doc_id: r for r in first.collect()}
    assert set(got) == {d for d, v in verdicts.items() if not v[2]} and not {94, 95, 96} & set(got) and len(got) > 85
    assert first.columns == docs.columns and all(got[r[0]].lang == (r[2] or verdicts[r[0]][0]) for r in rows if r[0] in got)

    second = corpus_pipeline.drop_repeated_lines(spark, first, str(tmp_path))
    want = test_line_dedup.brute([(d, r.text) for d, r in got.items()], 2, 20)
    want = {d: t for d, t in want.items() if t == got[d].text or t.strip()}
    left = {r.doc_id: r for r in second.collect()}
    assert {d: r.text for d, r in left.items()} == want and 90 not in left
    assert second.columns == docs.columns and all(r.n_chars == len(r.text) for r in left.values())

    third = corpus_pipeline.drop_near_duplicates(spark, second, str(tmp_path))
    groups = test_minhash.brute([(d, t) for d, t in want.items()], 5, 80)
    kept = {r.doc_id for r in third.collect()}
    assert kept == {d for d, (_, c) in groups.items() if c == d} and third.columns == docs.columns

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == kept
    for d in kept:
        own = [p for p in pieces if p.doc_id == d]
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_no_rows_and_repeated_rows(spark, tmp_path):
    rows = [(1, "the of and thing there " * 5, "aa", "s", 1)] * 2 + [(2, "der die und nicht " * 9, "bb", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, some in enumerate((rows, [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()
        assert sorted(p.doc_id for p in got if p.start == 0) == sorted({r[0] for r in some})


def test_columns_of_documents_clash_with_none_of_the_operators(spark, tmp_path):
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    names = ["_row", "row", "_kept", "score", "rejected", "lang_pred", "bits_per_symbol", "n_links", "n_lines", "n_removed", "_d", "_t", "others", "component_id", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(k, text.replace("worda", f"other{k}", k), "aa", "s", 1, *names) for k in range(3)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and all(tuple(r)[5:] == tuple(names) for r in got.collect())


def test_near_duplicates_of_rows_with_null_and_clashing_ids(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    near = lambda k: text(k) + " end"
    rows = [(None, text(0)), (None, text(1)), (None, near(1)), (None, text(2)), (5, near(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, near(4)), (9, text(5)), (6, near(5)), (3, ""), (3, ""), (None, " ")]
    docs = spark.createDataFrame([(d, t, "aa", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    sure = [(None, text(0)), (5, near(2)), (7, text(3)), (7, text(4)), (6, near(5)), (3, ""), (None, " ")]
    assert all(got.count(r) == 1 for r in sure) and sum((None, t) in got for t in (text(1), near(1))) == 1 and len(got) == len(sure) + 1
