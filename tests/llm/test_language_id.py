import random

from pyspark.sql import functions as F

from kinetrace.llm import language_id as li

WORDS = {"aa": "the of and thing there".split(), "bb": "der die und nicht straße".split(), "zh": "你好 世界 数据 语言".split()}
DOCS = "doc_id long, text string, lang string, score string, bits_per_symbol int"


def corpus(n=400):
    rng = random.Random(2)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([2, 5, 40]))), lang, "s", 1) for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_texts_are_told_apart_and_letterless_ones_rejected(spark):
    rows = corpus()
    extra = [(1000, None, "aa", None, None), (1001, "", "aa", "", 0), (1002, "12 ?!\n", None, "", 0), (1003, "the " * 50_000, None, None, None), (None, "der die", None, None, None)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    train = docs.filter(li.fifth(F.col("doc_id")) != 0)
    models = li.fit(train.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = li.identify(docs, models).collect()
    assert len(got) == len(rows) + len(extra) and set(docs.columns) <= set(got[0].asDict())
    truth = {r[0]: r[2] for r in rows}
    assert sum(g.lang_pred == truth[g.doc_id] for g in got if g.doc_id in truth) >= 0.99 * len(rows)
    assert not any(g.rejected for g in got if g.doc_id in truth)
    by = {g.doc_id: g for g in got}
    assert all(by[d].lang_pred == "und" and by[d].rejected and by[d].score == 0 for d in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa" and by[None].lang_pred == "bb" and all(0 <= g.score <= 1 for g in got)


def test_model_is_a_distribution_and_the_sample_is_bounded(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("key"), "text", "lang")
    models = li.fit(docs, sample_rows=20)
    for model in models.models:
        contexts = model.levels[4].contexts[:20]
        for ctx in contexts:
            import numpy as np

            letters = np.unique(models.keys & np.uint64(0xFFFF))
            total = model.probability((ctx << np.uint64(16)) | letters).sum() + model.probability((ctx << np.uint64(16)) | np.array([7], np.uint64))[0]
            assert abs(total - 1) < 1e-9
    assert li.fit(docs.filter("false")) is None
    assert li.identify(docs.drop("lang"), None).filter("lang_pred <> 'und'").count() == 0
