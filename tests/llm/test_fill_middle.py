import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kinetrace.llm.fill_middle import fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "one", " one", "one ", "one two  three\n", "\t\n a\x0bb\x0cc\r ", "é ü 漢字 と　かな 🙂🙂 x", "a b c", "keeps <P> of its own", "has <M", "<S>", "< P> <", "x" * 5000,
    "w " * 40_000, "漢" * 30_000, "🙂a é" * 10_000, "same text here", "same text here",
]


def expected(doc, text, unit, rate, spm):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,rate,spm", [("token", 50, 80), ("token", 100, 50), ("char", 100, 50)])
def test_equals_cutting_a_list_of_units_and_restores_the_text(spark, unit, rate, spm):
    rows = [(k * 7 + j, t, "x", 1) for j in range(3) for k, t in enumerate(TEXTS)] + [(None, "no id at all", "y", 2), (2**53 + 1, "wide id here", "y", 2), (3, "id again", "y", 1), (3, "id again", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((r[0], *expected(r[0], r[1], unit, rate, spm)) for r in rows), key=key)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in rows)


def test_empty_table_and_string_ids(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = fill_in_middle(spark.createDataFrame([("k", "a b c")], "key string, body string"), "key", "body").first()
    assert (row.key, row.n) == ("k", 3)
