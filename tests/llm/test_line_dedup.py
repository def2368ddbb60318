import random
import re

from pyspark.sql import functions as F

from kinetrace.llm import line_dedup
from kinetrace.llm.line_dedup import dedup_lines, within_edits, within_edits_trimmed

DOCS = "doc_id long, text string, n_lines string, n_links int, _p int"


def distance(a, b):
    while a and b and a[0] == b[0] and len(a) > 100:
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        a, b = a[k:], b[k:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, line, n):
    for _ in range(n):
        k, c = rng.randrange(len(line)), rng.choice("abé ")
        line = rng.choice([line[:k] + c + line[k + 1 :], line[:k] + c + line[k:], line[:k] + line[k + 1 :]])
    return line


def brute(rows, edits, min_chars):
    first, out = [], {}
    for doc, text, *_ in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            near = [x for x in first if abs(len(x) - len(line)) <= edits and distance(x, line) <= edits] if len(line) >= min_chars else []
            if not near:
                kept.append(line)
            if len(line) >= min_chars and line not in first:
                first.append(line)
        out[doc] = "\n".join(kept) if text is not None else None
    return out


def test_bit_parallel_distance(spark):
    rng = random.Random(4)
    pairs = [(a, mutate(rng, a, rng.randrange(5))) for _ in range(400) for a in ["".join(rng.choice("abcé ") for _ in range(rng.randint(8, 40)))]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", within_edits(F.col("a"), F.col("b"), edits).alias("near"), within_edits_trimmed(F.col("a"), F.col("b"), edits, 8).alias("trimmed")).collect()
        assert all(r.near == r.trimmed == (distance(r.a, r.b) <= edits) for r in got)


def test_same_lines_go_as_by_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgé tn") for _ in range(rng.randint(18, 60))) for _ in range(25)]
    rows = [(k, "\n".join(mutate(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.8 else rng.choice(["", "}", "short"]) for _ in range(rng.randint(1, 8))), "x", 1, 2) for k in range(40)]
    rows += [(50, None, None, None, None), (51, "", "", 0, 0), (52, "z" * 50_000 + "\n" + "z" * 50_001, "", 0, 0)]
    got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = brute(rows, 2, 20)
    assert {r.doc_id: r.text for r in got} == want
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.n_lines == text[r.doc_id].count("\n") + 1 for r in got)
    assert sum(r.n_removed for r in got) > 20 and {r.doc_id: r.n_links for r in got} == brute_links(rows, 2, 20)


def brute_links(rows, edits, min_chars):
    """Links to other lines of the documents where each distinct line comes first."""
    first = {}
    for doc, text, *_ in sorted(rows):
        for line in (text or "").split("\n"):
            if len(line) >= min_chars:
                first.setdefault(line, doc)
    out = dict.fromkeys((r[0] for r in rows), 0)
    held = list(first)
    for k, a in enumerate(held):
        for b in held[:k]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                out[first[a]] += 1
                out[first[b]] += 1
    return out


def test_variants_of_one_line_meet_under_more_than_a_segment(spark, monkeypatch):
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgé tn") for _ in range(150))
    rows = [(k, mutate(rng, line, rng.randrange(9)), "x", 1, 2) for k in range(50)] + [(500 + k, mutate(rng, line[:70], rng.randrange(3)), "x", 1, 2) for k in range(20)]
    for hot in (3,):
        monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
        got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
        assert {r.doc_id: r.text for r in got} == brute(rows, 2, 20) and {r.doc_id: r.n_links for r in got} == brute_links(rows, 2, 20)


def test_columns_of_any_name_are_returned(spark):
    docs = spark.createDataFrame([(1, "x", "d", "t", "g", "l", "r", "dot")], "doc_id long, text string, _d string, _t string, _gone string, _links string, _row string, `a.b` string")
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_links"] and got.first()[:8] == (1, "x", "d", "t", "g", "l", "r", "dot")


def test_repeated_null_and_no_rows(spark):
    line = "a line that is long enough to count"
    got = dedup_lines(spark.createDataFrame([(1, line), (1, line), (None, line), (1, line + "s\nx")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, line), (1, ""), (1, ""), (1, "x")]
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_of_a_family_do_not_grow_with_its_square(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for k in range(200):
        words, at = base[:], rng.randrange(60)
        words[at:at], _ = [word()], words.pop(rng.randrange(60))
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = line_dedup._lines(docs, "doc_id", "text")
    assert line_dedup._candidates(lines, lines, 2).count() < 600  # of 19 900


def test_keys_are_made_by_methods_that_the_jvm_compiles(spark, capsys):
    wide = spark.range(3).select(F.col("id").alias("_id"), line_dedup._wide(F.repeat(F.lit("some line "), F.col("id").cast("int") + 3)).alias("_w"))
    line_dedup._at_places(wide, 2, line_dedup._places(2, 0)).select("_id", line_dedup._key(), line_dedup._is_own()).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # longer ones are only interpreted
