import hashlib
import random

from pyspark.sql import functions as F

from kinetrace.llm import syncmers as sy

DOCS = "doc_id long, text string, _k string, n_chars int, _at int"


def rows_of(n=60, seed=7):
    rng = random.Random(seed)
    words = ["alpha", "bêta", "gamma🙂", "delta", "eps", "zeta", "日本", "the"]
    texts = [" ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 40, 400, 3000]))) for _ in range(n)]
    return [(3 * k + 5, t, "x", 1, 2) for k, t in enumerate([*texts, None, "", "a", "🙂🙂🙂🙂🙂", texts[2], texts[2]])]


def edited(rows):
    out, order = {}, sorted(rows)
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        out[r[0]] = text[: len(text) - q] + after[:q]
    return out


def python_anchors(spark, text):
    """Closed syncmers by their definition, with the hashes of the engine."""
    padded = sy.PAD + text
    grams = [padded[k : k + sy.GRAM] for k in range(len(padded) - sy.GRAM + 1)]
    hashes = {r.g: r.h for r in spark.createDataFrame([(g,) for g in set(grams)] or [("",)], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    found = []
    for k in range(len(text)):
        window = [hashes[g] for g in grams[k : k + sy.SPAN]]
        if min(window) in (window[0], window[-1]):
            found.append((window[0], window[-1], min(window), k))
    keyed = {}
    pairs = spark.createDataFrame(found or [(0, 0, 0, -1)], "a long, b long, m long, p long").filter("p >= 0")
    for r in pairs.select(F.shiftrightunsigned(F.xxhash64("a", "b"), 44).alias("h"), "m", "p").collect():
        value = ((r.m + (1 << 63)) >> 45) << 20 | r.h
        keyed[value] = min(r.p, keyed.get(value, r.p))
    return "".join(f"{h << sy.POSITION_BITS | p:016x}" for h, p in sorted(keyed.items())[: sy.ANCHORS])


def test_fingerprints_follow_the_definition(spark):
    rows = rows_of()
    sy.PIECE, before = 500, sy.PIECE
    try:
        got = {r.doc_id: r for r in sy.fingerprint_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    finally:
        sy.PIECE = before
    new = edited(rows)
    assert len(got) == len(rows)
    order = sorted(rows)
    for k, r in enumerate(order):
        g, text = got[r[0]], r[1] or ""
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(new[r[0]].encode()).hexdigest()
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if new[r[0]] == text:
            assert g.near_edited == 1
        if len(text) > 1000:
            assert g.near_edited > 0.5
    for doc in range(5, 50, 3):
        text = dict((r[0], r[1]) for r in rows)[doc]
        if len(text) > 20:
            assert got[doc].fingerprint == python_anchors(spark, text)
            assert got[doc].edited_fingerprint == python_anchors(spark, new[doc])
    same = {}
    for r in rows:
        assert same.setdefault(r[1] or "", got[r[0]].fingerprint) == got[r[0]].fingerprint


def test_many_parts_repeated_null_one_and_no_rows(spark):
    sy.COARSE, sy.PART_ROWS, before = 4, 3, (sy.COARSE, sy.PART_ROWS)
    try:
        rows = rows_of(40)
        got = {r.doc_id: r.edited_sha256 for r in sy.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in edited(rows).items()}
    finally:
        sy.COARSE, sy.PART_ROWS = before
    few = [(1, "abcd" * 9), (1, "abcd" * 9), (None, "q")]
    assert sorted((r.doc_id or -1, r.n_chars) for r in sy.fingerprint_documents(spark.createDataFrame(few, "doc_id long, text string")).collect()) == [(-1, 1), (1, 36), (1, 36)]
    one = sy.fingerprint_documents(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert sy.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
