"""Line deduplication by a segment-partition edit join; DataFrame functions only.

Lines within ``EDITS`` edits of one another agree on one of ``EDITS + 1`` segments, at a place that differs by few characters. Every line
is indexed under its segments and probes those of lines up to ``EDITS`` characters shorter, only at the starts that an
alignment within the threshold allows. Lines that meet under a segment that many lines have are not paired there: what is left of them
beside the segment is split into segments again, within the edits that are left, so that they meet only if they agree on more of
the line. What meets is verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.workspace import materialise, release, row_count
from kinetrace.session import table

#: Edits allowed between lines of one class; shorter lines are always kept.
EDITS, MIN_CHARS = 2, 20
#: Letters whose counts are compared before lines are, two bits each; an edit changes at most two of them by one.
COUNTED = "abcdefghijklmnopqrstuvwxyz ,.-01"
#: Bytes that are sent to all executors; with more, both sides are shuffled.
SENT_BYTES = 48 << 20
#: Lines of one length with one segment from which on they meet under more of the line only; twice as many each time that is split again.
HOT_LINES = 24


def _sent(df: DataFrame, size: Column | int) -> DataFrame:
    """``df`` for all executors if its rows, of ``size`` bytes each, are few."""
    held = df.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0
    return F.broadcast(df) if held <= SENT_BYTES else df


def _wide(line: Column) -> Column:
    """Four bytes for each code point, so that places need no counting."""
    return F.encode(line, "UTF-32")


def _cut(wide: Column, first: Column | int, chars: Column) -> Column:
    """``chars`` code points from place ``first`` (from 0); places outside of the line give what is inside."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when((chars <= 0) | (first < 0), F.lit(b"")).otherwise(F.substring(wide, (first * 4 + 1).cast("int"), (chars * 4).cast("int")))


def _segment(length: Column, i: Column | int, parts: int) -> tuple[Column, Column]:
    """First place (from 0) and size of segment ``i`` (from 0) of a line; the last ``length % parts`` are one longer."""
    i = F.lit(i) if isinstance(i, int) else i
    short = F.floor(length / F.lit(parts))
    longer = parts - length % parts
    return (i * short + F.greatest(F.lit(0), i - longer)).cast("int"), (short + (i >= longer).cast("int")).cast("int")


def _places(edits: int, least: int) -> list[tuple[int, int, int]]:
    """(how many characters shorter the indexed line is, segment, shift) that a probe looks up: some segment agrees that has at most as many edits
    before it as segments, and the rest of the edits behind it. Those of a line's own segments come first."""
    found = [(shorter, i, shift) for shorter in range(least, edits + 1) for i in range(edits + 1) for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)]
    return sorted(found, key=lambda x: (x[0] != 0 or x[2] != 0, x))


def _at_places(rows: DataFrame, edits: int, places: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with _w once for each of the places: _p is the place, _at the first character of its segment and _size how many it has.

    The places are rows and not as many expressions: those together make a method so long that the JVM only interprets it.
    """
    told = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(place, "hik", strict=True)]) for place in places])
    rows = rows.withColumn("_n", (F.octet_length("_w") / 4).cast("int"))
    rows = rows.select(*rows.columns, F.explode(told).alias("_p"))
    start, size = _segment(F.col("_n") - F.col("_p.h"), F.col("_p.i"), edits + 1)
    return rows.select(*rows.columns, (start + F.col("_p.k")).alias("_at"), size.alias("_size"))


def _key(*group: str) -> Column:
    return F.xxhash64(*group, F.col("_n") - F.col("_p.h"), F.col("_p.i"), _cut(F.col("_w"), F.col("_at"), F.col("_size"))).alias("_key")


def _is_own() -> Column:
    return ((F.col("_p.h") == 0) & (F.col("_p.k") == 0)).alias("_same")


def _level(rows: DataFrame, edits: int, places: list[tuple[int, int, int]], is_index: bool) -> DataFrame:
    """(_id, _c, _index, _same, _key, _rest, _left) for each of the places of rows (_id, _c, _w) or (_id, _c, _w, _group).

    _rest is what is left of a line beside the segment, what follows it or else what is before the last one, and _left the edits that are left for that.
    """
    group = ["_group"] if "_group" in rows.columns else []
    rows = _at_places(rows.select("_id", "_c", "_w", *group), edits, places)
    i, n, at, size = F.col("_p.i"), F.col("_n"), F.col("_at"), F.col("_size")
    last = i == edits
    same = F.lit(False).alias("_same") if group else _is_own()
    rest = F.when(last, _cut(F.col("_w"), 0, at)).otherwise(_cut(F.col("_w"), at + size, n - at - size))
    return rows.select("_id", "_c", F.lit(is_index).alias("_index"), same, _key(*group), rest.alias("_rest"), F.when(last, edits).otherwise(edits - i).alias("_left"))


def _own(edits: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(edits + 1)]


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letter_counts(line: Column, n: Column) -> Column:
    """The counts of some letters, modulo 4, in 64 bits; in Gray code, so that counts that differ by one differ in one bit."""

    def gray(c: str) -> Column:
        left = (n - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        return left.bitwiseXOR(F.shiftright(left, 1)).bitwiseAND(F.lit(1)).bitwiseOR(left.bitwiseAND(F.lit(2)))

    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(gray(c), 2 * k) for k, c in enumerate(COUNTED)])


def _counts_near(a: Column, b: Column, edits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * edits


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings of at least ``edits`` characters are within ``edits`` edits.

    One machine word holds the band of a column of the distance matrix as differences between rows; it moves down by a
    row with each character, so the length of the strings does not matter.
    """
    width = 2 * edits + 3
    full, top = (1 << width) - 1, 1 << (width - 1)
    inv = lambda x: x.bitwiseXOR(F.lit(full).cast("long"))
    lit = lambda x: F.lit(x).cast("long")

    # parts that several expressions share are bound by passing through one-element arrays, so that each is computed once
    def measure(s: Column) -> Column:
        pattern, text, m, n = s["p"], s["t"], s["m"], s["n"]

        def step(state: Column, j: Column) -> Column:
            char = F.get(text, j)
            match = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(pattern, j + (k - (width - 1 - edits))) == char, lit(1 << k)).otherwise(lit(0)) for k in range(width)])

            def diagonal(pm: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                return _once(((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(lit(full)), horizontal)

            def horizontal(d0: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                return _once(F.struct(d0.alias("d0"), vn.bitwiseOR(inv(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")), vertical)

            def vertical(h: Column) -> Column:
                d0, hp, hn = h["d0"], h["hp"], h["hn"]
                x = F.shiftrightunsigned(d0, 1)
                late = j - (m - edits)
                mask = F.call_function("shiftrightunsigned", lit(top >> 1), F.greatest(late, F.lit(0)))
                up = F.when(late < 0, F.when(d0.bitwiseAND(lit(top)) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0))
                return F.struct(hn.bitwiseOR(inv(x.bitwiseOR(hp))).alias("vp"), x.bitwiseAND(hp).alias("vn"), (state["d"] + up).alias("d"))

            return _once(match, diagonal)

        first = F.struct(lit(full - ((1 << (width - 1 - edits)) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(edits).alias("d"))
        distance = F.aggregate(F.sequence(F.lit(0), n - 1), first, step, lambda s: s["d"])
        return F.when(F.abs(m - n) > edits, F.lit(False)).otherwise(distance <= edits)

    return _once(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"), F.length(a).alias("m"), F.length(b).alias("n")), measure)


def within_edits_trimmed(a: Column, b: Column, edits: int, block: int = 32) -> Column:
    """As :func:`within_edits`, after equal blocks at the start and then at the end of both strings are cut off, which changes no distance."""

    def cut(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        # whole blocks of the shorter string, but for what must be left of it
        most = F.greatest(F.lit(0), F.floor((F.least(F.length(x), F.length(y)) - 2 * edits - 2) / F.lit(block)).cast("int"))
        differ = F.transform(F.sequence(F.lit(0), most), lambda k: (k == most) | (F.substring(x, k * block + 1, F.lit(block)) != F.substring(y, k * block + 1, F.lit(block))))
        rest = lambda s, at: F.reverse(F.substring(s, at, F.length(s)))
        return _once(((F.array_position(differ, True) - 1) * block + 1).cast("int"), lambda at: F.struct(rest(x, at).alias("x"), rest(y, at).alias("y")))

    return _once(_once(_once(F.struct(a.alias("x"), b.alias("y")), cut), cut), lambda q: within_edits(q["x"], q["y"], edits))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return rows.select("_d", F.xxhash64("_text").alias("_t"), F.posexplode(F.split("_text", "\n")).alias("_p", "_line"))


def _equal_lines(lines: DataFrame) -> DataFrame:
    """The places (_d, _t, _p) of lines whose content comes earlier."""
    place = F.struct("_d", "_t", "_p")
    hashed = lines.select("_d", "_t", "_p", F.xxhash64("_line").alias("_h"), "_line")
    often = materialise(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "line-hashes")
    again = materialise(hashed.join(_sent(often, 16), "_h", "left_semi"), "lines-again")
    first = materialise(again.groupBy("_line").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_line", "_first"), "lines-first")
    equal = again.join(_sent(first, F.octet_length("_line") + 48), "_line").filter(place != F.col("_first")).select("_d", "_t", "_p").distinct()
    equal = materialise(equal, "equal-lines")
    release(again)
    return equal


def _texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _line, _place): the lines of these hashes and where each comes first."""
    held = lines.withColumn("_id", F.xxhash64("_line")).join(_sent(ids, 16), "_id", "left_semi")
    return held.groupBy("_id", "_line").agg(F.min(F.struct("_d", "_t", "_p")).alias("_place"))


def _meet(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """Pairs (_a, _b) of lines (_id, _c) that meet under a key and have nearly the same letters."""
    met = index.join(probe.withColumnsRenamed({"_id": "_id2", "_c": "_c2"}), "_key")
    met = met.filter(F.when(F.col("_same"), F.col("_id") < F.col("_id2")).otherwise(F.col("_id") != F.col("_id2")) & _counts_near(F.col("_c"), F.col("_c2"), edits))
    return met.select(F.least("_id", "_id2").alias("_a"), F.greatest("_id", "_id2").alias("_b")).distinct()


def _hot(index: DataFrame, lines: int) -> DataFrame:
    return index.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > lines).select("_key")


def _candidates(lines: DataFrame, own: DataFrame, edits: int) -> DataFrame:
    """Pairs (_a, _b) of hashes of lines that may be within ``edits`` edits; own holds each line once."""
    wide = own.select(F.xxhash64("_line").alias("_id"), _wide(F.col("_line")).alias("_w"))
    first = _places(edits, 0)
    # needed twice: kept in memory as far as there is room, and computed anew otherwise
    index = _at_places(wide, edits, _own(edits)).select("_id", _key()).persist(StorageLevel.MEMORY_ONLY)
    probe = _at_places(wide, edits, first).select("_id", _key(), _is_own())
    hot = materialise(_hot(index, HOT_LINES), "line-hot")
    cold = index.join(_sent(hot, 16), "_key", "left_anti").unionByName(hot.select(F.lit(None).cast("long").alias("_id"), "_key"))
    # lines that meet under cold keys, and in the same pass the lines that have hot ones
    met = cold.join(probe.withColumnRenamed("_id", "_id2"), "_key").filter(F.col("_id").isNull() | F.when(F.col("_same"), F.col("_id") < F.col("_id2")).otherwise(F.col("_id") != F.col("_id2")))
    met = materialise(met.select(F.when(F.col("_id").isNotNull(), F.least("_id", "_id2")).alias("_a"), F.greatest("_id", "_id2").alias("_b")).distinct(), "line-met")
    index.unpersist()
    found = met.filter("_a is not null")
    if not row_count(hot):
        return found

    # from here on rows carry what is left of their lines beside the hot segments
    met = met.filter("_a is null").select(F.col("_b").alias("_id"))
    texts = _texts_of(lines, met).select("_id", letter_counts(F.col("_line"), F.length("_line")).alias("_c"), _wide(F.col("_line")).alias("_w"))
    texts = materialise(texts, "line-met-texts")
    rows = _level(texts, edits, _own(edits), True).union(_level(texts, edits, first, False))
    for depth in itertools.count(1):
        rows = materialise(rows.join(_sent(hot, 16), "_key", "left_semi"), f"line-rests-{depth}")
        # the rests of a group are as long as one another but for the edits; those that cannot be split any more are paired
        again = rows.groupBy("_key").agg(F.min(F.octet_length("_rest")).alias("_size"), F.max("_left").alias("_e")).filter(F.col("_size") >= 4 * (F.col("_e") + 1)).select("_key")
        again = materialise(again, f"line-split-{depth}")
        done = rows.join(_sent(again, 16), "_key", "left_anti")
        found = found.union(materialise(_meet(done.filter("_index").select("_key", "_id", "_c"), done.filter("not _index").select("_key", "_id", "_c", "_same"), edits), f"line-short-{depth}"))
        if not row_count(again):
            release(rows)
            break
        held = rows
        rows = rows.join(_sent(again, 16), "_key", "left_semi").select("_id", "_c", "_index", "_left", F.col("_key").alias("_group"), F.col("_rest").alias("_w"))
        parts = []
        for e in range(1, edits + 1):
            some = rows.filter(F.col("_left") == e)
            parts += [_level(some.filter("_index"), e, _own(e), True), _level(some.filter("not _index"), e, _places(e, -e), False)]
        rows = materialise(reduce(DataFrame.union, parts), f"line-keys-{depth}")
        release(held)
        index, probe = rows.filter("_index").select("_key", "_id", "_c").distinct(), rows.filter("not _index").select("_key", "_id", "_c", F.lit(False).alias("_same")).distinct()
        # splitting makes about twice as many rows with each level, and is worth that for groups that are larger still
        hot = materialise(_hot(index, HOT_LINES << depth), f"line-hot-{depth}")
        cold = [x.join(_sent(hot, 16), "_key", "left_anti") for x in (index, probe)]
        found = found.union(materialise(_meet(*cold, edits), f"line-found-{depth}"))
        if not row_count(hot):
            release(rows)
            break
    return materialise(found.distinct(), "line-pairs")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(removed, links): places (_d, _t, _p) of lines that repeat an earlier one, and the links (earlier, later place) between lines that differ."""
    lines = _lines(docs, id_col, text_col).filter(F.length("_line") >= min_chars)
    equal = _equal_lines(lines)
    own = lines.join(_sent(equal, 32), ["_d", "_t", "_p"], "left_anti")
    pairs = _candidates(lines, own, edits)

    ids = materialise(pairs.select(F.col("_a").alias("_id")).union(pairs.select("_b")).distinct(), "line-ids")
    texts = materialise(_texts_of(lines, ids).withColumn("_c", letter_counts(F.col("_line"), F.length("_line"))), "line-texts")
    side = lambda c, s: texts.select(F.col("_id").alias(c), F.col("_place").alias(f"_place{s}"), F.col("_line").alias(f"_line{s}"), F.col("_c").alias(f"_c{s}"))
    paired = pairs.join(side("_a", 1), "_a").join(side("_b", 2), "_b").filter((F.abs(F.length("_line1") - F.length("_line2")) <= edits) & _counts_near(F.col("_c1"), F.col("_c2"), edits))
    paired = materialise(paired.select("_place1", "_place2", "_line1", "_line2"), "line-candidates")
    # verifying is heavy and its rows are few: they are dealt anew, some hundred to a task
    dealt = paired.repartition(max(1, min(row_count(paired) // 200, 20_000)), F.xxhash64("_place1", "_place2"))
    near = dealt.filter(within_edits_trimmed(F.col("_line1"), F.col("_line2"), edits))
    links = materialise(near.select(F.least("_place1", "_place2").alias("earlier"), F.greatest("_place1", "_place2").alias("later")), "line-links")
    return equal.union(links.select("later._d", "later._t", "later._p")).distinct(), links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of ``text_col`` removed that repeat an earlier line, and ``n_lines, n_removed, n_links``.

    Lines end at a line feed. A line of at least ``min_chars`` code points goes if the same line, or one within ``edits`` edits,
    comes earlier, in the order of document id and position; null ids come first. Shorter lines stay. ``n_lines`` counts the lines
    before, ``n_links`` the links to different lines that the document's lines take part in. A null text stays null and counts as one empty line.
    Rows that repeat an id with the same text are one document and all of them keep its lines. ``id_col`` holds integers. A column of ``docs`` that is
    named like a result column is replaced; all others are returned as they are, whatever their names.
    """
    removed, links = repeated_lines(docs, id_col, text_col, edits, min_chars)
    removed = materialise(removed, "removed-lines")
    gone = removed.groupBy("_d", "_t").agg(F.collect_set("_p").alias("_gone"))
    ends = links.select(F.col("earlier._d").alias("_d"), F.col("earlier._t").alias("_t")).union(links.select("later._d", "later._t"))
    marks = materialise(gone.join(ends.groupBy("_d", "_t").agg(F.count(F.lit(1)).alias("_links")), ["_d", "_t"], "full"), "line-marks")
    rows = docs.drop("n_lines", "n_removed", "n_links")
    # the columns of the documents travel in one of their own, so that none can clash
    kept = F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(rows.columns)]).alias("_row")
    rows = rows.select(kept, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_t"))
    rows = rows.join(_sent(marks, 40 + 4 * F.greatest(F.lit(0), F.coalesce(F.size("_gone"), F.lit(0)))), ["_d", "_t"], "left")
    lines = F.split("_text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left)
    own = [text.alias(c) if c == text_col else F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.drop("n_lines", "n_removed", "n_links").columns)]
    count = lambda c, least: F.greatest(F.coalesce(c, F.lit(least)), F.lit(least))
    return rows.select(*own, count(F.size(lines), 1).alias("n_lines"), count(F.size("_gone"), 0).alias("n_removed"), F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_links", "text")


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES: dict[str, str] = {}
