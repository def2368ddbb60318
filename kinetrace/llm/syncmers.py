"""Document fingerprints from closed syncmers; DataFrame functions only.

A closed syncmer is a window of ``GRAM + SPAN - 1`` characters whose smallest inner substring of ``GRAM`` characters, by hash, is the first or the
last. Whether a window is one depends on nothing outside it, so the same passage gives the same anchors wherever it stands. A fingerprint holds
the ``ANCHORS`` distinct anchors with the smallest values, each with its first position, so that two fingerprints are matched by position.

An anchor is one 64-bit integer: 19 bits of its smallest inner hash, 20 bits of a hash of the whole window, and 24 bits of position (a later position
counts as the last that fits). As its order is that of the smallest inner hash, only the neighbourhoods of small inner hashes need be looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.workspace import row_count
from kinetrace.session import table

#: Characters of an inner substring, inner substrings of a window, anchors of a fingerprint.
GRAM, SPAN, ANCHORS = 6, 6, 64
#: Characters that are looked at together, and the shift between two matches that still counts as the same.
PIECE, SLACK = 8192, 32
#: Inner hashes that are looked at first, as a multiple of ``ANCHORS``; all of them are if these give too few anchors.
TRIED = 4
#: Documents are dealt by id into ``COARSE`` ranges and each of these into parts of at most about ``PART_ROWS``, ``MOST_PARTS`` at most.
COARSE, PART_ROWS, MOST_PARTS = 1000, 100_000, 1000

POSITION_BITS, ORDER_BITS, SELF_BITS = 24, 19, 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
WINDOW = GRAM + SPAN - 1
PAD = "\x00" * (WINDOW - 1)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchor_hash(anchor: Column) -> Column:
    return F.shiftright(anchor, POSITION_BITS)


def anchor_position(anchor: Column) -> Column:
    return anchor.bitwiseAND(_long((1 << POSITION_BITS) - 1))


def lowest(anchors: Column, most: int = ANCHORS) -> Column:
    """The anchors with the ``most`` smallest distinct hashes, in order, each at its first position."""
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (anchor_hash(x) != anchor_hash(F.get(s, i - 1))))
    return F.slice(_once(F.sort_array(anchors), first), 1, most)


def _piece_anchors(text: Column, base: Column, limit: Column) -> Column:
    """Closed syncmers with a smallest inner hash up to ``limit`` of a short text whose first character has position ``base``."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))

    def select(hashes: Column) -> Column:
        def around(i: Column) -> Column:
            return _once(F.get(hashes, i), lambda x: F.array(window(x, i, 1), window(x, i, -1)))

        def window(x: Column, i: Column, way: int) -> Column:
            """The window that starts (1) or ends (-1) with the inner substring ``i``, if that is its smallest; null beyond either end."""
            smallest = reduce(lambda a, b: a & b, [x <= F.get(hashes, i + way * k) for k in range(1, SPAN)])
            other = F.get(hashes, i + way * (SPAN - 1))
            own = F.shiftrightunsigned(F.xxhash64(x, other) if way > 0 else F.xxhash64(other, x), 64 - SELF_BITS)
            value = F.shiftleft(F.shiftrightunsigned(x.bitwiseXOR(_long(LEAST)), 64 - ORDER_BITS), SELF_BITS).bitwiseOR(own)
            place = F.least(base + (i if way > 0 else i - (SPAN - 1)), _long((1 << POSITION_BITS) - 1))
            return F.when(smallest, F.shiftleft(value, POSITION_BITS).bitwiseOR(place))

        small = F.array_compact(F.transform(hashes, lambda x, i: F.when(x <= limit, i)))
        return F.array_compact(F.flatten(F.transform(small, around)))

    return _once(F.transform(grams, lambda g: F.xxhash64(g)), select)


def anchors_of(text: Column, base: Column) -> Column:
    """The lowest anchors of a text of any length, taken in overlapping pieces."""
    n = F.length(text)
    starts = F.sequence(_long(0), F.greatest(_long(0), F.floor((n - WINDOW) / F.lit(PIECE)).cast("long")))
    half = 1 << (ORDER_BITS - 1)
    slots = F.ceil(F.lit(float(2 * half * TRIED * ANCHORS)) / F.greatest(n, F.lit(1))).cast("long")
    bound = F.when(slots >= 2 * half, _long(MOST)).otherwise(F.shiftleft(slots - half, 64 - ORDER_BITS) - 1)

    def within(limit: Column) -> Column:
        piece = lambda k: lowest(_piece_anchors(F.substring(text, (k * PIECE + 1).cast("int"), F.lit(PIECE + WINDOW - 1)), base + k * PIECE, limit))
        return lowest(F.flatten(F.transform(starts, piece)))

    few = lambda held: (F.size(held) < ANCHORS) & (slots < 2 * half)
    return _once(_once(bound, within), lambda held: F.when(few(held), within(_long(MOST))).otherwise(held))


def _with_fallback(anchors: Column, text: Column) -> Column:
    """A text without any anchor is its own; an empty text has none."""
    whole = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 25), POSITION_BITS)
    return _once(anchors, lambda held: F.when((F.size(held) == 0) & (F.length(text) > 0), F.array(whole)).otherwise(held))


def text_of_fingerprint(anchors: Column) -> Column:
    return F.lower(F.array_join(F.transform(anchors, lambda a: F.lpad(F.hex(a), 16, "0")), ""))


def likeness(a: Column, b: Column, most: int = ANCHORS) -> Column:
    """Share (0 to 1) of two texts that is common, from their anchors alone: 1 for equal fingerprints.

    The shared ones among the ``most`` lowest anchors of both estimate the resemblance. A shared anchor counts if another one is shifted as far, or if
    there is just one.
    """
    hashes = F.struct(F.transform(a, anchor_hash).alias("a"), F.transform(b, anchor_hash).alias("b"))

    def meet(h: Column) -> Column:
        union = F.slice(F.array_sort(F.array_union(h["a"], h["b"])), 1, most)
        return _once(union, lambda u: _once(F.struct(u.alias("u"), F.array_intersect(F.array_intersect(h["a"], h["b"]), u).alias("shared")), compare))

    def compare(m: Column) -> Column:
        at = lambda anchors: F.filter(anchors, lambda x: F.array_contains(m["shared"], anchor_hash(x)))
        shifts = F.sort_array(F.zip_with(at(a), at(b), lambda x, y: anchor_position(y) - anchor_position(x)))

        def in_place(s: Column) -> Column:
            near = lambda x, y: F.coalesce(F.abs(x - y) <= SLACK, F.lit(False))
            return F.size(F.filter(s, lambda x, i: (F.size(s) == 1) | near(x, F.get(s, i + 1)) | (i > 0) & near(x, F.get(s, F.greatest(i - 1, F.lit(0))))))

        share = lambda j: F.when(F.size(m["u"]) == 0, F.lit(1.0)).otherwise(2 * j / (1 + j))
        return _once(_once(shifts, in_place) / F.greatest(F.size(m["u"]), F.lit(1)), share)

    return _once(hashes, meet)


def _ranges(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(parts, coarse): the id bounds of the parts of each coarse range, and the coarse range of an id column ``_k``.

    Quantiles of all ids: at most ``COARSE`` bounds, and ``MOST_PARTS`` for each range between them.
    """
    rows = row_count(docs)
    shares = [k / COARSE for k in range(1, COARSE)]
    found = docs.agg(F.percentile_approx("_k", shares, 20 * COARSE).alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("_k"))) if bounds else F.lit(0)
    parts = min(MOST_PARTS, -(-rows // (COARSE * PART_ROWS)))
    inner = [k / parts for k in range(1, parts)]
    fine = docs.groupBy(coarse.alias("_coarse")).agg((F.percentile_approx("_k", inner, 20 * parts) if inner else F.array().cast("array<long>")).alias("_fine"))
    return fine, coarse


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's, in ascending order of id;
    the first follows the last. A null text counts as empty, a null id comes first, and rows with equal ids follow one another in the order of their
    texts' hashes, repeated rows among them. A single row follows itself. Other columns are ignored; an empty table gives an empty result.

    Documents meet their successors within ranges of ids: each part also holds a copy of the first documents of the next part, so every
    text is shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_k"), F.coalesce(text_col, F.lit("")).alias("_text"))
    fine, coarse = _ranges(rows.select("_k"))
    part = F.struct(F.col("_coarse").alias("c"), F.size(F.filter("_fine", lambda b: b <= F.col("_k"))).alias("f"))
    placed = rows.withColumn("_coarse", coarse).join(F.broadcast(fine), "_coarse").withColumn("_part", part).drop("_coarse", "_fine")
    # one row per part: COARSE * MOST_PARTS at most
    firsts = placed.groupBy("_part").agg(F.min("_k").alias("_first"))
    around = Window.orderBy(F.col("_part").desc())
    wrapped = F.max("_part").over(Window.partitionBy())
    guests = firsts.select(F.col("_first").alias("_k"), F.coalesce(F.lead("_part").over(around), wrapped).alias("_guest"))
    dealt = placed.join(F.broadcast(guests), "_k", "left")
    stays = F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest")))
    visits = F.array(F.struct(F.col("_guest").alias("part"), F.lit(True).alias("guest")))
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_guest").isNull(), stays).otherwise(F.concat(stays, visits))))
    dealt = dealt.select("_id", "_k", "_text", F.col("_at.part.c").alias("_c"), F.col("_at.part.f").alias("_f"), F.col("_at.guest").alias("_visits")).repartition("_c", "_f")

    sized = dealt.withColumn("_n", F.length("_text")).withColumn("_cut", (F.col("_n") - F.floor(F.col("_n") / 4)).cast("int")).withColumn("_h", F.xxhash64("_text"))
    # anchors within what an edit keeps, and of the text; the pad before the start gives short texts anchors
    padded = F.concat(F.lit(PAD), F.substring("_text", F.lit(1), F.col("_cut")))
    kept = sized.withColumn("_kept", anchors_of(padded, _long(0)))
    edge = kept.withColumn("_edge", F.substring(padded, F.col("_cut") + 1, F.lit(WINDOW - 1)))
    base = F.col("_cut").cast("long")
    rest = edge.withColumn("_rest", anchors_of(F.concat("_edge", F.substring("_text", F.col("_cut") + 1, F.col("_n"))), base))
    own = rest.withColumn("_own", _with_fallback(lowest(F.concat("_kept", "_rest")), F.col("_text"))).drop("_rest")

    order = Window.partitionBy("_c", "_f").orderBy("_visits", "_k", "_h")
    paired = own.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_own", F.lead("_own").over(order)).filter(~F.col("_visits"))
    head = F.substring("_next", F.lit(1), F.col("_n") - F.col("_cut"))
    edited = paired.withColumn("_head", head).drop("_next").withColumn("_new", F.concat(F.substring("_text", F.lit(1), F.col("_cut")), "_head")).drop("_text")
    edited = edited.withColumn("_tail", anchors_of(F.concat("_edge", "_head"), base)).withColumn("_changed", _with_fallback(lowest(F.concat("_kept", "_tail")), F.col("_new")))
    return edited.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_new").cast("binary"), 256).alias("edited_sha256"),
        text_of_fingerprint(F.col("_own")).alias("fingerprint"),
        text_of_fingerprint(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next_own")).alias("near_next"),
    )


def op7_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_syncmer_fingerprints": op7_syncmer_fingerprints}
ORACLES: dict[str, str] = {}
