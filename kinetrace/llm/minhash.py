"""Near-duplicate documents by min-max hashing, exact confirmation and connected components.

Each permutation gives two signature values, its minimum and its maximum over a document's shingles, so ``BANDS * ROWS`` values
cost half as many permutations. Documents that agree on a band share a bucket. A document is compared with one
pseudo-random member of each of its buckets, the centre. Those that are alike enough to it form clusters, which are compared exactly, in blocks of
bounded size. Those that are not stay open: they are dealt anew, under their bucket and one more band each, until no bucket holds two
open ones, so a pair that lies among thousands of documents like neither of the two still meets. Pairs of a bucket are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.components import components
from kinetrace.llm.words import chunks, mix, shingle_sets
from kinetrace.llm.workspace import materialise, release, row_count, working_on
from kinetrace.session import table

#: 32 bands of 5 values from 80 permutations: a pair at 0.85 misses all bands with probability 7e-9, one at 0.8 with 3e-6.
BANDS, ROWS = 32, 5
#: Bucket mates with a lower likeness to the bucket's centre don't hold a cluster together.
CLUSTER_PERCENT = 50
#: Further bands, each on its own, under which the open members of a bucket are dealt anew.
MORE_BANDS = 3
#: Documents of each side of a block of exact comparisons.
BLOCK = 512
#: Ids (8 bytes each) that are sent to all executors to pick texts; with more, the texts are shuffled to the ids.
SENT_IDS = 4_000_000


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys, (sets, bands); every set must have a member."""
    values = np.concatenate(sets)
    offsets = np.cumsum([0] + [len(s) for s in sets][:-1])
    odd, plus = _constants(-(-bands * rows // 2))
    found = np.empty((len(odd) * 2, len(sets)), np.uint64)
    for p in range(len(odd)):
        moved = values * odd[p] + plus[p]
        found[2 * p] = np.minimum.reduceat(moved, offsets)
        found[2 * p + 1] = np.maximum.reduceat(moved, offsets)
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + found[b * rows + r])
        keys[:, b] = key
    return keys


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds its distinct ``width``-word shingles (words between ASCII white space, A-Z lower-cased; a shorter text is one
    shingle; a null or blank text has none and is linked with nothing). Documents are linked when
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable over links, itself included.
    Repeated rows share a set and so a component; rows that share an id only are different documents, each in the component of its own set. A row with a null id takes part in no link; its component is that of an equal
    set with an id, if any. Other columns are ignored; an empty table gives an empty result.
    """
    # pandas would turn integers beside a null into doubles, so ids pass through it as strings
    rows_in = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("minhash")
        for batch in batches:
            ids = batch["_id"].tolist()
            for first, raws in chunks(batch["_text"].tolist()):
                sets = shingle_sets(raws, width)
                out = pd.DataFrame({"_id": ids[first : first + len(sets)], "n": [len(s) for s in sets], "digest": [_digest(s) if len(s) else None for s in sets]})
                held = [s for s in sets if len(s)]
                keys = iter(signatures(held, bands, rows).view(np.int64) if held else [])
                out["bands"] = [next(keys) if len(s) else None for s in sets]
                yield out

    signed = rows_in.withColumn("_id", F.col("_id").cast("string")).mapInPandas(sign, "_id string, n long, digest binary, bands array<long>")
    signed = materialise(signed.withColumn("_id", F.col("_id").cast("long")), "minhash-signatures")
    # a node is a set, whatever rows and ids have it; rid is the id by which its text is found
    reps = signed.filter("_id is not null and digest is not null").groupBy("digest", "n", "bands").agg(F.min("_id").alias("rid"))
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    def meet(dealt: DataFrame, level: int) -> DataFrame:
        """Members of buckets of two or more with the bucket's centre: the member nearest to the key by exclusive or."""
        centres = dealt.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("x"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        mates = dealt.join(centres, "key").select("node", "band", "key", F.col("x").bitwiseXOR(F.col("key")).alias("centre")).filter("node <> centre")
        return materialise(mates.withColumns({"a": F.least("node", "centre"), "b": F.greatest("node", "centre")}).drop("centre"), f"minhash-mates-{level}")

    mates = meet(reps.select("node", F.posexplode("bands").alias("band", "key")).repartition("key"), 0)
    pairs = mates.select("a", "b").distinct()
    involved = mates.select(F.col("a").alias("node")).union(mates.select("b")).distinct()
    # later pairs are of these too
    involved = materialise(reps.select("node", "rid", "digest").join(involved, "node", "left_semi"), "minhash-involved")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["_id"].tolist()
            for first, raws in chunks(batch["_text"].tolist()):
                sets = shingle_sets(raws, width)
                yield pd.DataFrame({"rid": ids[first : first + len(sets)], "digest": [_digest(s) for s in sets], "members": [s.tobytes() for s in sets]})

    ids = involved.select(F.col("rid").alias("_id"))
    texts = rows_in.join(F.broadcast(ids) if row_count(ids) <= SENT_IDS else ids, "_id", "left_semi")
    sets = texts.mapInPandas(gather, "rid long, digest binary, members binary")
    sets = materialise(sets.join(involved, ["rid", "digest"]).dropDuplicates(["node"]).select("node", "members"), "minhash-sets")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                found.append((a, b, shared, len(x) + len(y) - shared))
            yield pd.DataFrame(found, columns=["a", "b", "shared", "joint"])

    def check(pairs: DataFrame, level: int) -> DataFrame:
        sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b")
        return materialise(sided.select("a", "b", "left", "right").mapInPandas(confirm, "a long, b long, shared long, joint long"), f"minhash-checked-{level}")

    # a document as like a centre as this has all its partners in the centre's cluster, by the triangle inequality
    firm, level = min(100, min(CLUSTER_PERCENT, percent) + 100 - percent), 0
    checked = check(pairs, level)
    used = [sets, involved, checked]
    while True:
        loose = mates.join(checked.filter(F.col("shared") * 100 < F.col("joint") * firm).select("a", "b"), ["a", "b"]).select("node", "band", "key")
        left = materialise(loose.join(loose.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"), f"minhash-open-{level}")
        release(mates)
        if left.isEmpty():
            release(left)
            break
        level += 1
        further = F.transform(F.sequence(F.lit(1), F.lit(MORE_BANDS)), lambda k: F.pmod(F.col("band") + k, F.lit(bands)))
        deeper = left.join(reps.select("node", "bands"), "node").select("node", "key", "bands", F.explode(further).alias("band"))
        mates = meet(deeper.select("node", "band", F.xxhash64("key", F.get("bands", F.col("band"))).alias("key")).repartition("key"), level)
        release(left)
        used.append(check(mates.select("a", "b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"), level))
        checked = checked.union(used[-1])
    linked = checked.filter(F.col("shared") * 100 >= F.col("joint") * percent).select("a", "b")
    label = components(linked)

    # clusters of documents that are alike but not yet joined
    cluster = components(checked.filter(F.col("shared") * 100 >= F.col("joint") * min(CLUSTER_PERCENT, percent)).select("a", "b"))
    placed = cluster.select(F.col("id").alias("node"), F.col("component").alias("cluster")).join(label.select(F.col("id").alias("node"), F.col("component").alias("part")), "node", "left")
    placed = materialise(placed.withColumn("part", F.coalesce("part", "node")), "minhash-clusters")
    parts = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("size"))
    whole = parts.groupBy("cluster").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("n"), F.max("size").alias("largest")).filter("n_parts > 1")
    open_ = placed.join(whole, "cluster").join(sets, "node")
    side = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)))
    stray_blocks, member_blocks = side(F.col("n") - F.col("largest")), side(F.col("n"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n)
    strays = open_.filter("part <> main").select("cluster", deal(stray_blocks).alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), member_blocks - 1)).alias("mb"), F.lit(True).alias("stray"), "node", "part", "members")
    others = open_.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), stray_blocks - 1)).alias("sb"), deal(member_blocks).alias("mb"), F.lit(False).alias("stray"), "node", "part", "members")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        """Links between a block of strays and a block of members: at most one for each stray and part."""
        columns = ["a", "b"]
        s, m = group[group["stray"]], group[~group["stray"]]
        if not len(s) or not len(m):
            return pd.DataFrame(columns=columns, dtype="int64")
        held = [np.frombuffer(x, np.uint64) for x in m["members"]]
        sizes, owner = np.array([len(x) for x in held]), np.repeat(np.arange(len(held)), [len(x) for x in held])
        values = np.concatenate(held)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        nodes, own_parts, links = m["node"].to_numpy(), m["part"].to_numpy(), []
        for node, part, packed in zip(s["node"], s["part"], s["members"], strict=True):
            x = np.frombuffer(packed, np.uint64)
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(held))
            near = np.flatnonzero((shared * 100 >= (len(x) + sizes - shared) * percent) & (own_parts != part))
            links += [(node, nodes[k]) for k in near[np.unique(own_parts[near], return_index=True)[1]]]
        return pd.DataFrame(links, columns=columns, dtype="int64")

    late = strays.union(others).groupBy("cluster", "sb", "mb").applyInPandas(settle, "a long, b long")
    # the parts found so far stand for their links
    final = components(label.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(late))
    for done in (*used, placed):
        release(done)
    grouped = reps.join(final, reps["node"] == final["id"], "left").select("digest", "rid", F.coalesce("component", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("rid").alias("component"))
    rep_of = grouped.join(least, "group").select("digest", "component")
    out = signed.select("_id", "n", "digest").join(rep_of, "digest", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup}
ORACLES: dict[str, str] = {}
