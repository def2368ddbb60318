"""Hard negatives of anchors by blocked dense products.

1. Blocks of anchors are broadcast to blocks of all rows; a product of two blocks of whole numbers in float64 is exact while no sum of
   magnitudes reaches 2^53, which the lengths of the vectors prove (Cauchy-Schwarz); what they do not is multiplied in Python's integers.
2. Each pair of blocks gives its best positives of each anchor; these merge to the best of all blocks.
3. A second pass over the same blocks takes from each the best rows of other labels whose score lies in a window below a positive's,
   for each distinct score of a positive once; these merge in the same way.

Nothing is grouped by label, so a label that holds a third of the rows is spread over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from kinetrace.llm.blocks import Block, best, meet, numbered, sent_blocks, to_blocks, usable
from kinetrace.llm.workspace import materialise
from kinetrace.session import table

EXACT = 2.0**53
#: Scores beyond a 64-bit integer count as its end; the lowest one stands for none.
NONE, LOWEST, HIGHEST = -(2**63), -(2**63) + 1, 2**63 - 1
#: Anchors that are multiplied with a block at once.
ANCHORS = 256
KINDS = {"vec": "<f8", "goals": "<i8"}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, as 64-bit integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms_a, norms_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
        large = ~(norms_b * norms_a.max(initial=0) < EXACT)
        out = np.empty((len(a), len(b)), np.int64)
        out[:, ~large] = a @ b[~large].T
    if large.any():
        whole = [[int(x) for x in row] for row in a.tolist()]
        for k in np.flatnonzero(large):
            row = [int(x) for x in b[k].tolist()]
            out[:, k] = [min(max(sum(x * y for x, y in zip(w, row, strict=True)), LOWEST), HIGHEST) for w in whole]
    return out


def _scored(own: Block, anchors: Block) -> Iterator[tuple[slice, np.ndarray]]:
    if own["vec"].shape[1] == anchors["vec"].shape[1]:
        for k in range(0, len(anchors["uid"]), ANCHORS):
            part = slice(k, k + ANCHORS)
            yield part, products(anchors["vec"][part], own["vec"])


def _positives(pairs: Iterator[tuple[Block, Block]], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for own, anchors in pairs:
        for part, scores in _scored(own, anchors):
            uid, label = anchors["uid"][part], anchors["label"][part]
            scores[(own["label"][None, :] != label[:, None]) | (own["uid"][None, :] == uid[:, None])] = NONE
            r, c = best(scores, most, NONE)
            ids = pa.array(own["id"][c], mask=own["none"][c] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[r], own["uid"][c])] + [ids, pa.array(scores[r, c])], schema=schema)


def _negatives(pairs: Iterator[tuple[Block, Block]], most: int, low: int, high: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for own, anchors in pairs:
        for part, scores in _scored(own, anchors):
            uid, label, goals = anchors["uid"][part], anchors["label"][part], anchors["goals"][part]
            scores[own["label"][None, :] == label[:, None]] = NONE
            for k in range(goals.shape[1]):
                there = np.flatnonzero(goals[:, k] != NONE)
                goal = goals[there, k].tolist()
                # whole numbers n with low * p <= 100 * n <= high * p
                least = np.array([max(-(-low * p // 100), LOWEST) for p in goal], np.int64)
                upto = np.array([min(high * p // 100, HIGHEST) for p in goal], np.int64)
                inside = scores[there]
                inside[(inside < least[:, None]) | (inside > upto[:, None])] = NONE
                r, c = best(inside, most, NONE)
                ids = pa.array(own["id"][c], mask=own["none"][c] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[there][r], np.array(goal, np.int64)[r], own["uid"][c])] + [ids, pa.array(inside[r, c])], schema=schema)


def _first(rows: DataFrame, key: list[str], score: str, id_: str, uid: str, most: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(id_).asc_nulls_last(), uid)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    Components count as ``floor(scale * x)``, a score is the inner product of two vectors, higher ones come first and ties go to the smaller id.
    An anchor's positives are its first ``positives`` other rows of its label; for each of them come the first ``negatives`` rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``; a positive score below 0 leaves none. An anchor without a
    positive, and a positive without a negative, give no row.

    Rows with a null label, a null vector or a component that is null or not finite take no part. A null id is no special id: it stays null, loses
    ties to all others and its row is an anchor if ``anchor`` holds for it. Rows that repeat an id, or are equal, are rows of their own and one another's partners.
    Vectors of different lengths have no score. Scores beyond the range of a long count as its end. Labels are whole numbers. An
    empty table gives an empty result; other columns are ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    # a huge component stays finite under the scale
    whole = F.transform(F.col(vector_col), lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(1.7e308)), F.lit(-1.7e308)))
    whole = F.transform(whole, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    held = numbered(rows.filter(label.isNotNull() & usable(F.col(vector_col))), id_col, whole, "hard-negatives", label=label, anchor=F.coalesce(anchor, F.lit(False)).cast("int"))
    everyone = to_blocks(held.drop("anchor"))
    anchors = held.filter("anchor = 1").drop("anchor")

    found = T.StructType.fromDDL("anchor_uid long, positive_uid long, positive_id long, positive_score long")
    arrow = to_arrow_schema(found)
    sent, size = sent_blocks(anchors)
    near = meet(everyone, sent, size, lambda pairs: _positives(pairs, positives, arrow), found.simpleString()[7:-1].replace(":", " "), KINDS, "hard-negatives-positives")
    near = materialise(_first(near, ["anchor_uid"], "positive_score", "positive_id", "positive_uid", positives).drop("rank"), "hard-negatives-near")

    # the distinct scores of an anchor's positives, and NONE up to their number
    goals = near.groupBy("anchor_uid").agg(F.collect_set("positive_score").alias("goals"))
    goals = goals.select(F.col("anchor_uid").alias("uid"), F.slice(F.concat("goals", F.array_repeat(F.lit(NONE).cast("long"), positives)), 1, positives).alias("goals"))
    kept = T.StructType.fromDDL("anchor_uid long, positive_score long, negative_uid long, negative_id long, negative_score long")
    kept_arrow = to_arrow_schema(kept)
    sent, size = sent_blocks(materialise(anchors.join(goals, "uid"), "hard-negatives-goals"), row_bytes=8 * positives)
    far = meet(everyone, sent, size, lambda pairs: _negatives(pairs, negatives, low, high, kept_arrow), kept.simpleString()[7:-1].replace(":", " "), KINDS, "hard-negatives-window")
    far = _first(far, ["anchor_uid", "positive_score"], "negative_score", "negative_id", "negative_uid", negatives)

    names = anchors.select(F.col("uid").alias("anchor_uid"), F.when(F.col("none") == 0, F.col("id")).alias("anchor_id"))
    return near.join(far, ["anchor_uid", "positive_score"]).join(names, "anchor_uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, b.i AS b, a.l = b.l AS same, list_inner_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.i % 100 = 0 AND a.i <> b.i),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5"""
}
