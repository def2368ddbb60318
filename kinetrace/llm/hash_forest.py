"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each tree of the forest gives a vector a long string of symbols: a random map to SLOTS coordinates, of which the largest in magnitude and its
sign are a symbol. A tree is the sorted array of the strings of a block of vectors; the vectors below a node are the range that shares its prefix. A query
descends in all trees to the deepest level at which they hold enough vectors together, and the trees ascend together, level by level and then tree after
tree within a level, until the chance that all of them have missed a vector as near as the last one wanted is small: a vector whose
symbols agree with chance p has been missed at depth x by L trees with chance (1 - p^x)^L. The root holds the whole block, so nothing is capped.
Candidates are compared by their exact products.

Inner products become angles: vectors get a coordinate that fills them up to the longest of their block. Blocks hold vectors of like lengths, so
one long vector does not press the others together.

Blocks are cut where rows are read, at a fixed number of rows, so no vector and no cluster makes one block large, and rows are not shuffled. Queries
are broadcast to the blocks in parts of bounded size. A random share of the rows is searched first; the score of each query's last result there lets the
search of the others stop earlier and return little.
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

from kinetrace.llm.blocks import Block, meet, numbered, sent_blocks, to_blocks
from kinetrace.llm.workspace import materialise, row_count
from kinetrace.session import table

#: Trees, symbols of a string, coordinates of which each symbol names one, and bits that a symbol takes.
TREES, SYMBOLS, SLOTS, BITS = 256, 6, 16, 5
#: Rows of a block of vectors at most; the larger, the less of it is compared.
FOREST_ROWS = 16_384
#: Blocks of no more rows are compared whole, which takes less than a descent in all trees.
LEAST_ROWS = 1024
#: Accepted chance that a vector as near as the last result has been missed.
MISS = 0.05
#: One of so many rows is searched first.
FIRST_SHARE = 16
#: Trees that ascend at once when a part of them may be enough.
STEP = 32
GRID = np.linspace(-1, 1, 65)
KINDS = {"vec": "<f8", "goal": "<f8", "sig": "<i4"}


def symbol_chances(seed: int = 11, draws: int = 40_000) -> np.ndarray:
    """The chance that two unit vectors get the same symbol, at the cosines of GRID, by simulation."""
    rng = np.random.default_rng(seed)
    a, noise = rng.standard_normal((2, draws, SLOTS))
    at, row = np.abs(a).argmax(1), np.arange(draws)
    out = []
    for s in GRID:
        b = s * a + np.sqrt(1 - s * s) * noise
        out.append(np.mean((np.abs(b).argmax(1) == at) & (a[row, at] * b[row, at] > 0)))
    return np.array(out)


def strings(unit: np.ndarray, seed: int) -> np.ndarray:
    """The strings of vectors of length 1 in all trees, as whole numbers: (vector, tree)."""
    n, d = unit.shape
    out, unit = np.empty((n, TREES), np.int32), unit.astype(np.float32)
    for first in range(0, TREES, 8):
        trees = range(first, min(first + 8, TREES))
        maps = np.hstack([np.random.default_rng((seed, d, t)).standard_normal((d, SYMBOLS * SLOTS), np.float32) for t in trees])
        for k in range(0, n, 2048):
            turned = (unit[k : k + 2048] @ maps).reshape(-1, SLOTS)
            place = np.abs(turned).argmax(1)
            symbol = (2 * place + (turned[np.arange(len(turned)), place] < 0)).reshape(-1, len(trees), SYMBOLS)
            out[k : k + 2048, first : first + len(trees)] = symbol @ (1 << (BITS * np.arange(SYMBOLS - 1, -1, -1)))
    return out


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors at length 1; their lengths are the product of the other two results, of which the first does not overflow."""
    scale = np.abs(vectors).max(1)
    small = vectors / scale[:, None]
    norm = np.sqrt((small * small).sum(1))
    return small / norm[:, None], norm, scale


def length_class(vectors: np.ndarray) -> np.ndarray:
    """Lengths that differ by less than a factor of the square root of 2 are of one class, or of two that meet between powers of it."""
    _, norm, scale = _units(vectors)
    return np.rint(2 * (np.log2(norm) + np.log2(scale))).astype(np.int64)


class Forest:
    """The sorted arrays of a block of vectors."""

    def __init__(self, block: Block, seed: int, chances: np.ndarray):
        self.block, self.vectors, self.chances = block, block["vec"], chances
        self.rows = len(self.vectors)
        self.by_uid = np.argsort(block["uid"])
        self.planted = self.rows > LEAST_ROWS
        if not self.planted:
            return
        self.scale = np.abs(self.vectors).max()
        small = self.vectors / self.scale
        norms = np.sqrt((small * small).sum(1))
        self.longest = norms.max()
        small = small / self.longest
        fill = np.sqrt(np.maximum(0, 1 - (small * small).sum(1)))
        own = strings(np.hstack([small, fill[:, None]]), seed).T
        self.order = np.argsort(own, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(own, self.order, 1)
        self.flat = self.order.ravel()

    def ranges(self, sig: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in each sorted array of what shares the first ``depth`` symbols with each query: (query, tree)."""
        low, high = np.empty((2, *sig.shape), np.int64)
        shift = BITS * (SYMBOLS - depth)
        for t in range(TREES):
            node = sig[:, t] >> shift
            low[:, t] = np.searchsorted(self.sorted[t], node << shift)
            high[:, t] = np.searchsorted(self.sorted[t], (node + 1) << shift)
        return low, high

    def members(self, low: np.ndarray, high: np.ndarray, trees: slice) -> np.ndarray:
        """The rows within the ranges of some trees, repeated as often as they are there."""
        low, size = low[trees] + np.arange(TREES)[trees] * self.rows, (high - low)[trees]
        upto = np.cumsum(size)
        return self.flat[np.arange(upto[-1]) + np.repeat(low - (upto - size), size)]

    def missed(self, near: float, query_norm: float, query_scale: float, depth: int, ascended: int) -> float:
        """The chance that no tree holds a row of score ``near``, with some trees at ``depth`` and the others one symbol deeper."""
        with np.errstate(all="ignore"):
            cosine = near / self.scale / self.longest / query_norm / query_scale
        if not np.isfinite(cosine):
            return 1.0
        p = np.interp(cosine, GRID, self.chances)
        deeper = p ** (depth + 1) if depth < SYMBOLS else 0.0
        return (1 - p**depth) ** ascended * (1 - deeper) ** (TREES - ascended)

    def search(self, queries: Block, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the nearest found of each query, nearest first, ties to the first row."""
        _, norms, scales = _units(queries["vec"])
        at = np.minimum(np.searchsorted(self.block["uid"], queries["uid"], sorter=self.by_uid), self.rows - 1)
        own = np.where(self.block["uid"][self.by_uid[at]] == queries["uid"], self.by_uid[at], -1)
        found: list = [None] * len(own)
        open_ = np.arange(len(own))
        below = None
        for depth in range(SYMBOLS if self.planted else 0, 0, -1):
            low, high = self.ranges(queries["sig"][open_], depth)
            sizes, left = (high - low).sum(1), []
            for k, q in enumerate(open_):
                enough = sizes[k] > most
                if enough:
                    found[q] = self._ascend(queries["vec"][q], own[q], queries["goal"][q, 0], most, depth, (low[k], high[k]), below and (below[0][k], below[1][k]), norms[q], scales[q])
                if found[q] is None:
                    left.append(k)
            open_, below = open_[left], (low[left], high[left])
            if not len(open_):
                break
        for q in open_:
            found[q] = self._compare(queries["vec"][q], own[q], most, np.arange(self.rows))
        return [self._settled(queries["vec"][q], *found[q], most, queries["goal"][q, 0]) for q in range(len(own))]

    def _ascend(self, query, own, goal, most, depth, ranges, below, norm, scale):
        """The nearest of what the trees hold at ``depth``, or of as many of them as are needed; None if all of them are not enough."""
        if 2 * (ranges[1] - ranges[0]).sum() > self.rows:
            # the trees together hold about the block: go to the root if deeper levels are not enough
            return self._compare(query, own, most, np.arange(self.rows))
        seen = np.zeros(self.rows, bool)
        if below:
            seen[self.members(*below, slice(None))] = True
        rows, scores = self._compare(query, own, most, np.flatnonzero(seen))
        near = max(goal, scores[most - 1] if len(scores) >= most else -np.inf)
        step = STEP if self.missed(near, norm, scale, depth, TREES) <= MISS else TREES
        for first in range(0, TREES, step):
            fresh = np.zeros(self.rows, bool)
            fresh[self.members(*ranges, slice(first, first + step))] = True
            fresh &= ~seen
            seen |= fresh
            more = self._compare(query, own, most, np.flatnonzero(fresh))
            rows, scores = self._cut(np.concatenate([rows, more[0]]), np.concatenate([scores, more[1]]), most)
            near = max(goal, scores[most - 1] if len(scores) >= most else -np.inf)
            if self.missed(near, norm, scale, depth, min(first + step, TREES)) <= MISS:
                return rows, scores
        return None

    def _compare(self, query: np.ndarray, own: int, most: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors if len(rows) == self.rows else self.vectors[rows]) @ query
        scores = np.where(rows == own, -np.inf, np.where(np.isnan(scores), -np.inf, scores))
        return self._cut(rows, scores, most)

    def _cut(self, rows: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best, highest first, and behind them all that rounding may have put behind the last."""
        if len(rows) > most:
            edge = np.partition(scores, len(rows) - most)[len(rows) - most]
            keep = (scores >= edge) | (scores >= edge - 1e-9 * abs(edge)) if np.isfinite(edge) else scores >= edge
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((rows, -scores))
        return rows[order], scores[order]

    def _settled(self, query, rows, scores, most, goal):
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.cumsum(self.vectors[rows] * query, axis=1)[:, -1]
        exact = np.where(np.isnan(exact), -np.inf, exact)
        keep = (scores > -np.inf) & (exact >= goal)
        order = np.lexsort((rows[keep], -exact[keep]))[:most]
        return rows[keep][order], exact[keep][order]


def _search(pairs: Iterator[tuple[Block, Block]], most: int, seed: int, chances: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, forest = None, None
    for own, queries in pairs:
        if own["vec"].shape[1] != queries["vec"].shape[1]:
            continue
        if held != (key := (own["uid"].tobytes(), own["vec"].shape)):
            held, forest = key, Forest({k: x.copy() for k, x in own.items()}, seed, chances)
        found = forest.search(queries, most)
        q = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
        rows, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = pa.array(forest.block["id"][rows], mask=forest.block["none"][rows] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(queries["uid"][q]), pa.array(forest.block["uid"][rows]), ids, pa.array(scores, pa.float64())], schema=schema)


def nearest(rows: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 20, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``query`` holds, the ``most`` rows of the largest inner product found, best first.

    A result is found with a chance of about ``1 - MISS`` at least; scores and order of what is found are exact, in double precision; equal
    scores are ordered by id. All rows but the query's own are candidates, so rows that repeat an id, or are equal, find one another. If
    there are no more than ``most`` others, all are found. Vectors that are null, zero, or have a component that is null or not finite
    take no part. A null id is no special id: it stays null, loses ties to all others, and its row is a query if ``query`` holds for it. Vectors of
    different lengths have no score. A score that overflows is infinite, and a sum of opposite infinite parts counts as the lowest
    and is not returned. An empty table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_col)
    zero = F.coalesce(~F.exists(vector, lambda x: x != 0), F.lit(True))
    held = numbered(rows.filter(~zero), id_col, vector, "hash-forest", wanted=F.coalesce(query, F.lit(False)).cast("int"))
    queries, everyone = held.filter("wanted = 1").drop("wanted"), held.drop("wanted")
    chances, found = symbol_chances(), T.StructType.fromDDL("query_uid long, uid long, vec_id long, score double")
    arrow = to_arrow_schema(found)

    def strings_of(vectors: np.ndarray) -> Block:
        unit, _, _ = _units(vectors)
        return {"sig": strings(np.hstack([unit, np.zeros((len(unit), 1))]), seed)}

    def search(part: DataFrame, goals: Column | None, name: str) -> DataFrame:
        tasks = max(1, -(-10 * row_count(part) // (9 * FOREST_ROWS)))
        blocks = to_blocks(part.coalesce(tasks), FOREST_ROWS, split=length_class)
        asked = queries.withColumn("goal", F.array(F.lit(float("-inf")))) if goals is None else queries.join(goals, "uid", "left").withColumn("goal", F.array(F.coalesce("goal", F.lit(float("-inf")))))
        sent, size = sent_blocks(asked, extra=strings_of, extras={"sig": "<i4"}, row_bytes=4 * TREES)
        return meet(blocks, sent, size, lambda pairs: _search(pairs, most, seed, chances, arrow), "query_uid long, uid long, vec_id long, score double", KINDS, name)

    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    early = F.pmod(F.xxhash64("uid"), F.lit(FIRST_SHARE)) == 0
    first = search(everyone.filter(early), None, "hash-forest-first")
    goals = materialise(best(first).filter(F.col("rank") == most).select(F.col("query_uid").alias("uid"), F.col("score").alias("goal")), "hash-forest-goals")
    others = search(everyone.filter(~early), goals, "hash-forest-others")
    names = queries.select(F.col("uid").alias("query_uid"), F.when(F.col("none") == 0, F.col("id")).alias("query_id"))
    return best(first.unionAll(others)).join(names, "query_uid").select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op13_nearest": op13_nearest}
ORACLES: dict[str, str] = {}
