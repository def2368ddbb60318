"""Vectors in blocks: one row of a table holds some thousand vectors as matrices, and pairs of such rows meet in dense products.

Rows are told apart by ``uid``, a number that is written with them, so ids may be null or repeat. A block is bounded in bytes whatever the
length of its vectors; those of another length go to blocks of their own. Within a block rows lie in the order in which ties are broken:
by id, null ids last, then ``uid``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetrace.llm.workspace import materialise, release, row_count, working_on

#: Rows and bytes of vectors in a block at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
#: Bytes of blocks that are broadcast at once; with more, one part after another is.
SENT_BYTES = 32 << 20

Block = dict[str, np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def numbered(rows: DataFrame, id_col: str, vector: Column, name: str, **others: Column) -> DataFrame:
    """``uid, id, none, vec`` and others of the usable rows, written: ``none`` is 1 if the id is null, ``id`` is 0 then."""
    id_ = F.col(id_col).cast("long")
    held = rows.filter(usable(vector)).select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().cast("long").alias("none"), vector.cast("array<double>").alias("vec"), *[c.cast("long").alias(k) for k, c in others.items()])
    return materialise(held.withColumn("uid", F.monotonically_increasing_id()), name)


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def to_blocks(rows: DataFrame, most_rows: int | None = None, split: Callable[[np.ndarray], np.ndarray] | None = None, extra: Callable[[np.ndarray], Block] | None = None, extras: dict[str, str] | None = None) -> DataFrame:
    """One row per block: a binary column for each column of ``rows``, 64-bit numbers one after another, and ``n``, its rows.

    ``split`` gives each vector a number, and a block holds vectors of one number; ``extra`` makes further matrices from the vectors.
    Lists but the vector must be of one length within the table.
    """
    most_rows, full = most_rows or BLOCK_ROWS, BLOCK_BYTES * (most_rows or BLOCK_ROWS) // BLOCK_ROWS
    names = [f.name for f in rows.schema.fields]
    lists = {f.name: "<f8" if f.dataType.elementType == T.DoubleType() else "<i8" for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)}
    more = list(extras or {})
    arrow = to_arrow_schema(T.StructType.fromDDL(", ".join(["n int", *(f"`{c}` binary" for c in [*names, *more])])))

    def block(part: pa.Table) -> pa.RecordBatch:
        data = {c: _matrix(part.column(c).combine_chunks(), lists[c]) if c in lists else part.column(c).to_numpy().astype("<i8") for c in names}
        order = np.lexsort((data["uid"], data["id"], data["none"]))
        data = {c: np.ascontiguousarray(x[order]) for c, x in data.items()}
        if extra:
            data |= extra(data["vec"])
        return pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int32()), *(pa.array([data[c].tobytes()], pa.binary()) for c in [*names, *more])], schema=arrow)

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        sizes = pa.compute.list_value_length(whole.column("vec")).to_numpy()
        for size in np.unique(sizes):
            part = whole.filter(pa.array(sizes == size))
            kinds = split(_matrix(part.column("vec").combine_chunks(), "<f8")) if split else np.zeros(part.num_rows)
            step = max(1, min(most_rows, full // max(1, 8 * int(size))))
            for kind in np.unique(kinds):
                own = part.filter(pa.array(kinds == kind))
                for k in range(0, own.num_rows, step):
                    yield block(own.slice(k, step))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held, bytes_held = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows_held, bytes_held = rows_held + batch.num_rows, bytes_held + batch.nbytes
            if rows_held >= most_rows or bytes_held >= 4 * full:
                yield from cut(held)
                held, rows_held, bytes_held = [], 0, 0
        if rows_held:
            yield from cut(held)

    return rows.mapInArrow(gather, T.StructType.fromDDL(", ".join(["n int", *(f"`{c}` binary" for c in [*names, *more])])))


def opened(batch: pa.RecordBatch, row: int, kinds: dict[str, str], prefix: str = "") -> Block:
    """A block of a batch as arrays; ``vec`` and what has more numbers than rows as matrices. ``kinds`` are types other than 64-bit integers."""
    n = batch.column(f"{prefix}n")[row].as_py()
    found = {}
    for name in batch.schema.names:
        if name.startswith(prefix) and name != f"{prefix}n" and pa.types.is_binary(batch.schema.field(name).type):
            own = name.removeprefix(prefix)
            flat = np.frombuffer(batch.column(name)[row].as_buffer(), kinds.get(own, "<i8"))
            found[own] = flat if len(flat) == n and own not in kinds else flat.reshape(n, -1 if len(flat) else 0)
    return found


def meet(blocks: DataFrame, sent: DataFrame, sent_bytes: int, work: Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, kinds: dict[str, str], name: str) -> DataFrame:
    """What ``work`` makes of each block with each block of ``sent``, written.

    ``sent`` is cut into parts of at most about SENT_BYTES, and these are broadcast, one part after another if there are several, so what
    an executor holds has a bound at any size of either table; the blocks are read once for each part. ``sent_bytes`` is the size of all of ``sent``.
    """
    parts = max(1, -(-sent_bytes // SENT_BYTES))
    there = materialise(sent.select(*[F.col(c).alias(f"s_{c}") for c in sent.columns], F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")), f"{name}-sent")
    out = T.StructType.fromDDL(schema)
    types = {k: v for k, v in kinds.items()}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
        for batch in batches:
            for row in range(batch.num_rows):
                theirs = opened(batch, row, types, "s_")
                own = opened(batch.select([c for c in batch.schema.names if not c.startswith("s_")]), row, types)
                yield own, theirs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on(name)
        return work(pairs(batches))

    done = []
    for k in range(parts):
        joined = blocks.withColumn("part", F.explode(F.array(F.lit(k)))).join(F.broadcast(there.filter(F.col("part") == k)), "part").drop("part")
        done.append(materialise(joined.mapInArrow(run, out), f"{name}-{k}"))
    release(there)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionAll(part)
    return whole


def sent_blocks(rows: DataFrame, **options) -> tuple[DataFrame, int]:
    """Rows in as few blocks as hold them, made where they are read, and an upper bound of the bytes of these."""
    size = rows.agg(F.sum(F.size("vec") * 8 + 8 * len(rows.columns) + F.lit(options.pop("row_bytes", 0)))).first()[0] or 0
    n = row_count(rows)
    tasks = max(1, -(-n // BLOCK_ROWS), -(-size // SENT_BYTES))
    return to_blocks(rows.coalesce(tasks), **options), size


def best(scores: np.ndarray, most: int, least) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` highest scores above ``least`` of each row, highest first, ties to the first column."""
    m = scores.shape[1]
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if m > most:
        edge = np.partition(scores, m - most, axis=1)[:, m - most]
        r, c = np.nonzero((scores >= edge[:, None]) & (scores > least))
    else:
        r, c = np.nonzero(scores > least)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(scores)))
    keep = np.arange(len(r)) - first[r] < most
    return r[keep], c[keep]
