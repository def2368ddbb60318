"""Packing documents into token sequences: first-fit decreasing with a tournament tree, run in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetrace.llm import tokens
from kinetrace.llm.workspace import row_count, runs
from kinetrace.session import table

#: Tokens of a full sequence; documents that meet in one group on average; the id that ends a document.
CAPACITY, GROUP_DOCS, END_ID = 2048, 2048, 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bin capacities as leaves, each inner node the larger of its children: the first bin that fits is found in log(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The leftmost bin with ``need`` room, which is taken from it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bin_ = node - self.leaves
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length); items of 1 to ``capacity`` tokens, longest first, ties in the order given."""
    tree, bins = Tournament(max(1, len(lengths)), capacity), {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins.setdefault(tree.place(lengths[item]), []).append((item, 0, lengths[item]))
    return [bins[b] for b in sorted(bins)]


def close_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces of the emptiest bins to fill the fullest ones; the last part bin is dealt into powers of two, which need no padding."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted((i for i in range(len(bins)) if used[i] < capacity), key=lambda i: (-used[i], i))
    full = [b for i, b in enumerate(bins) if used[i] == capacity]
    low, high = 0, len(order) - 1
    while low < high:
        taker, giver = order[low], order[high]
        item, start, length = bins[giver].pop()
        moved = min(length, capacity - used[taker])
        if moved < length:
            bins[giver].append((item, start, length - moved))
        bins[taker].append((item, start + length - moved, moved))
        used[taker] += moved
        used[giver] -= moved
        if used[taker] == capacity:
            full.append(bins[taker])
            low += 1
        if not used[giver]:
            high -= 1
    if low == high:
        rest = bins[order[low]]
        left = used[order[low]]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                item, start, length = rest.pop(0)
                take = min(want, length)
                part.append((item, start, take))
                if take < length:
                    rest.insert(0, (item, start + take, length - take))
                want -= take
            full.append(part)
    return full


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 17, whole: bool = False) -> DataFrame:
    """One row per piece of a document, with the sequence and the place in it where the piece lies.

    A null text counts as empty and packs its end id alone; a null id stays null. Long documents give full sequences of their own at once;
    what is left of each, under one sequence, goes to one of rows / ``group_docs`` random groups. The group hangs on the document and
    on how many like it its partition has had before, so no group grows with the input, also not if all documents share an id and a text.
    Repeated rows are packed as often as they occur. An empty table gives an empty result; columns other than the two named are ignored.
    """
    groups = max(1, -(-row_count(docs) // group_docs))
    dealt = T.StructType.fromDDL("_id long, _grp long, _n long, _full array<long>, _tail binary")
    pieces = T.StructType.fromDDL(PIECES)
    dealt_arrow, pieces_arrow = to_arrow_schema(dealt), to_arrow_schema(pieces)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.load(tokenizer_path, whole)
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for run in runs(batch, "_text", tokens.RUN):
                grp, n, full, tails = [], [], [], []
                for id_, ids in zip(run.column("_id").to_pylist(), tok.encode(run.column("_text").to_pylist(), end_id), strict=True):
                    own = xxhash.xxh3_64_intdigest(ids, seed=seed) ^ hash(id_)
                    grp.append(xxhash.xxh3_64_intdigest(f"{id_} {own} {task} {seen[own]}", seed=seed) % groups)
                    seen[own] += 1
                    ids = np.frombuffer(ids, tok.dtype).astype("<u4")
                    cut = len(ids) // capacity * capacity
                    n.append(len(ids))
                    full.append([zlib.crc32(ids[k : k + capacity].tobytes()) for k in range(0, cut, capacity)])
                    tails.append(ids[cut:].astype(tok.dtype).tobytes())
                columns = [run.column("_id"), grp, n, full, tails]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, dealt_arrow, strict=True)], schema=dealt_arrow)

    def place(group: pa.Table) -> pa.Table:
        dtype = tokens.load(tokenizer_path, whole).dtype
        group = group.combine_chunks().sort_by([("_id", "ascending"), ("_n", "ascending"), ("_tail", "ascending")])
        ids, totals, fulls = (group.column(c).to_pylist() for c in ("_id", "_n", "_full"))
        tails = [np.frombuffer(x, dtype).astype("<u4") for x in group.column("_tail").to_pylist()]
        seq, rows = group.column("_grp")[0].as_py() << 32, []
        for doc, total, full in zip(ids, totals, fulls, strict=True):
            for k, crc in enumerate(full):
                rows.append((doc, k * capacity, capacity, crc, total, seq, 0))
                seq += 1
        held = [i for i, t in enumerate(tails) if len(t)]
        for sequence in close_gaps(first_fit_decreasing([len(tails[i]) for i in held], capacity), capacity):
            at = 0
            for item, start, length in sequence:
                i = held[item]
                rows.append((ids[i], totals[i] - len(tails[i]) + start, length, zlib.crc32(tails[i][start : start + length].tobytes()), totals[i], seq, at))
                at += length
            seq += 1
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), pieces_arrow, strict=True)], schema=pieces_arrow)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return texts.mapInArrow(tokenise, dealt).groupBy("_grp").applyInArrow(place, pieces)


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.default_path())


QUERIES = {"op3_pack": op3_pack}
ORACLES: dict[str, str] = {}
