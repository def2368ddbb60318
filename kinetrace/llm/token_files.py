"""Token files: canonical length-limited Huffman codes of token ids, in independent blocks with bit-offset checkpoints.

A token file is a folder of three Parquet tables, so that any store that Spark writes can hold it:

* ``codebook`` (token, bits): the code length of each id; canonical codes follow from the lengths alone;
* ``blocks`` (part, block, first, doc_ids, doc_tokens, payload, checkpoints): documents in ascending id order. ``first``
  counts the ids before the block within its part, ``checkpoints`` holds the 64-bit bit offset of each ``EVERY``-th id;
* ``parts`` (part, base, n_tokens): the ids before each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetrace.llm import tokens
from kinetrace.llm.workspace import fresh_path, materialise, release, runs
from kinetrace.session import table

#: Longest code (longer only for so many ids that they need it), ids of a block (whole documents, so a long one makes a longer block), ids between checkpoints.
MAX_BITS, BLOCK_TOKENS, EVERY = 16, 1 << 16, 256
END_ID = 1

BLOCKS = "part int, block long, first long, doc_ids array<long>, doc_tokens array<long>, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    layers, level = [], leaf
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        layers.append(rank < len(leaf))
        level = both[rank]
    take, bits = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(layers):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    bits[:take] += 1
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes, code, last = np.zeros(len(bits), np.uint32), 0, 0
    for token in sorted(np.flatnonzero(bits), key=lambda t: (bits[t], t)):
        code <<= int(bits[token]) - last
        codes[token], last = code, int(bits[token])
        code += 1
    return codes


def decode_table(bits: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``limit`` bits, or as many as the longest code has, the id that it starts with, and that id's code length."""
    limit = max(limit, int(bits.max(initial=0)))
    order = np.array(sorted(np.flatnonzero(bits), key=lambda t: (bits[t], t)), np.int64)
    spans = 1 << (limit - bits[order].astype(np.int64))
    ids, lens = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    n = int(spans.sum())
    ids[:n], lens[:n] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return ids, lens


def encode_ids(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bit offset of each ``EVERY``-th of them."""
    if not len(ids):
        return b"", np.zeros(0, "<u8")
    n = bits[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    span = (int(bits.max()) + 14) >> 3  # bytes that a code and what is before it in its first byte take
    word = codes[ids].astype(np.int64) << (8 * span - (starts & 7) - n)
    at, size = starts >> 3, (int(ends[-1]) + 7) // 8 + span
    out = np.zeros(size)
    for k in range(span):
        out += np.bincount(at + k, (word >> (8 * (span - 1 - k))) & 255, size)[:size]
    return out.astype(np.uint8)[:-span].tobytes(), starts[::EVERY].astype("<u8")


def decode_blocks(payloads: list[bytes], marks: list[np.ndarray], counts: list[int], ids: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """The ids of several blocks: every stretch between checkpoints of all blocks is a lane, and all lanes advance together."""
    limit = len(ids).bit_length() - 1
    span = (limit + 14) >> 3
    stream = np.frombuffer(b"".join(p + bytes(span) for p in payloads), np.uint8)
    bases = np.cumsum([0] + [len(p) + span for p in payloads][:-1]) * 8
    at = np.concatenate([m.astype(np.int64) + b for m, b in zip(marks, bases, strict=True)])
    todo = np.concatenate([np.minimum(EVERY, n - np.arange(0, n, EVERY)) for n in counts]).astype(np.int64)
    out = np.zeros((len(at), EVERY), np.uint32)
    lanes = np.argsort(-todo, kind="stable")
    at, todo = at[lanes], todo[lanes]
    live = len(lanes)
    for step in range(EVERY):
        while live and todo[live - 1] <= step:
            live = int(np.searchsorted(-todo[:live], -step, side="left"))
        if not live:
            break
        p, byte = at[:live], at[:live] >> 3
        window = stream[byte].astype(np.int64)
        for k in range(1, span):
            window = window << 8 | stream[byte + k]
        window = (window >> (8 * span - limit - (p & 7))) & ((1 << limit) - 1)
        out[lanes[:live], step] = ids[window]
        at[:live] += lens[window]
    found, lane = [], 0
    for n in counts:
        k = -(-n // EVERY)
        found.append(out[lane : lane + k].reshape(-1)[:n])
        lane += k
    return found


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, whole: bool = False) -> None:
    """Write the token file of ``docs`` below ``path``.

    A null text counts as empty and gives its end id alone; documents with equal ids follow one another, and null ids
    come first. An empty table gives a file without blocks. Only the two named columns are read.
    """
    spark = docs.sparkSession
    schema = T.StructType.fromDDL("_id long, _n long, _ids binary")
    arrow = to_arrow_schema(schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.load(tokenizer_path, whole)
        for batch in batches:
            for run in runs(batch, "_text", tokens.RUN):
                ids = tok.encode(run.column("_text").to_pylist(), end_id)
                yield pa.RecordBatch.from_arrays([run.column("_id"), pa.array([len(x) // tok.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, arrow.field("_ids").type)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    encoded = materialise(rows.mapInArrow(tokenise, schema), "token-ids")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokens.load(tokenizer_path, whole)
        seen = np.zeros(max(tok.size, end_id + 1), np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch["_ids"]), tok.dtype), minlength=len(seen))
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"token": found, "n": seen[found]})

    # one row per id that occurs: bounded by the vocabulary
    counts = encoded.select("_ids").mapInPandas(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    dense[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    bits = code_lengths(dense)
    used = np.flatnonzero(bits)
    spark.createDataFrame(pd.DataFrame({"token": used, "bits": bits[used].astype(np.int32)}), "token long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical_codes(bits), bits))

    blocks = T.StructType.fromDDL(BLOCKS)
    blocks_arrow = to_arrow_schema(blocks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        dtype = tokens.load(tokenizer_path, whole).dtype
        part, block, first, docs_, counts, ids, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload, marks = encode_ids(np.frombuffer(b"".join(ids), dtype), codes, sizes)
            columns = [[part], [block], [first], [docs_], [counts], [payload], [marks.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, blocks_arrow, strict=True)], schema=blocks_arrow)

        for batch in batches:
            for doc, count, packed in zip(*(batch.column(c).to_pylist() for c in ("_id", "_n", "_ids")), strict=True):
                docs_.append(doc)
                counts.append(count)
                ids.append(packed)
                n += count
                if n >= BLOCK_TOKENS:
                    yield flush()
                    block, first, docs_, counts, ids, n = block + 1, first + n, [], [], [], 0
        if docs_:
            yield flush()

    # the number of a row parts documents with equal ids, which else were one range
    ordered = encoded.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("_id", "_n", "_row").sortWithinPartitions("_id", "_n", "_row")
    ordered.select("_id", "_n", "_ids").mapInArrow(encode, blocks).write.parquet(f"{path}/blocks")
    release(encoded)
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens")).toPandas().sort_values("part")
    sums["base"] = sums["n_tokens"].cumsum() - sums["n_tokens"]  # one row per partition
    spark.createDataFrame(sums[["part", "base", "n_tokens"]], "part int, base long, n_tokens long").coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a token file: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    codebook = spark.read.parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(codebook["token"].max()) + 1 if len(codebook) else 1, np.uint8)
    bits[codebook["token"].to_numpy(np.int64)] = codebook["bits"]
    shared = spark.sparkContext.broadcast(decode_table(bits))

    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens = shared.value
        for batch in batches:
            for run in runs(batch, "payload", 2 * BLOCK_TOKENS):
                base, first, doc_ids, counts, payloads, marks = (run.column(c).to_pylist() for c in ("base", "first", "doc_ids", "doc_tokens", "payload", "checkpoints"))
                found = decode_blocks(payloads, [np.frombuffer(m, "<u8") for m in marks], [sum(c) for c in counts], ids, lens)
                for b, f, docs, own, block in zip(base, first, doc_ids, counts, found, strict=True):
                    packed, ends = block.astype("<u4"), np.cumsum(own)
                    texts = [packed[e - n : e] for n, e in zip(own, ends.tolist(), strict=True)]
                    columns = [docs, b + f + ends - np.array(own), own, [zlib.crc32(x) for x in texts], *([[x.tolist() for x in texts]] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "base")), "part")
    return blocks.select("base", "first", "doc_ids", "doc_tokens", "payload", "checkpoints").mapInArrow(decode, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokens.default_path())
    return read_token_files(spark, path)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
