"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces that cover a word form a lattice. Forward filtering sums the weights of all ways to reach each place; backward sampling then draws a
segmentation from its end, each with its posterior probability. The draws depend on the seed, the row's key and the place in the row alone, so
any executor gives the same segmentation of a row again.

Pieces never reach across the start of a run of spaces, a line feed, or the place between a letter and a mark that no piece has behind a letter, so
lattices are those of words; each distinct word is filtered once while it is remembered, and all its occurrences are sampled together.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinetrace.llm.words import mix
from kinetrace.llm.workspace import cached, runs, working_on
from kinetrace.session import table

SPACE = "▁"
#: Marks that part words from what follows if no piece of the model holds one behind a letter or digit.
MARKS = ".,;:!?)"
#: Words that a Python worker remembers, code points that are sampled together, extra cost (in nats) of a byte piece.
CACHE_WORDS, RUN, BYTE_COST = 200_000, 400_000, 12.0
#: Piece of rank r has weight -ln(r + RANK_OFFSET) - ln(H), where H makes these weights a distribution.
RANK_OFFSET = 20.0
#: Exponent of the weights: over 1 favours likely segmentations, 0 makes all alike.
SHARPNESS = 0.5
#: Words beyond this many characters are filtered one by one.
LONG_WORD = 200
BASE = 0x9E3779B97F4A7C15
STEP, PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)

def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_loaded: dict[tuple[str, float], PieceSampler] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceSampler:
    """Lattices of words over the pieces of a model."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        odd = [i for i, t in text.items() if " " in t.lstrip(" ") or "\n" in t and t != "\n"]
        if odd:
            raise ValueError(f"pieces such as {text[odd[0]]!r} reach across words")
        scores = np.array([model.get_score(i) for i in plain])
        if (scores == np.round(scores)).all():  # merge ranks, not log probabilities
            ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
            scores = -np.log(ranks + RANK_OFFSET)
            scores -= np.log(np.exp(scores).sum())
        behind = {b for t in text.values() for a, b in zip(t, t[1:], strict=False) if a.isalnum()}
        marks = "".join(m for m in MARKS if m not in behind)
        self.word = re.compile((rf" *[^\W_]++(?=[{re.escape(marks)}])|" if marks else "") + r" +[^ \n]*|[^ \n]+|\n")
        self.pieces = {text[i]: (i, sharpness * float(s)) for i, s in zip(plain, scores, strict=True)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_cost, self.longest = sharpness * BYTE_COST, max(map(len, self.pieces))
        self.tables = {}
        for length in range(1, self.longest + 1):
            held = [(t, i, w) for t, (i, w) in self.pieces.items() if len(t) == length]
            codes = np.frombuffer("".join(t for t, _, _ in held).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(held), length)
            hashes = ((codes + np.uint64(1)) * _powers(BASE, length)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            self.tables[length] = hashes[order], np.array([i for _, i, _ in held], np.int64)[order], np.array([w for _, _, w in held])[order]
        self.output = [text[i].encode() if i in text else b"" for i in range(n)]
        for byte, i in self.byte_ids.items():
            self.output[i] = bytes([byte])
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.base, self.size = array("q"), array("q")
        self.cumulative, self.start, self.piece = array("d"), array("i"), array("i")
        self.nodes = 0

    def _learn(self, words: list[str]) -> None:
        """Forward filtering of many words at once, place by place: the share of each edge into a node among all ways to reach it.

        A character that is no piece is minus its code.
        """
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        n = len(codes)
        place = np.arange(n) - np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - place
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        inverse = _powers(pow(BASE, -1, 1 << 64), n)
        starts, ends, pieces, weights = [], [], [], []
        for length, (hashes, ids, held) in self.tables.items():
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            own = (sums[at + length] - sums[at]) * inverse[at]
            found = np.searchsorted(hashes, own)
            found[found == len(hashes)] = 0
            hit = hashes[found] == own
            starts.append(at[hit])
            ends.append(at[hit] + length - 1)
            pieces.append(ids[found[hit]])
            weights.append(held[found[hit]])
            if length == 1:
                odd = at[~hit]
                wide = 1 + (codes[odd] > 0x7F).astype(int) + (codes[odd] > 0x7FF) + (codes[odd] > 0xFFFF)
                starts.append(odd)
                ends.append(odd)
                pieces.append(-codes[odd].astype(np.int64) - 1)
                weights.append(-self.byte_cost * wide)
        start, end, piece, weight = (np.concatenate(x) for x in (starts, ends, pieces, weights))
        spread = self.longest + 1  # one integer sorts an edge by the place of its end, its end and its start
        order = np.argsort((place[end] * n + end) * spread + start - end)
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        share, reach = np.empty(len(order)), np.zeros(n + 1)
        head = place[start] == 0
        steps = np.append(np.flatnonzero(np.diff(place[end], prepend=-1)), len(order))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            value = weight[a:b] + np.where(head[a:b], 0.0, reach[start[a:b] - 1])
            nodes = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            many = np.diff(np.append(nodes, b - a))
            top = np.maximum.reduceat(value, nodes)
            ways = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(ways, nodes)
            reach[end[a:b][nodes]] = top + np.log(total)
            share[a:b] = ways / np.repeat(total, many)
        order = np.argsort(end * spread + start - end)
        start, end, piece, share = start[order], end[order], piece[order], share[order]
        nodes = np.flatnonzero(np.diff(end, prepend=-1))
        last = np.append(nodes[1:], len(end)) - 1
        run = np.cumsum(share)
        run -= np.repeat(run[nodes] - share[nodes], np.diff(np.append(nodes, len(end))))
        run[last] = 1.0
        self.words.update(zip(words, range(len(self.base), len(self.base) + len(words)), strict=True))
        self.base.frombytes((self.nodes + first).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int64).tobytes())
        self.cumulative.frombytes((self.nodes + end + 1 + np.minimum(run, 1.0)).tobytes())
        self.start.frombytes(place[start].astype(np.int32).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        self.nodes += n

    def _learn_long(self, word: str) -> None:
        """As ``_learn`` for one word of any length, in one pass over its characters."""
        self.words[word] = len(self.base)
        self.base.append(self.nodes)
        self.size.append(len(word))
        reach, pieces, longest = [0.0], self.pieces, self.longest
        for end in range(1, len(word) + 1):
            edges = []
            for start in range(max(0, end - longest), end):
                held = pieces.get(word[start:end])
                if held:
                    edges.append((start, held[0], reach[start] + held[1]))
            if word[end - 1] not in pieces:
                edges.append((end - 1, -ord(word[end - 1]) - 1, reach[end - 1] - self.byte_cost * len(word[end - 1].encode("utf-8", "surrogatepass"))))
            top = max(e[2] for e in edges)
            weights = [math.exp(e[2] - top) for e in edges]
            total, at = sum(weights), self.nodes + end
            reach.append(top + math.log(total))
            run = 0.0
            for (start, piece, _), weight in zip(edges[:-1], weights, strict=False):
                run += weight
                self.cumulative.append(at + run / total)
                self.start.append(start)
                self.piece.append(piece)
            self.cumulative.append(at + 1.0)
            self.start.append(edges[-1][0])
            self.piece.append(edges[-1][1])
        self.nodes += len(word)

    def _sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self._forget()
        words, counts = [], []
        for text in texts:
            own = self.word.findall(" " + text) if text else []
            words += own
            counts.append(len(own))
        new = set(words).difference(self.words)
        long = [w for w in new if len(w) > LONG_WORD]
        for word in long:
            self._learn_long(word)
        new.difference_update(long)
        if new:
            self._learn(list(new))
        which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        counts = np.array(counts, np.int64)
        first = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(texts)), counts)
        noise = mix(keys)[row] + (np.arange(len(words)) - first[row]).astype(np.uint64) * PLACE
        base, at = np.frombuffer(self.base, np.int64)[which] if len(which) else which, np.frombuffer(self.size, np.int64)[which].copy() if len(which) else which
        cumulative, start, piece = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((self.cumulative, np.float64), (self.start, np.int32), (self.piece, np.int32)))
        live, drawn = np.argsort(which, kind="stable"), []  # equal words side by side, as their edges are
        while len(live):  # backward sampling, a piece of every word at a time
            u = (mix(noise[live] + np.uint64(len(drawn) * int(STEP) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(cumulative, (base[live] + at[live]) + u, side="right")
            drawn.append((live, piece[edge]))
            left = start[edge]
            at[live] = left
            live = live[left > 0]
        sizes = np.zeros(len(words), np.int64)
        for k, (live, _) in enumerate(drawn):
            sizes[live] = k + 1
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for k, (live, found) in enumerate(drawn):
            out[ends[live] - 1 - k] = found
        bounds = np.append(0, np.append(0, ends)[first + counts])
        if (out < 0).any():
            out, bounds = self._spell(out, bounds)
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _spell(self, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by the pieces of their bytes."""
        odd = np.flatnonzero(out < 0)
        codes, back = np.unique(out[odd], return_inverse=True)
        spelt = [[self.byte_ids[b] for b in chr(-int(c) - 1).encode("utf-8", "surrogatepass")] for c in codes]
        sizes = np.ones(len(out), np.int64)
        sizes[odd] = np.array([len(s) for s in spelt])[back]
        moved = np.append(0, np.cumsum(sizes))
        long = np.repeat(out, sizes)
        for k in range(4):
            has = np.array([len(s) > k for s in spelt])[back]
            long[moved[odd[has]] + k] = np.array([s[k] if len(s) > k else 0 for s in spelt])[back[has]]
        return long, moved[bounds]

    def encode(self, texts: list[str], keys: np.ndarray) -> list[bytes]:
        """A sampled segmentation of each text as packed ids; ``keys`` are 64-bit integers that seed the rows."""
        out, k = [], 0
        while k < len(texts):
            a, n = k, 0
            while k < len(texts) and n < RUN:
                n, k = n + len(texts[k]), k + 1
            out += [ids.astype(self.dtype).tobytes() for ids in self._sample(texts[a:k], keys[a:k])]
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        """The text of each sequence of ids, whichever segmentation it is."""
        held = self.output
        return [b"".join(map(held.__getitem__, np.frombuffer(p, self.dtype).tolist())).decode("utf-8", "surrogatepass")[1:] for p in packed]


def load(path: str, sharpness: float = SHARPNESS) -> PieceSampler:
    working_on("pieces")
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = PieceSampler(path, sharpness)
    return _loaded[path, sharpness]


cached(_loaded.clear)


def row_keys(column: pa.Array, seed: int) -> np.ndarray:
    """64 bits for each key's text; a null is a key of its own."""
    named = ("" if k is None else str(k) for k in column.to_pylist())
    return np.array([xxhash.xxh3_64_intdigest(k.encode(), seed=seed) for k in named], np.uint64)


def encode_pieces(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """``key_col, text_col`` and ``pieces``: little-endian 16-bit ids (32-bit for more than 65536 pieces) of a sampled segmentation.

    A null text counts as empty and has no pieces. Rows with equal keys and texts get equal segmentations; a null key is a key of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key_col).alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("pieces", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path, sharpness)
        for batch in batches:
            for run in runs(batch, "_text", RUN):
                packed = sampler.encode(run.column("_text").to_pylist(), row_keys(run.column("_key"), seed))
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(packed, arrow.field("pieces").type)], schema=arrow)

    out = rows.mapInArrow(encode, schema)
    return out.select(F.col("_key").alias(key_col), F.col("_text").alias(text_col), "pieces")


def decode_pieces(encoded: DataFrame, model_path: str, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``out_col``; a column of that name is replaced, null ids give null."""
    rows = encoded.drop(out_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path)
        for batch in batches:
            for run in runs(batch, pieces_col, 2 * RUN):
                held = run.column(pieces_col).to_pylist()
                texts = iter(sampler.decode([p for p in held if p is not None]))
                decoded = pa.array([None if p is None else next(texts) for p in held], arrow.field(out_col).type)
                yield pa.RecordBatch.from_arrays([*run.columns, decoded], schema=arrow)

    return rows.mapInArrow(decode, schema)


def encode_and_verify(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = SHARPNESS) -> DataFrame:
    """``key_col, pieces, decoded, lossless``: as encoding and then decoding, in one pass with one Python worker, a run of texts at a time."""
    rows = docs.select(F.col(key_col).alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema["_key"], *T.StructType.fromDDL("pieces binary, decoded string, lossless boolean").fields])
    arrow = to_arrow_schema(schema)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = load(model_path, sharpness)
        for batch in batches:
            for run in runs(batch, "_text", RUN):
                texts = run.column("_text").to_pylist()
                packed = sampler.encode(texts, row_keys(run.column("_key"), seed))
                decoded = sampler.decode(packed)
                columns = [packed, decoded, [x == y for x, y in zip(decoded, texts, strict=True)]]
                yield pa.RecordBatch.from_arrays([run.column("_key"), *(pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(columns))], schema=arrow)

    return rows.mapInArrow(both, schema).withColumnRenamed("_key", key_col)


def op8_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    done = encode_and_verify(table(spark, sf_dir, "documents"), default_path())
    return done.select("doc_id", (F.octet_length("pieces") / 2).cast("long").alias("n_pieces"), F.crc32("pieces").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")


QUERIES = {"op8_sampled_pieces": op8_sampled_pieces}
ORACLES: dict[str, str] = {}
