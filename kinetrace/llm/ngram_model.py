"""Language-model scoring with Elias-Fano n-gram tries, dealt over the cluster.

The model is a bigram model with a Dirichlet prior on add-half word probabilities: p(w | v) = (c(v, w) + M p(w)) / (c(v) + M). Each word keeps
its pairs. The ``SENT_WORDS`` most frequent words have short ids that every executor knows; all others go by their 64-bit hashes, and each shard
numbers those it meets. M maximises the leave-one-out likelihood of all training tokens.

Word pairs are dealt by hash to shards. Each shard is a trie in one buffer: contexts, monotone pointers to their successors, and the successors
made monotone by their context's rank, all as Elias-Fano sequences, with a quantised smoothed log probability relative to backing
off. Documents send their pairs to the shards and get sums back, so nothing that grows with the corpus is sent to every executor. Pairs of the
``HEAD`` most frequent words, which would be the hot keys, are kept in one bounded table that every executor has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.words import CHUNK, chunks, mix, word_hashes
from kinetrace.llm.workspace import give_back, materialise, release
from kinetrace.session import table

#: Words with ids; words whose pairs every executor has; both bound what is broadcast: 16 and 2 MB.
SENT_WORDS, HEAD = 1 << 19, 512
#: With a number, only so many words keep their pairs and the others share class 0; no limit otherwise.
MOST_CLASSES: int | None = None
#: Training tokens of a shard, fewest shards, and bytes of text that are worked on together.
SHARD_TOKENS, LEAST_SHARDS, RUN_BYTES = 4_000_000, 48, 4 << 20
#: Steps of a quantised value, bits of a class in a pair.
STEPS, CLASS_BITS = (1 << 16) - 1, 24
#: Strengths of the prior to choose from.
STRENGTHS = 2.0 ** np.arange(0, 25)
END = np.uint64(0xE4D0E4D0E4D0E4D1)


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary, about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(high, bitorder="little")
        self.ones = np.flatnonzero(bits)[:n]
        zeros = np.flatnonzero(bits == 0)
        #: index of the first element of each bucket of equal high bits
        self.starts = zeros - np.arange(len(zeros))

    @staticmethod
    def pack(values: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(header, buffer) of a sequence."""
        n = len(values)
        values = values.astype(np.uint64)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        lows = values & np.uint64((1 << low_bits) - 1)
        planes = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            planes[:, k] = (lows >> np.uint64(k)) & np.uint64(1)
        low = np.packbits(planes.reshape(-1), bitorder="little").tobytes() + bytes(8)
        highs = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(highs[-1]) if n else 0) + 2, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return np.array([n, low_bits, len(low), len(high)], "<i8"), low + high

    @classmethod
    def open(cls, header: np.ndarray, buffer: memoryview) -> EliasFano:
        n, low_bits, low, high = header.tolist()
        return cls(n, low_bits, np.frombuffer(buffer, np.uint8, low), np.frombuffer(buffer, np.uint8, high, low))

    def _low(self, at: np.ndarray) -> np.ndarray:
        place = at * self.low_bits
        byte, word = place >> 3, np.zeros(len(at), np.uint64)
        for k in range(7):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self.ones[at] - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first index of each value, -1 if it is not there."""
        bucket = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = bucket < len(self.starts)
        bucket = np.where(inside, bucket, 0)
        before = np.where(bucket > 0, self.starts[np.maximum(bucket - 1, 0)], 0)
        lo, hi = np.where(inside, before, 0), np.where(inside, np.minimum(self.starts[bucket], self.n), 0)
        end, want = hi.copy(), values & np.uint64((1 << self.low_bits) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:  # bisection among equal high bits
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        held = np.flatnonzero(lo < end)
        found = np.full(len(values), -1, np.int64)
        same = self._low(lo[held]) == want[held]
        found[held[same]] = lo[held[same]]
        return found


class Trie:
    """Pairs of classes in one read-only buffer; ``values`` holds what is known of each pair."""

    LEVELS = 3

    def __init__(self, buffer: bytes):
        view = memoryview(buffer)
        head = np.frombuffer(view, "<i8", 4 * self.LEVELS).reshape(self.LEVELS, 4)
        at, levels = head.nbytes, []
        for header in head:
            size = int(header[2] + header[3])
            levels.append(EliasFano.open(header, view[at : at + size]))
            at += size
        self.contexts, self.pointers, self.successors = levels

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        """The buffer of sorted distinct pair keys (context << CLASS_BITS | successor)."""
        contexts, first = np.unique(keys >> np.uint64(CLASS_BITS), return_index=True)
        pointers = np.append(first, len(keys)).astype(np.uint64)
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(pointers.astype(np.int64)))
        relative = rank << np.uint64(CLASS_BITS) | keys & np.uint64((1 << CLASS_BITS) - 1)
        packed = [EliasFano.pack(x) for x in (contexts, pointers, relative)]
        return b"".join(h.tobytes() for h, _ in packed) + b"".join(b for _, b in packed)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each pair, or -1: the context's rank, then its successor relative to that."""
        rank = self.contexts.find(keys >> np.uint64(CLASS_BITS))
        found, known = np.full(len(keys), -1, np.int64), np.flatnonzero(rank >= 0)
        wanted = rank[known].astype(np.uint64) << np.uint64(CLASS_BITS) | keys[known] & np.uint64((1 << CLASS_BITS) - 1)
        found[known] = self.successors.find(wanted)
        return found

    def keys(self) -> np.ndarray:
        sizes = np.diff(self.pointers.get(np.arange(self.pointers.n)).astype(np.int64))
        contexts = np.repeat(self.contexts.get(np.arange(self.contexts.n)), sizes)
        return contexts << np.uint64(CLASS_BITS) | self.successors.get(np.arange(self.successors.n)) & np.uint64((1 << CLASS_BITS) - 1)


@dataclass
class Classes:
    """The frequent words: sorted hashes with their ids, and of each id its training count and probability; 0 stands for all other words.

    If the classes are ``open``, 0 has no pairs and the other words are told apart by their hashes.
    """

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    head: int
    open: bool = True

    def __post_init__(self):
        self.norm = self.tokens + 0.5 * (self.kinds + 1)
        self.share = (self.counts + 0.5) / self.norm
        self.share[0] = max(1e-300, 1.0 - self.share[1:].sum())

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, self.ids[at], 0)

    def split(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, pair keys, which pairs have a word without id, those pairs' words: the id or else the hash)."""
        ids = self.of(tokens)
        keys, before = _pairs(ids, starts), _before(starts)
        odd = ((ids == 0) | (ids[before] == 0)) & self.open
        code = np.where(ids == 0, tokens, ids.astype(np.uint64))
        return ids, keys, odd, np.stack([code[before[odd]], code[odd]], axis=1)

    def shard_of(self, codes: np.ndarray, shards: int) -> np.ndarray:
        """Shards of pairs with a word without id: that of its second word if that has none, else of its first."""
        return (mix(np.where(self.rare(codes[:, 1]), codes[:, 1], codes[:, 0])) % np.uint64(shards)).astype(np.int64)

    def rare(self, codes: np.ndarray) -> np.ndarray:
        return codes >= np.uint64(len(self.counts))

    def local(self, codes: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair keys, whether the shard knows both words), words without id numbered by their places in the sorted ``rare`` of a shard."""
        at = np.searchsorted(rare, codes)
        at[at == len(rare)] = 0
        odd = self.rare(codes)
        known = ~odd | (rare[at] == codes if len(rare) else False)
        ids = np.where(odd, np.uint64(len(self.counts)) + at.astype(np.uint64), codes)
        if len(self.counts) + len(rare) >= 1 << CLASS_BITS:
            raise ValueError("a shard has more words than its pairs can number")
        return ids[:, 0] << np.uint64(CLASS_BITS) | ids[:, 1], known.all(axis=1)

    def with_rare(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and shares of the ids and the words of a shard that occur ``n`` times."""
        return np.append(self.counts, n), np.append(self.share, (n + 0.5) / self.norm)


@dataclass
class NgramModel:
    classes: Broadcast
    shards: int
    strength: float
    words: DataFrame
    tries: DataFrame
    head: Broadcast


def fifth(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def _tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end behind its words, and the first token of each text and the end."""
    # hashing takes many times the bytes of a text, so it is done some texts at a time
    run = np.cumsum([len(r) + 1 for r in raws]) // CHUNK
    edges = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(raws))
    parts = [word_hashes(raws[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    words, sizes = np.concatenate([w for w, _ in parts]), np.concatenate([np.diff(b) for _, b in parts])
    starts = np.cumsum(np.append(0, sizes + 1))
    out = np.full(starts[-1], END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(raws)), sizes)] = words
    return out, starts


def _before(starts: np.ndarray) -> np.ndarray:
    """The place of the token before each; the first token of a text follows the end."""
    before = np.arange(-1, starts[-1] - 1)
    before[starts[:-1]] = starts[1:] - 1
    return before


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard that keeps places, and (shard, from, to) of each shard's run in it."""
    order = np.argsort(shard, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    return order, [(int(shard[order[a]]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pairs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pair key of each token with the one before it; the first token of a text follows the end."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts[:-1]] = ids[starts[1:] - 1]
    return before.astype(np.uint64) << np.uint64(CLASS_BITS) | ids.astype(np.uint64)


def _in_head(keys: np.ndarray, head: int) -> np.ndarray:
    a, b = keys >> np.uint64(CLASS_BITS), keys & np.uint64((1 << CLASS_BITS) - 1)
    return (a <= head) & (b <= head)


def _squeezed(parts: list[bytes]) -> bytes:
    """One cell of several byte strings, compressed apart from one another."""
    press = zstandard.ZstdCompressor(level=1)
    frames = [press.compress(p) for p in parts]
    return np.array([len(parts), *map(len, frames)], "<i8").tobytes() + b"".join(frames)


def _spread(cell: bytes) -> list[bytes]:
    count = int(np.frombuffer(cell, "<i8", 1)[0])
    ends = 8 * (count + 1) + np.cumsum(np.frombuffer(cell, "<i8", count, 8))
    return [zstandard.ZstdDecompressor().decompress(cell[a:b]) for a, b in zip([8 * (count + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _bytes_apart(values: np.ndarray, width: int) -> list[bytes]:
    """The lowest bytes of integers, equal places together, which compresses well."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return [planes[:, k].tobytes() for k in range(width)]


def _bytes_joined(planes: list[bytes]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane, np.uint8)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _squeezed(_bytes_apart(keys, 6))


def _unpacked_keys(cell: bytes) -> np.ndarray:
    return _bytes_joined(_spread(cell))


def _packed_codes(codes: np.ndarray) -> bytes:
    """Pairs of ids or hashes: which are hashes, those, and the ids in three bytes."""
    flat = codes.reshape(-1)
    large = flat >= np.uint64(1 << CLASS_BITS)
    return _squeezed([np.packbits(large).tobytes(), flat[large].astype("<u8").tobytes(), *_bytes_apart(flat[~large], 3)])


def _unpacked_codes(cell: bytes) -> np.ndarray:
    bits, hashes, *ids = _spread(cell)
    hashes, ids = np.frombuffer(hashes, "<u8"), _bytes_joined(ids)
    flat = np.zeros(len(hashes) + len(ids), np.uint64)
    large = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(flat)).astype(bool)
    flat[large], flat[~large] = hashes, ids
    return flat.reshape(-1, 2)


def _packed_counts(n: np.ndarray) -> bytes:
    return _squeezed([n.astype("<i8").tobytes()])


def _unpacked_counts(cell: bytes) -> np.ndarray:
    return np.frombuffer(_spread(cell)[0], "<i8")


def _texts(batch: pd.DataFrame) -> Iterator[tuple[int, list[bytes]]]:
    yield from chunks(batch["_text"].tolist(), RUN_BYTES)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of docs (_text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, raws in _texts(batch):
                words, n = np.unique(_tokens(raws)[0], return_counts=True)
                yield pd.DataFrame({"word": words.view(np.int64), "n": n})
            give_back()

    return docs.select("_text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(words: DataFrame) -> Classes:
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    sizes = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)  # one row per frequency
    fits = sizes[sizes["words"].cumsum() <= (SENT_WORDS if MOST_CLASSES is None else MOST_CLASSES)]
    least = int(fits["n"].min()) if len(fits) else None
    top = words.filter(F.col("n") >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "n": []})
    hashes, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    rank = np.lexsort((hashes, -n))
    counts = np.append(total["tokens"] - n.sum(), n[rank]).astype(np.float64)
    ids = np.empty(len(rank), np.int64)
    ids[rank] = np.arange(1, len(rank) + 1)
    order = np.argsort(hashes)
    return Classes(hashes[order], ids[order], counts, int(total["tokens"]), int(total["kinds"]), HEAD, MOST_CLASSES is None)


def train(docs: DataFrame, text_col: str = "text") -> NgramModel:
    """A model of all texts of ``docs``; a null text counts as empty and has its end as only token."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(text_col, F.lit("")).alias("_text"))
    words = materialise(count_words(rows), "lm-words")
    classes = _frequent(words)
    shards = max(LEAST_SHARDS, -(-classes.tokens // SHARD_TOKENS))
    shared = spark.sparkContext.broadcast(classes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, head = ["shard", "keys", "counts", "odd", "head", "head_n"], np.zeros((shared.value.head + 1) ** 2, np.int64)
        for batch in batches:
            for _, raws in _texts(batch):
                tokens, starts = _tokens(raws)
                _, keys, odd, codes = shared.value.split(tokens, starts)
                keys, n = np.unique(keys[~odd], return_counts=True)
                top = _in_head(keys, shared.value.head)
                head[_head_place(keys[top], shared.value.head)] += n[top]
                keys, n = keys[~top], n[~top]
                shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                order, runs = _by_shard(shard)
                out = [(k, _packed_keys(keys[order[a:b]]), _packed_counts(n[order[a:b]]), None, None, None) for k, a, b in runs]
                order, runs = _by_shard(shared.value.shard_of(codes, shards))
                out += [(k, None, None, _packed_codes(codes[order[a:b]]), None, None) for k, a, b in runs]
                yield pd.DataFrame(out, columns=columns)
            give_back()
        seen = np.flatnonzero(head)
        yield pd.DataFrame([(-1, None, None, None, seen.tolist(), head[seen].tolist())], columns=columns)

    counted = materialise(rows.mapInPandas(count, "shard long, keys binary, counts binary, odd binary, head array<int>, head_n array<long>"), "lm-pairs")
    heads = counted.filter("shard < 0").select(F.explode(F.arrays_zip("head", "head_n")).alias("x")).groupBy("x.head").agg(F.sum("x.head_n").alias("n")).toPandas()
    dense = np.zeros((HEAD + 1) ** 2, np.int64)
    dense[heads["head"].to_numpy(np.int64)] = heads["n"].to_numpy(np.int64)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.zeros(0, np.uint64), *[_unpacked_keys(x) for x in group["keys"].dropna()]])
        n = np.concatenate([np.zeros(0, np.int64), *[_unpacked_counts(x) for x in group["counts"].dropna()]])
        codes = np.concatenate([np.zeros((0, 2), np.uint64), *[_unpacked_codes(x) for x in group["odd"].dropna()]])
        rare = np.unique(codes[shared.value.rare(codes)])
        keys, n = np.append(keys, shared.value.local(codes, rare)[0]), np.append(n, np.ones(len(codes), n.dtype))
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        sums = np.add.reduceat(n[order], first)
        return pd.DataFrame([(int(group["shard"].iloc[0]), Trie.pack(keys), _packed_counts(sums), rare.view(np.int64))], columns=["shard", "trie", "counts", "rare"])

    merged = counted.filter("shard >= 0").select("shard", "keys", "counts", "odd").groupBy("shard").applyInPandas(merge, "shard long, trie binary, counts binary, rare array<long>")
    merged = numbered = materialise(merged, "lm-counts")
    release(counted)
    # how often the words without id that a shard knows occur, in its order
    met = merged.select("shard", F.posexplode("rare").alias("at", "word")).join(words, "word").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("met"))
    merged = materialise(merged.join(met, "shard", "left").withColumn("rare_n", F.coalesce(F.col("met.n"), F.array().cast("array<long>"))).drop("met"), "lm-counts")
    release(numbered)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gain = [_left_out(Trie(t).keys(), _unpacked_counts(c), *shared.value.with_rare(r)).tolist() for t, c, r in zip(batch["trie"], batch["counts"], batch["rare_n"], strict=True)]
            yield pd.DataFrame({"gain": gain})

    gains = merged.select("trie", "counts", "rare_n").mapInPandas(leave_out, "gain array<double>").select(F.posexplode("gain").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).toPandas()
    seen = np.flatnonzero(dense)
    total = _left_out(_head_keys(seen, HEAD), dense[seen], classes.counts, classes.share) if len(seen) else np.zeros(len(STRENGTHS))
    total[gains["k"].to_numpy(np.int64)] += gains["g"].to_numpy(np.float64)
    strength = float(STRENGTHS[int(total.argmax())])

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, trie, counts, rare, rare_n in zip(batch["shard"], batch["trie"], batch["counts"], batch["rare"], batch["rare_n"], strict=True):
                gain = _over_backing_off(Trie(trie).keys(), _unpacked_counts(counts).astype(np.float64), shared.value.with_rare(rare_n)[1], strength)
                low, high = float(gain.min()), float(gain.max())
                step = max(high - low, 1e-9) / STEPS
                out.append((shard, trie, np.round((gain - low) / step).astype("<u2").tobytes(), low, step, rare))
            yield pd.DataFrame(out, columns=["shard", "trie", "values", "low", "step", "rare"])

    tries = materialise(merged.select("shard", "trie", "counts", "rare", "rare_n").mapInPandas(smooth, "shard long, trie binary, values binary, low double, step double, rare array<long>"), "lm-tries")
    release(merged)
    gain = np.zeros(len(dense))
    gain[seen] = _over_backing_off(_head_keys(seen, HEAD), dense[seen].astype(np.float64), classes.share, strength) if len(seen) else 0.0
    return NgramModel(shared, shards, strength, words, tries, spark.sparkContext.broadcast(gain))


def _head_place(keys: np.ndarray, head: int) -> np.ndarray:
    return ((keys >> np.uint64(CLASS_BITS)) * np.uint64(head + 1) + (keys & np.uint64((1 << CLASS_BITS) - 1))).astype(np.int64)


def _head_keys(places: np.ndarray, head: int) -> np.ndarray:
    return (places // (head + 1)).astype(np.uint64) << np.uint64(CLASS_BITS) | (places % (head + 1)).astype(np.uint64)


def _over_backing_off(keys: np.ndarray, n: np.ndarray, shares: np.ndarray, strength: float) -> np.ndarray:
    """log10 of p(w | v) over M p(w) / (c(v) + M)."""
    share = shares[(keys & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)]
    return np.log10(1.0 + n / (strength * share))


def _left_out(keys: np.ndarray, n: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log likelihood relative to single words of these pairs for each strength, each occurrence left out of its own counts."""
    context = counts[(keys >> np.uint64(CLASS_BITS)).astype(np.int64)]
    ratio = (n - 1) / shares[(keys & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)]
    return np.array([(n * np.log10((ratio + m) / (np.maximum(context - 1, 0) + m))).sum() for m in STRENGTHS])


def _uid(ids: list, raws: list[str]) -> np.ndarray:
    """A 64-bit key of each (id, text)."""
    return np.array([xxhash.xxh3_64_intdigest(f"{i}\n{t}".encode("utf-8", "surrogatepass")) for i, t in zip(ids, raws, strict=True)], np.uint64).view(np.int64)


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_tokens, n_known, train_tokens, base_score, score``; logarithms to base 10.

    Tokens are words between ASCII white space with A-Z lower-cased, then one end; a null text counts as empty and has the end alone. Repeated rows give
    repeated results. Other columns are ignored; an empty table gives an empty result, and a model of no texts gives every word the same probability.
    """
    kind = dict(docs.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    # pandas would turn integers beside a null into doubles, so ids pass through it as strings
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    classes, head, strength, shards = model.classes, model.head, model.strength, model.shards

    def look(batch: pd.DataFrame) -> Iterator[tuple]:
        ids, texts = batch["_id"].tolist(), batch["_text"].tolist()
        for first, raws in chunks(texts, RUN_BYTES):
            tokens, starts = _tokens(raws)
            span = slice(first, first + len(raws))
            yield span, _uid(ids[span], texts[span]), tokens, starts, *classes.value.split(tokens, starts)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = classes.value
        for batch in batches:
            for span, uid, tokens, starts, own, keys, odd, _ in look(batch):
                at, rare = starts[:-1], own == 0
                base = np.add.reduceat(np.where(rare, 0.0, np.log10(c.counts[own] + 0.5)), at)
                context = (keys >> np.uint64(CLASS_BITS)).astype(np.int64)
                # each token is a context once, so those without id follow with the joined counts
                gain = np.where((context == 0) & c.open, 0.0, np.log10(strength / (c.counts[context] + strength)))
                top = _in_head(keys, c.head) & ~odd
                gain[top] += head.value[_head_place(keys[top], c.head)]
                out = pd.DataFrame({"_id": batch["_id"].iloc[span].to_numpy(), "uid": uid, "n_tokens": np.diff(starts), "known": np.add.reduceat((~rare).astype(np.int64), at), "base": base, "gain": np.add.reduceat(gain, at)})
                edges = np.searchsorted(np.flatnonzero(rare), starts)
                others = tokens[rare].view(np.int64)
                out["rare"] = [others[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield out
            give_back()

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, uid, _, starts, _, keys, odd, codes in look(batch):
                doc = np.repeat(np.arange(len(uid)), np.diff(starts))
                away, out = ~_in_head(keys, classes.value.head) & ~odd, []
                near_keys = keys[away]
                for held, docs_, shard, pack in ((near_keys, doc[away], (mix(near_keys) % np.uint64(shards)).astype(np.int64), _packed_keys), (codes, doc[odd], classes.value.shard_of(codes, shards), _packed_codes)):
                    order, runs = _by_shard(shard)  # documents stay in order within a shard
                    for k, a, b in runs:
                        own, sizes = np.unique(docs_[order[a:b]], return_counts=True)
                        out.append((k, uid[own].tobytes(), _packed_counts(sizes), pack(held[order[a:b]]), pack is _packed_codes))
                yield pd.DataFrame(out, columns=["shard", "uids", "sizes", "keys", "odd"])
            give_back()

    def answer(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        uids, sums = [], []
        if len(held):
            trie, values = Trie(held["trie"].iloc[0]), np.frombuffer(held["values"].iloc[0], "<u2")
            low, step = held["low"].iloc[0], held["step"].iloc[0]
            rare = np.asarray(held["rare"].iloc[0], np.int64).view(np.uint64)
            for uid, sizes, keys, odd in zip(asked["uids"], asked["sizes"], asked["keys"], asked["odd"], strict=True):
                if odd:
                    keys, known = classes.value.local(_unpacked_codes(keys), rare)
                    at = np.full(len(keys), -1, np.int64)
                    at[known] = trie.find(keys[known])
                else:
                    at = trie.find(_unpacked_keys(keys))
                gain = np.where(at >= 0, low + step * values[at], 0.0)
                sizes = _unpacked_counts(sizes)
                total = np.add.reduceat(gain, np.cumsum(sizes) - sizes)
                some = total != 0
                uids.append(np.frombuffer(uid, np.int64)[some])
                sums.append(total[some])
        return pd.DataFrame({"uid": np.concatenate(uids) if uids else np.zeros(0, np.int64), "far": np.concatenate(sums) if sums else np.zeros(0)})

    meta = materialise(rows.mapInPandas(near, "_id string, uid long, n_tokens long, known long, base double, gain double, rare array<long>"), "lm-documents")
    rare = meta.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("times"))
    tail = rare.join(model.words, "word", "left").select("uid", F.col("times"), F.coalesce("n", F.lit(0)).alias("n"))
    backing = F.log10(F.lit(strength) / (F.col("n") + F.lit(strength))) if classes.value.open else F.lit(0.0)
    tail = tail.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("tail"), F.sum(F.col("times") * backing).alias("tail_gain"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    asked = rows.mapInPandas(far, "shard long, uids binary, sizes binary, keys binary, odd boolean")
    sums = asked.groupBy("shard").cogroup(model.tries.groupBy("shard")).applyInPandas(answer, "uid long, far double").groupBy("uid").agg(F.sum("far").alias("far"))
    # rows that repeat have sent their pairs and rare words as often as they occur
    times = meta.groupBy("uid").agg(F.count(F.lit(1)).alias("m"))
    joined = meta.drop("rare").join(times, "uid").join(tail, "uid", "left").join(sums, "uid", "left")
    part = lambda c: F.coalesce(c, F.lit(0)) / F.col("m")
    base = F.col("base") + part("tail") - F.col("n_tokens") * F.lit(float(np.log10(classes.value.norm)))
    return joined.select(
        F.col("_id").cast(kind).alias(id_col),
        "n_tokens",
        (F.col("known") + part("tail_known")).cast("long").alias("n_known"),
        F.lit(classes.value.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + part("tail_gain") + part("far")).alias("score"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.coalesce(fifth(F.col("doc_id")) != 1, F.lit(True))))
    scored = score(docs, model)
    return scored.withColumn("held_out", F.coalesce(fifth(F.col("doc_id")) == 1, F.lit(False)))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
