"""Language identification with interpolated Kneser-Ney character models.

Each language has one model over letters and word gaps, order 4. An n-gram is packed into 64 bits and its counts lie in sorted
arrays of these keys. The language with the lowest length-normalised cross-entropy wins. The score is a calibrated posterior, and a text
that its best model explains worse than any calibration text did, measured against a pooled letter model, is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinetrace.llm.workspace import working_on
from kinetrace.session import table

ORDER, BITS = 4, 16
#: Labelled rows that are learned from, per language: a hashed sample. One in ``CALIBRATE`` of them calibrates and isn't counted.
SAMPLE_ROWS, CALIBRATE = 2500, 5
#: Code points that are encoded at once.
CHUNK = 1 << 18
#: Allowed beyond the worst calibration text: bits per symbol, and bits per text, which matter for the shortest.
SLACK_BITS, SLACK_TEXT = 0.25, 12.0
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts in order and the number of each text's. Letters are lower-cased, anything else between words is one gap."""
    raw = "\n".join(texts).lower() + "\n"
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
    if "\n" in "".join(texts):  # gaps only separate words, so inner line ends are blanks
        code = np.concatenate([np.frombuffer((t.replace("\n", " ").lower() + "\n").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts])
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.flatnonzero(code == 10)
    total = np.cumsum(keep)[ends]
    counts = np.diff(total, prepend=0)
    symbols = np.where(letter, np.where(code > 0xFFFF, 0xE000 | (code & 0x1FFF), code), 32)[keep].astype(np.uint64)
    padded = np.full(len(symbols) + (ORDER - 1) * len(texts), 32, np.uint64)
    place = np.arange(len(symbols)) + (ORDER - 1) * (np.repeat(np.arange(len(texts)), counts) + 1)
    padded[place] = symbols
    keys = np.zeros(len(symbols), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        keys = (keys << np.uint64(BITS)) | padded[place - back]
    return keys, counts


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table_, keys)
    at[at == len(table_)] = 0
    return at, (table_[at] == keys) if len(table_) else np.zeros(len(keys), bool)


@dataclass
class Level:
    """Counts of one order: keys and contexts as sorted arrays."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray = field(init=False)
    totals: np.ndarray = field(init=False)
    kinds: np.ndarray = field(init=False)
    discount: float = field(init=False)

    def __post_init__(self):
        self.contexts, start, self.kinds = np.unique(self.keys >> np.uint64(BITS), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, start).astype(float)
        once, twice = int((self.counts == 1).sum()), int((self.counts == 2).sum())
        self.discount = once / (once + 2 * twice) if once and twice else 0.5


class KneserNey:
    """Interpolated Kneser-Ney over packed n-grams: counts at the highest order, distinct left neighbours below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet, self.levels = alphabet, {ORDER: Level(keys, counts)}
        for order in range(ORDER - 1, 0, -1):
            shorter = self.levels[order + 1].keys & np.uint64((1 << (BITS * order)) - 1)
            self.levels[order] = Level(*np.unique(shorter, return_counts=True))

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1.0 / self.alphabet)
        level = self.levels[order]
        below = self.probability(keys & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
        at, hit = _find(level.keys, keys)
        own = np.where(hit, np.maximum(level.counts[at] - level.discount, 0.0), 0.0)
        at, hit = _find(level.contexts, keys >> np.uint64(BITS))
        total = np.where(hit, level.totals[at], 1.0)
        return np.where(hit, (own + level.discount * level.kinds[at] * below) / total, below)


class LanguageModels:
    """All languages: one sorted key array with a column of log2 probabilities for each, and the models for keys outside it."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counted)
        pooled = np.unique(np.concatenate([k for k, _ in counted.values()]) & np.uint64(0xFFFF))
        self.models = [KneserNey(*counted[l], len(pooled) + 1) for l in self.languages]
        self.keys = np.unique(np.concatenate([k for k, _ in counted.values()]))
        self.bits = np.stack([-np.log2(m.probability(self.keys)) for m in self.models], axis=1).astype(np.float32)
        letters = np.concatenate([k for k, _ in counted.values()]) & np.uint64(0xFFFF)
        n = np.bincount(letters.astype(np.int64), np.concatenate([c for _, c in counted.values()]), 1 << BITS) + 0.5
        self.pool = -np.log2(n / n.sum()).astype(np.float32)
        self.sharpness, self.power, self.worst = 1.0, 0.5, np.inf

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per symbol of each text under each language and under the pooled letters, and its symbols."""
        keys, counts = grams(texts)
        n = len(texts)
        sums, pool = np.zeros((n, len(self.languages))), np.zeros(n)
        if len(keys):
            at, hit = _find(self.keys, keys)
            bits = self.bits[at]
            if not hit.all():
                new, back = np.unique(keys[~hit], return_inverse=True)
                bits[~hit] = np.stack([-np.log2(m.probability(new)) for m in self.models], axis=1)[back]
            held = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[held]
            sums[held] = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
            pool[held] = np.add.reduceat(self.pool[(keys & np.uint64(0xFFFF)).astype(np.int64)], starts, dtype=np.float64)
        size = np.maximum(counts, 1)
        return sums / size[:, None], pool / size, counts

    def posterior(self, entropies: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = -self.sharpness * entropies * np.maximum(counts, 1)[:, None] ** self.power
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def calibrate(self, entropies: np.ndarray, pool: np.ndarray, counts: np.ndarray, labels: list[str]) -> None:
        """Set the posterior's sharpness by log loss, and the worst excess over the pooled letters that a labelled text shows."""
        known = np.array([l in self.languages for l in labels], bool) & (counts > 0)
        if not known.any():
            return
        true = np.array([self.languages.index(l) for l, k in zip(labels, known, strict=True) if k])
        entropies, pool, counts = entropies[known], pool[known], counts[known]
        best = np.inf
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for sharp in 2.0 ** np.arange(-4, 6):
                self.sharpness, self.power = sharp, power
                loss = -np.log(self.posterior(entropies, counts)[np.arange(len(true)), true] + 1e-9).mean()
                if loss < best:
                    best, chosen = loss, (sharp, power)
        self.sharpness, self.power = chosen
        self.worst = float((entropies.min(axis=1) - pool).max()) + SLACK_BITS

    def classify(self, texts: list[str]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, bits per symbol) of each text."""
        entropies, pool, counts = self.entropies(texts)
        score, out = self.posterior(entropies, counts), []
        for k, best in enumerate(entropies.argmin(axis=1)):
            if counts[k]:
                out.append((self.languages[best], float(score[k, best]), bool(entropies[k, best] - pool[k] > self.worst + SLACK_TEXT / counts[k]), float(entropies[k, best])))
            else:
                out.append((UNKNOWN, 0.0, True, 0.0))
        return out


def fifth(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, n = 0, 0
    for k, text in enumerate(texts):
        if n and n + len(text) > CHUNK:
            yield first, texts[first:k]
            first, n = k, 0
        n += len(text) + 1
    if texts:
        yield first, texts[first:]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModels | None:
    """Models from ``labelled`` (key, text, lang), at most ``sample_rows`` rows of each language in hashed order of the key.

    Rows without text or lang don't count. None if nothing can be learned.
    """
    rows = labelled.select(F.xxhash64(F.col("key").cast("string"), F.lit("language")).alias("_h"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).filter("_lang is not null and _text is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    # about three times the sample passes the hash, so that ranking never sees all rows of a language
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 3 * sample_rows / n) * (1 << 62)))])
    near = rows.filter(F.col("_h").bitwiseAND(F.lit((1 << 62) - 1)) < limits[F.col("_lang")])
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    edge = {r["_lang"]: r["h"] for r in near.select("_lang", "_h").withColumn("_r", rank).filter(F.col("_r") <= sample_rows).groupBy("_lang").agg(F.max("_h").alias("h")).collect()}
    edges = F.create_map(*[F.lit(x) for pair in edge.items() for x in pair])
    chosen = near.filter(F.col("_h") <= edges[F.col("_lang")]).withColumn("_cal", F.pmod(F.shiftrightunsigned("_h", 7), F.lit(CALIBRATE)) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working_on("language-id")
        for batch in batches:
            for lang, own in batch.groupby("_lang"):
                for _, texts in _runs(own["_text"].tolist()):
                    keys, n = np.unique(grams(texts)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

    counted = chosen.filter(~F.col("_cal")).select("_lang", "_text").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    tables = {}
    for lang, own in counted.groupby("lang"):
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        tables[lang] = (keys[order], own["n"].to_numpy(np.int64)[order])
    models = LanguageModels(tables)
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs = batch["_lang"].tolist()
            for first, texts in _runs(batch["_text"].tolist()):
                bits, pool, n = shared.value.entropies(texts)
                yield pd.DataFrame({"lang": langs[first : first + len(texts)], "bits": list(bits), "pool": pool, "n": n})

    held = chosen.filter("_cal").select("_lang", "_text").mapInPandas(measure, "lang string, bits array<double>, pool double, n long").toPandas()
    if len(held):
        models.calibrate(np.stack(held["bits"]), held["pool"].to_numpy(), held["n"].to_numpy(), held["lang"].tolist())
    return models


RESULT = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType(), "bits_per_symbol": T.DoubleType()}


def identify(docs: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected, bits_per_symbol``; a column of one of these names is replaced.

    A text that is null or has no letter gives ``und`` with score 0 and is rejected, as is every text if there are no models. Only the text
    is looked at, and the whole of it.
    """
    rows = docs.drop(*RESULT)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(k, t) for k, t in RESULT.items())])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("language-id")
        own = shared.value
        for batch in batches:
            texts, found = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], []
            for _, run in _runs(texts):
                found += own.classify(run) if own else [(UNKNOWN, 0.0, True, 0.0)] * len(run)
            more = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            arrays = [pa.array(more[0], pa.string()), pa.array(more[1], pa.float64()), pa.array(more[2], pa.bool_()), pa.array(more[3], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return rows.mapInArrow(predict, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.filter(fifth(F.col("doc_id")) != 0).select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = docs.select("doc_id", F.coalesce(fifth(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, models).drop("text")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
