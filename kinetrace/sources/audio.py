"""PCM audio and small text sources. Samples are bytes, so these are numpy steps within pandas UDFs over whole rows."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def pcm_to_floats(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) / 32768.0


def edge_gain(n: int, fade: int) -> np.ndarray:
    """Loudness of ``n`` samples: rising from 0 to 1 over the first ``fade`` of them, falling likewise over the last, which overlap nowhere."""
    fade = min(fade, n // 2)
    if fade < 2:
        return np.where((np.arange(n) < fade) | (np.arange(n) >= n - fade), 0.0, 1.0).astype(np.float32)
    from_edge = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.minimum(1.0, from_edge / (fade - 1)).astype(np.float32)


def floats_to_pcm(samples: np.ndarray, rate: int = 24_000, fade_ms: int = 5) -> bytes:
    """16-bit samples: not-a-number is silence, the range is clipped, and both ends fade."""
    heard = np.asarray(samples, np.float32)
    heard = np.where(np.isnan(heard), np.float32(0), heard).clip(-1, 1)
    return np.trunc(heard * edge_gain(len(heard), rate * fade_ms // 1000) * np.float32(32767)).astype("<i2").tobytes()


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """As many samples as the time takes at the new rate, the first and the last in place, between neighbours in a straight line."""
    held = np.asarray(samples, np.float64)
    if rate == to or len(held) == 0:
        return held.astype(np.float32)
    wanted = max(1, round(len(held) * to / rate))
    place = np.arange(wanted) * ((len(held) - 1) / max(1, wanted - 1))
    left = np.minimum(place.astype(np.int64), len(held) - 1)
    right = np.minimum(left + 1, len(held) - 1)
    return (held[left] + (held[right] - held[left]) * (place - left)).astype(np.float32)


def resampled_part(samples: np.ndarray, first: int, rate: int, to: int, ends: int) -> tuple[int, np.ndarray]:
    """The new samples that lie between neighbours of a part of a signal which begins at sample ``first``, as 16-bit numbers, and the place of the first of them.

    New sample k lies at ``k * rate / to``, reckoned in whole numbers, so parts that overlap by one sample give together what the whole signal gives. ``ends`` is the
    sample behind the part's last.
    """
    # the left neighbour of k is (k * rate) // to; it and the one behind it are in the part
    start, stop = -(-first * to // rate), -(-(ends - 1) * to // rate)
    k = np.arange(start, max(start, stop), dtype=np.int64)
    left, rest = k * rate // to - first, (k * rate % to) / to
    held = np.asarray(samples, np.float32).astype(np.float64)
    values = np.clip(held[left] * (1 - rest) + held[left + 1] * rest, -1, 1) if len(k) else np.zeros(0)
    return start, np.trunc(values * np.where(values < 0, 32768.0, 32767.0)).astype("<i2")


def resample_blocks(rows: DataFrame, by: list[str], order: list[str], samples: str, rate: int, to: int) -> DataFrame:
    """``by, start, pcm`` for each block of a signal: 16-bit samples at the rate ``to`` and the place of the first of them, in straight lines between neighbours.

    However a signal is cut into blocks, the parts put together are the same: a block needs only the number of samples before it and the last one of
    them, so blocks are worked on apart. Empty and null blocks give none. As in a running stream, nothing comes after the last sample but one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    held = rows.select(*by, *[c for c in order if c not in by], F.coalesce(F.col(samples).cast("array<float>"), F.array().cast("array<float>")).alias("_own"))
    held = held.withColumn("_n", F.size("_own").cast("long")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    held = held.withColumn("_last", F.last(F.when(F.col("_n") > 0, F.element_at("_own", -1)), ignorenulls=True).over(before)).filter("_n > 0")
    held = held.select(*by, F.greatest(F.col("_first") - 1, F.lit(0)).alias("_first"), F.when(F.col("_last").isNull(), F.col("_own")).otherwise(F.concat(F.array("_last"), "_own")).alias("_own"))

    @F.pandas_udf("start long, pcm binary")
    def part(first: pd.Series, own: pd.Series) -> pd.DataFrame:
        found = [resampled_part(x, int(a), rate, to, int(a) + len(x)) for a, x in zip(first, own, strict=True)]
        return pd.DataFrame({"start": [k for k, _ in found], "pcm": [x.tobytes() for _, x in found]})

    return held.withColumn("_part", part("_first", "_own")).select(*by, "_part.start", "_part.pcm").filter(F.octet_length("pcm") > 0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_pcm(pcm: pd.Series) -> pd.Series:
    return pcm.map(pcm_to_floats, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ShortType()))
def pcm_numbers(pcm: pd.Series) -> pd.Series:
    return pcm.map(lambda x: np.frombuffer(x[: len(x) // 2 * 2], "<i2"), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def encode_pcm(samples: pd.Series) -> pd.Series:
    return samples.map(floats_to_pcm, na_action="ignore")


def change_rate(samples: Column, rate: int, to: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: resampled(np.asarray(x), rate, to), na_action="ignore")

    return change(samples)


def frames_of(pcm: Column, size: int) -> Column:
    """Parts of ``size`` bytes in order, the last one shorter."""
    starts = F.when(F.octet_length(pcm) > 0, F.sequence(F.lit(0), F.octet_length(pcm) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.substring(pcm, k + 1, F.lit(size)))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """``path, pcm`` of 16 kHz mono 16-bit files; any other file has a null ``pcm`` and an ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        fine = (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16_000, 1, 2)
                        rows.append((name, w.readframes(w.getnframes()) if fine else None, None if fine else "format"))
                except (wave.Error, EOFError) as e:
                    rows.append((name, None, str(e) or "truncated"))
            yield pd.DataFrame(rows, columns=["path", "pcm", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, pcm binary, error string")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a word list without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter((F.col("word") != "") & ~F.startswith(F.col("word"), F.lit("#")))


def stream_deltas(lines: DataFrame, value: str = "value") -> DataFrame:
    """``delta`` of the text events among server-sent lines, in the order of the lines given."""
    body = F.trim(F.substring(value, 6, (1 << 31) - 1))
    kept = lines.filter(F.startswith(F.col(value), F.lit("data:"))).withColumn("_body", body).filter(~F.col("_body").isin("", "[DONE]"))
    return kept.filter(F.get_json_object("_body", "$.type") == "response.output_text.delta").withColumn("delta", F.get_json_object("_body", "$.delta")).drop("_body")
