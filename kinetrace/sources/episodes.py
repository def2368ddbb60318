"""Episodes of frames: discovery, checks and loading. Frames come from Parquet; HDF5 files need a library that is not part of this package."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions import vectors
from kinetrace.functions.typed_json import first_fault
from kinetrace.operators import timeline
from kinetrace.plans import dims

#: Files and folders that a listing names at most; a longer one says so in ``truncated``.
MOST_FILES, MOST_FOLDERS = 2000, 10_000
#: Frames of an episode and bytes of its file at most; larger ones are reported as invalid.
MOST_FRAMES, MOST_BYTES = 200_000, 1 << 30
# Names of episode files, widths of the parts of a grouped frame.
NAMES = ("episode.hdf5", "episode.h5", "aligned_joints.h5", "episode.parquet", "aligned_joints.parquet")
WIDTHS = {"arm": 14, "effector": 2, "waist": 3, "head": 2, "base": 2}


def list_files(spark: SparkSession, path: str, glob: str = "*.{hdf5,h5,parquet}", most: int = MOST_FILES) -> DataFrame:
    """``path, length, truncated``: episode files below a folder, hidden folders left out, the first ``most`` by path; ``truncated`` says that there are more."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return _report(files.select("path", "length").filter(~F.col("path").rlike(r"/\.[^/]+/")).distinct(), "path", most)


def _report(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows by a column, and whether there are more: one row beyond them tells, so no window sees more than that."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by))
    seen = rows.orderBy(by).limit(most + 1).withColumn("_place", place).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > most)
    return seen.filter(F.col("_place") <= most).drop("_place").orderBy(by)


def dataset_folders(files: DataFrame, most: int = MOST_FOLDERS) -> DataFrame:
    """``folder, truncated``: the distinct folders that hold files named as episodes are, the first ``most``; a ``states`` folder counts for the one above."""
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"/states$", "")
    named = files.filter(F.lower(F.substring_index("path", "/", -1)).isin(*NAMES))
    return _report(named.select(folder.alias("folder")).distinct(), "folder", most)


def shape_fault(parts: dict[str, Column]) -> Column:
    """Why matrices of parts, a row for each frame, are no source: a part that is missing or empty, of another width, or of another length than the first."""
    first = F.size(next(iter(parts.values())))
    rules = [(F.coalesce(F.size(v) == 0, F.lit(True)), f"{k}: no frames") for k, v in parts.items()]
    wide = lambda rows, width: F.forall(rows, lambda r: F.coalesce(F.size(r) == width, F.lit(False)))
    rules += [(~F.coalesce(wide(v, WIDTHS[k]), F.lit(False)), f"{k}: width") for k, v in parts.items()]
    rules += [(F.size(v) != first, f"{k}: length") for k, v in parts.items()]
    return first_fault(*rules)


SCANNED = "path string, error string, format string, frames long, rate_hz double, duration_s double, basis string, action_mode string, sources map<string,struct<valid:boolean,error:string,frames:long,base_abs_max:double>>"


#: The beginning of a file's name, which has one slash or three.
SCHEME = "^([A-Za-z0-9]+):/+"


def _plain(name: str) -> str:
    return re.sub(SCHEME, r"\1:/", name)


class BrokenEpisodeError(ValueError):
    """A file that is no episode."""


def _number(text: bytes | None, otherwise: float, name: str) -> float:
    try:
        found = otherwise if text is None else float(text)
    except ValueError:
        raise BrokenEpisodeError(f"{name} is no number") from None
    if not np.isfinite(found):
        raise BrokenEpisodeError(f"{name} is not finite")
    return found


def _part(column: pa.ChunkedArray, name: str, width: int) -> np.ndarray:
    """Lists of one width as a matrix of doubles."""
    whole = column.combine_chunks()
    if not pa.types.is_list(whole.type) and not pa.types.is_fixed_size_list(whole.type) and not pa.types.is_large_list(whole.type):
        raise BrokenEpisodeError(f"{name} holds no lists")
    if whole.null_count or (len(whole) and not pa.compute.all(pa.compute.equal(pa.compute.list_value_length(whole), width)).as_py()):
        raise BrokenEpisodeError(f"{name} is not {width} wide")
    try:
        return whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    except pa.ArrowInvalid:
        raise BrokenEpisodeError(f"{name} holds no numbers") from None


def _source(table: pa.Table, source: str) -> tuple[int, float]:
    """Frames and largest base speed of one source of a file: ``source.vector`` of aligned frames, or the five parts."""
    if source not in table.column_names:
        raise BrokenEpisodeError(f"no {source}")
    held = table.select([source]).flatten()
    widths = {"vector": dims.AXES} if f"{source}.vector" in held.column_names else WIDTHS
    parts = {}
    for name, width in widths.items():
        if f"{source}.{name}" not in held.column_names:
            raise BrokenEpisodeError(f"no {source}.{name}")
        parts[name] = _part(held.column(f"{source}.{name}"), f"{source}.{name}", width)
    if not table.num_rows:
        raise BrokenEpisodeError("no frames")
    if "vector" in parts and not np.isfinite(parts["vector"]).all():
        raise BrokenEpisodeError(f"{source} is not finite")
    base = parts["vector"][:, 21:] if "vector" in parts else parts["base"]
    if not np.isfinite(base).all():
        raise BrokenEpisodeError(f"{source}.base is not finite")
    return table.num_rows, float(np.abs(base).max())


def inspect_file(content: bytes, most_frames: int = MOST_FRAMES) -> dict:
    """What an episode file holds; :class:`BrokenEpisodeError` says why it is none. One sound source is enough."""
    try:
        file = pq.ParquetFile(io.BytesIO(content))
        meta = file.schema_arrow.metadata or {}
        if file.metadata.num_rows > most_frames:
            raise BrokenEpisodeError(f"more than {most_frames} frames")
        table = file.read()
    except (pa.ArrowException, OSError) as e:
        raise BrokenEpisodeError(f"cannot be read: {str(e).splitlines()[0]}") from None
    sources = {}
    for name in ("action", "state"):
        try:
            frames, base = _source(table, name)
            sources[name] = {"valid": True, "error": None, "frames": frames, "base_abs_max": base}
        except BrokenEpisodeError as e:
            sources[name] = {"valid": False, "error": str(e), "frames": None, "base_abs_max": None}
    aligned = any(f"{s}.vector" in table.select([s]).flatten().column_names for s in sources if s in table.column_names)
    rate = _number(meta.get(b"fps" if aligned else b"control_frequency", meta.get(b"rate_hz")), 30.0, "rate")
    if not 1 <= rate <= 500:
        raise BrokenEpisodeError("rate out of range")
    if not any(s["valid"] for s in sources.values()):
        raise BrokenEpisodeError("; ".join(f"{k}: {s['error']}" for k, s in sources.items()))
    frames, basis = table.num_rows, "nominal_rate"
    duration = frames / rate
    if not aligned and "t" in table.column_names:
        stamps = table.column("t").cast(pa.float64()).to_numpy()
        stamps = stamps / 1000 if len(stamps) and np.nanmax(np.abs(stamps)) > 1e11 else stamps
        if not np.isfinite(stamps).all() or (np.diff(stamps) < 0).any():
            raise BrokenEpisodeError("times are not finite or run backward")
        duration, basis = float(stamps[-1] - stamps[0]), "timestamp"
    return {"format": "aligned" if aligned else "episode", "frames": frames, "rate_hz": rate, "duration_s": duration, "basis": basis, "action_mode": meta.get(b"action_mode", b"unknown").decode(errors="replace"), "sources": sources}


def scan_episodes(spark: SparkSession, path: str, most: int = MOST_FILES, glob: str = "*.{hdf5,h5,parquet}") -> DataFrame:
    """One row per file below a folder, hidden folders left out: what it holds, or ``error`` and nulls if it is no episode. No file fails the job.

    Files are Parquet: a row is a frame, with structs ``state`` and ``action`` of the five parts or of a ``vector``, and perhaps times ``t`` in seconds or
    milliseconds; rate and action mode are in the file's metadata. Each of the two sources is judged on its own. A file is read whole by one task, if it has at most
    MOST_BYTES. More than ``most`` files are an error, as a folder further down is meant then.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = sorted({_plain(unquote(f)) for f in files.inputFiles() if not re.search(r"/\.[^/]+/", f)})
    if len(names) > most:
        raise ValueError(f"more than {most} episode files below {path}")

    def inspect_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = dict.fromkeys(("format", "frames", "rate_hz", "duration_s", "basis", "action_mode", "sources"))
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if content is None:
                        raise BrokenEpisodeError(f"more than {MOST_BYTES} bytes")
                    rows.append({"path": name, "error": None} | inspect_file(bytes(content)))
                except BrokenEpisodeError as e:
                    rows.append({"path": name, "error": str(e)} | nothing)
            yield pd.DataFrame(rows).astype({"frames": "Int64"})

    small = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    held = files.filter(~F.col("path").rlike(r"/\.[^/]+/")).repartition(max(1, len(names)), "path").select("path", small.alias("content")).mapInPandas(inspect_all, SCANNED)
    # files without a byte are listed but not read
    listed = spark.createDataFrame([(n,) for n in names], "_name string")
    met = listed.join(held.withColumn("_name", F.regexp_replace("path", SCHEME, "$1:/")), "_name", "left")
    error = F.when(F.col("path").isNull(), "empty file").otherwise(F.col("error"))
    return met.select(F.col("_name").alias("path"), error.alias("error"), *held.columns[2:])


def scan_report(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The episodes of a scan, and ``path, error`` of what is none."""
    return scanned.filter("error is null").drop("error"), scanned.filter("error is not null").select("path", "error")


def frames_from_groups(rows: DataFrame, source: str) -> DataFrame:
    """One wire vector for each frame of ``source.arm, source.effector, ...``; null where a part has another width."""
    part = lambda p: F.col(f"{source}.{p}")
    sound = F.lit(True)
    for p, width in WIDTHS.items():
        sound = sound & (F.size(part(p)) == width)
    whole = vectors.wire_vector(*[part(p) for p in WIDTHS])
    return rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), whole))


def check_aligned(rows: DataFrame, by: list[str], frame: str, vector: str) -> DataFrame:
    """One row per episode with ``error``: the first fault of its frames, or null.

    Frame names are decimal numbers that run from 0 without gaps; vectors have 23 finite values.
    """
    number = F.when(F.col(frame).rlike(r"^(0|[1-9]\d*)$"), F.col(frame).cast("long"))
    held = rows.withColumn("_n", number).withColumn("_fine", F.coalesce(vectors.all_finite(F.col(vector)), F.lit(False)))
    out = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("_n").isNull()).alias("_bad"),
        F.count_distinct("_n").alias("_distinct"),
        F.max("_n").alias("_last"),
        F.count_if(F.col(vector).isNull() | (F.size(vector) != dims.AXES)).alias("_wide"),
        F.count_if(~F.col("_fine")).alias("_odd"),
    )
    gap = (F.col("_distinct") != F.col("frames")) | (F.col("_last") != F.col("frames") - 1)
    error = F.when(F.col("_bad") > 0, "frame name").when(gap, "frame gap").when(F.col("_wide") > 0, "width").when(F.col("_odd") > 0, "not finite")
    return out.withColumn("error", error).drop("_bad", "_distinct", "_last", "_wide", "_odd")


def range_errors(rows: DataFrame, by: list[str], vector: str, mode: str) -> DataFrame:
    """The first axis of each episode that leaves its limits in ``mode`` (arms: 16 axes, full: 21 and a base at rest); none for a sound episode."""
    axes = 16 if mode == "arms" else 21
    seen = rows.select(*by, F.posexplode(vector).alias("axis", "x")).groupBy(*by, "axis").agg(F.min("x").alias("low_seen"), F.max("x").alias("high_seen"))
    held = seen.join(F.broadcast(dims.axis_table(rows.sparkSession)), "axis")
    off = (F.col("axis") < axes) & ((F.col("low_seen") < F.col("low")) | (F.col("high_seen") > F.col("high")))
    moving = (F.col("axis") >= 21) & (F.greatest(F.abs("low_seen"), F.abs("high_seen")) > 1e-9) if mode == "full" else F.lit(False)
    return held.filter(off | moving).groupBy(*by).agg(F.min_by("name", "axis").alias("axis_name"), F.min("axis").alias("axis"))


def inspect(rows: DataFrame, by: list[str], vector: str, t: str | None = None, rate: Column | None = None) -> DataFrame:
    """Frames, rate, duration and largest base speed of each episode; without times the duration is frames over rate."""
    base = F.greatest(F.abs(F.get(vector, F.lit(21))), F.abs(F.get(vector, F.lit(22))))
    r = timeline.control_rate(*([rate] if rate is not None else []))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.max(base).alias("base_abs_max"), F.first(r).alias("rate"), *([(F.max(t) - F.min(t)).alias("duration_s")] if t else []))
    out = out if t else out.withColumn("duration_s", F.col("frames") / F.col("rate"))
    return out.withColumn("basis", F.lit("timestamp" if t else "nominal_rate")).withColumn("base_rests", F.col("base_abs_max") <= 1e-9)


def valid_and_invalid(inspected: DataFrame) -> DataFrame:
    return inspected.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"))


def load_episode(rows: DataFrame, by: list[str], frame: str, vector: str, t: str, rate: float, mode: str, speed: float = 1.0) -> DataFrame:
    """Sound episodes on a uniform grid: raw frames are checked first, so that resampling hides no fault; grippers hold, other axes interpolate.

    One row per episode, step and axis: ``value`` and the playback ``rate`` times ``speed``.
    """
    good = check_aligned(rows, by, frame, vector).filter("error is null").select(*by)
    sound = rows.join(good, by, "left_semi").join(range_errors(rows, by, vector, mode).select(*by), by, "left_anti")
    snapped = sound.withColumn(vector, F.concat(vectors.snap_items(F.slice(vector, 1, 21), dims.LOWS, dims.HIGHS), F.slice(vector, 22, 2)))
    cells = snapped.select(*by, F.col(frame).cast("long").alias("_frame"), F.col(t).alias("_t"), F.posexplode(vector).alias("axis", "value")).withColumn("held", F.col("value"))
    out = timeline.resample(cells, [*by, "axis"], ["_frame"], "_t", ["held"], ["value"], rate)
    value = F.when(F.col("axis").isin(*dims.GRIPPERS), F.col("held")).otherwise(F.col("value"))
    steps = F.max("step").over(Window.partitionBy(*by, "axis"))
    span = F.max("grid_t").over(Window.partitionBy(*by, "axis")) - F.min("grid_t").over(Window.partitionBy(*by, "axis"))
    return out.withColumn("rate", F.when(span > 0, steps / span).otherwise(F.lit(rate)) * speed).select(*by, "axis", "step", "grid_t", value.alias("value"), "rate")
