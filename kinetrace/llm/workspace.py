"""Tables in the shared folder that cut lineage, so that a lost executor costs one stage and not the whole job."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local-mode session without that setting gets a folder of its own; a cluster session
    without it is an error, because a machine-local folder is not visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kinetrace-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinetrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise`, once nothing lazy reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def row_count(df: DataFrame) -> int:
    """Rows of ``df``; over Parquet this reads footers only."""
    return df.count()


_caches: list[Callable[[], None]] = []
_working_on: list[str] = []


def cached(forget: Callable[[], None]) -> None:
    """Have ``forget`` called when this Python worker turns to another operator."""
    _caches.append(forget)


def working_on(operator: str) -> None:
    """Called by an operator's tasks: Spark reuses Python workers, so what another operator remembers in this one is dropped."""
    if _working_on[-1:] != [operator]:
        _working_on[:] = [operator]
        for forget in _caches:
            forget()
        give_back()


def give_back() -> None:
    """Return what this process has freed to the machine, which holds the memory of all workers of an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def runs(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of a string or binary column each, so that only these become Python objects at once."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
    first, upto = 0, np.cumsum(sizes)
    while first < batch.num_rows:
        before = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(first, last - first)
        first = last
