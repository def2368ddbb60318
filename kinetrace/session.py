"""Session builder and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kinetrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the UTC clock; ``conf`` wins over these settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
