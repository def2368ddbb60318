"""The streams that a robot's cameras offer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cameras that are expected, by the last part of their names, and kinds of streams.
EXPECTED = {"left_wrist": "cam_left_wrist", "head": "cam_high", "right_wrist": "cam_right_wrist"}
KINDS, SAME_KIND = ("rgb", "depth"), {"color": "rgb"}


def discover(configs: DataFrame, depth: bool = True, expected: dict[str, str] = EXPECTED, name: str = "camera", streams: str = "streams") -> DataFrame:
    """``camera, logical, kind`` and the last such stream of each camera, from rows of a name and an array of structs with a ``type``.

    Names are trimmed and blank ones left out; a colour stream is an RGB one, kinds that are not known are dropped, and depth ones unless they are wanted; a
    camera of which nothing is left is not listed. ``logical`` is the expected camera whose name the last part is, or null.
    """
    own = configs.select(F.trim(F.col(name).cast("string")).alias("camera"), F.posexplode(streams).alias("_place", "stream")).filter("camera <> ''")
    kind = F.lower(F.trim(F.coalesce(F.col("stream.type").cast("string"), F.lit(""))))
    for odd, plain in SAME_KIND.items():
        kind = F.when(kind == odd, plain).otherwise(kind)
    found = own.withColumn("kind", kind).filter(F.col("kind").isin(*[k for k in KINDS if depth or k != "depth"]))
    logical = F.try_element_at(F.create_map(*[F.lit(t) for pair in expected.items() for t in reversed(pair)]), F.substring_index("camera", "/", -1))
    return found.groupBy("camera", "kind").agg(F.max_by("stream", "_place").alias("stream")).select("camera", logical.alias("logical"), "kind", "stream")


def aliases(found: DataFrame) -> DataFrame:
    """``alias, camera``: a camera goes by its name, the last part of it and its logical name; of several cameras the last by name has an alias."""
    names = F.array_compact(F.array("camera", F.substring_index("camera", "/", -1), "logical"))
    return found.select("camera", F.explode(F.array_distinct(names)).alias("alias")).groupBy("alias").agg(F.max("camera").alias("camera"))


def absent(found: DataFrame, depth: bool = True, expected: dict[str, str] = EXPECTED) -> DataFrame:
    """``logical, kind`` of expected cameras that are not there (kind is null), and of streams that those which are there do not offer."""
    spark = found.sparkSession
    kinds = [k for k in KINDS if depth or k != "depth"]
    wanted = F.broadcast(spark.createDataFrame([(c, k) for c in expected for k in kinds], "logical string, kind string"))
    have = found.filter("logical is not null").groupBy("logical").agg(F.collect_set("kind").alias("kinds"))
    held = wanted.join(F.broadcast(have), "logical", "left")
    gone = held.filter("kinds is null").select("logical", F.lit(None).cast("string").alias("kind")).distinct()
    return gone.unionByName(held.filter(F.col("kinds").isNotNull() & ~F.array_contains("kinds", F.col("kind"))).select("logical", "kind"))
