"""Expressions built by walking a type of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions.vectors import finite_or_null

REAL = (T.DoubleType, T.FloatType)


def holds_reals(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_reals(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return holds_reals(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_reals(kind.valueType)
    return isinstance(kind, REAL)


def finite_tree(value: Column, kind: T.DataType) -> Column:
    """``value`` with null for every number within it that is not finite, whatever arrays, maps and structs it lies in.

    Nulls at any level, empty arrays and maps, and the keys of maps stay as they are; parts without real numbers are not touched.
    """
    if not holds_reals(kind):
        return value
    if isinstance(kind, REAL):
        return finite_or_null(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite_tree(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite_tree(x, kind.valueType))
    return F.when(value.isNotNull(), F.struct(*[finite_tree(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))


def finite_columns(rows: DataFrame) -> DataFrame:
    """All columns of a table as finite trees, under names of any kind."""
    return rows.select(*[finite_tree(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType).alias(f.name) for f in rows.schema])
