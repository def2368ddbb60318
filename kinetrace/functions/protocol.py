"""Checks of the fields of JSON payloads, by the types that the JSON itself gives them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import typed_json as j

# Integer and real settings of the chunk schedule with their ranges.
SCHEDULE_RANGES = {"s": (1, 49), "d": (0, 49), "reserve": (0, 49), "horizon": (50, 50)}


def key_errors(payload: Column, expected: list[str]) -> Column:
    """Missing and extra keys of an object, sorted; null for what is no object."""
    held, wanted = j.keys(j.parsed(payload)), F.lit(expected)
    return F.struct(F.sort_array(F.array_except(wanted, held)).alias("missing"), F.sort_array(F.array_except(held, wanted)).alias("extra"))


def number_of(payload: Column, key: str) -> Column:
    """A finite JSON number of an object; null for a boolean, a string, null or a missing key."""
    return j.number(j.at(j.parsed(payload), key))


def flatten_action(payload: Column, groups: dict[str, int]) -> Column:
    """An object of number arrays as one vector in the order of ``groups``; null unless keys and lengths are exact and all numbers finite."""

    def flat(value: Column) -> Column:
        parts = [F.transform(j.items(j.at(value, k)), j.number) for k in groups]
        exact = reduce(lambda a, b: a & b, [F.size(v) == n for v, n in zip(parts, groups.values(), strict=True)])
        sound = exact & (F.array_sort(j.keys(value)) == F.lit(sorted(groups))) & F.forall(F.concat(*parts), lambda x: x.isNotNull())
        return F.when(F.coalesce(sound, F.lit(False)), F.concat(*parts))

    return j.bind(j.parsed(payload), flat)


def chunk_rows(payload: Column, rows: int = 50, width: int = 23) -> Column:
    """The actions of a reply as an array of vectors; null unless it is ``rows`` by ``width`` finite numbers and its success flag is a boolean."""

    def held(value: Column) -> Column:
        actions = F.transform(j.items(j.at(value, "actions")), lambda r: F.transform(j.items(r), j.number))
        ok = j.is_kind(j.at(value, "is_success"), "boolean") & (F.size(actions) == rows) & F.forall(actions, lambda r: (F.size(r) == width) & F.forall(r, lambda x: x.isNotNull()))
        return F.when(F.coalesce(ok, F.lit(False)), actions)

    return j.bind(j.parsed(payload), held)


def metadata_errors(payload: Column, exact: dict[str, int | bool]) -> Column:
    """The keys of an object whose JSON value is not exactly the one asked for; true is not 1."""
    same = lambda v, wanted: F.coalesce((j.flag(v) if isinstance(wanted, bool) else j.whole(v)) == F.lit(wanted), F.lit(False))
    return j.bind(j.parsed(payload), lambda value: F.array_compact(F.array(*[F.when(~same(j.at(value, k), v), F.lit(k)) for k, v in exact.items()])))


def range_errors(settings: dict[str, Column], ranges: dict[str, tuple[float, float]]) -> Column:
    """Names of settings that are missing or out of range."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(settings[k].between(a, b), F.lit(False)), F.lit(k)) for k, (a, b) in ranges.items()]))


def envelope(**fields: Column) -> Column:
    """A request as JSON; null fields are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def embedded_object(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def allowed_command(text: Column, allowed: list[str]) -> Column:
    """The command of an embedded object that is marked as direct, if it is allowed."""
    chosen = lambda value: F.when(j.flag(j.at(value, "direct")) & j.string(j.at(value, "command")).isin(*allowed), j.string(j.at(value, "command")))
    return j.bind(j.parsed(embedded_object(text)), chosen)


BLOCKS = T.ArrayType(T.StructType([T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))]))


def response_text(payload: Column) -> Column:
    """The texts of all blocks of a response, joined."""
    parts = F.flatten(F.transform(F.from_json(F.get_json_object(payload, "$.output"), BLOCKS), lambda b: F.coalesce(b["content"], F.array().cast(BLOCKS.elementType["content"].dataType))))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
