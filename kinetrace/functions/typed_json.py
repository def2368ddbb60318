"""JSON leaves told apart by type, without coercion: values are variants, so 1, 1.0, true and "1" stay four different things.

A payload that is no JSON, has text behind its value or repeats a key is null, and so is what is missing; a JSON null is not. JSON has no NaN. Whole numbers beyond 64 bits
count as real.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The value of a whole text as a variant."""
    # within brackets nothing may follow the value but another one; from_json keeps its parser's tables from row to row, and reads no more than JSON with these options
    whole = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<variant>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"})
    return bind(whole, lambda held: F.when(F.size(held) == 1, F.get(held, F.lit(0))))


def path(keys: tuple[str, ...]) -> str:
    """A path of variants has no escapes: a key with one sort of quotes goes between the other."""
    if any("'" in k and '"' in k for k in keys):
        raise ValueError(f"no path for {keys!r}")
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def at(value: Column, *keys: str) -> Column:
    """What an object holds below some keys."""
    return F.try_variant_get(value, path(keys), "variant")


# The types of a variant by the first word of their names.
KINDS = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "real", "DOUBLE": "real", "FLOAT": "real", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(value: Column) -> Column:
    """``missing, null, boolean, integer, real, string, array`` or ``object``."""
    head = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(t) for pair in KINDS.items() for t in pair]), head), F.lit("missing"))


# The kinds whose type has one name, which costs less to compare than a kind to find.
PLAIN_KINDS = {"null": "VOID", "boolean": "BOOLEAN", "integer": "BIGINT", "string": "STRING"}


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether ``kind(value)`` is one of some; false, not null, for what is missing."""
    if len(kinds) == 1 and kinds[0] in PLAIN_KINDS:
        return F.coalesce(F.schema_of_variant(value) == PLAIN_KINDS[kinds[0]], F.lit(False))
    if kinds == ("object",):
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    return kind(value).isin(*kinds)


def number(value: Column) -> Column:
    """A finite JSON number as a double; null for anything else, also for what could be read as one."""
    return bind(F.when(is_kind(value, "integer", "real"), F.try_variant_get(value, "$", "double")), lambda x: F.when(F.abs(x) < float("inf"), x))


def whole(value: Column) -> Column:
    return F.when(is_kind(value, "integer"), F.try_variant_get(value, "$", "bigint"))


def string(value: Column) -> Column:
    return F.when(is_kind(value, "string"), F.try_variant_get(value, "$", "string"))


def flag(value: Column) -> Column:
    return F.when(is_kind(value, "boolean"), F.try_variant_get(value, "$", "boolean"))


def items(value: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def keys(value: Column) -> Column:
    """The keys of an object; null for anything else."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def key_fault(value: Column, expected: tuple[str, ...], path: str) -> Column:
    """What an object lacks and what it has too much, or null if its keys are those expected."""
    wanted = F.lit(sorted(expected))
    listed = lambda a: F.array_join(F.sort_array(a), ",")
    text = lambda held: F.concat(F.lit(f"{path}: missing "), listed(F.array_except(wanted, held)), F.lit("; unexpected "), listed(F.array_except(held, wanted)))
    return bind(keys(value), lambda held: F.when(F.array_sort(held) != wanted, text(held)))


def first_fault(*rules: tuple[Column, Column | str]) -> Column:
    """The text of the first rule that is broken, in the order given; a rule that cannot be told counts as kept."""
    return F.coalesce(*[F.when(broken, F.lit(text) if isinstance(text, str) else text) for broken, text in rules], F.lit(None).cast("string"))
