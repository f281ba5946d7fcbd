"""Strict reading of JSON reports as VARIANT values: what a field's type is, and rules over it that never convert.

A field that is absent and one that is null differ, as do 1 and "1". A number that a double can't hold is none. A text that repeats a key
isn't read. `first_issue` gives the code of the first rule that a report breaks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import gates


_WORDS = {"OBJECT": "object", "ARRAY": "array", "BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def parsed(text: Column) -> Column:
    """The value of a JSON text; null if it isn't JSON."""
    return F.try_parse_json(text)


def kind(v: Column, path: str = "$") -> Column:
    """object, array, number, string, boolean, null, or SQL null where the path leads nowhere."""
    said = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.try_element_at(F.create_map(*(F.lit(w) for pair in _WORDS.items() for w in pair)), F.substring_index(F.substring_index(said, "<", 1), "(", 1))  # once: a type is asked for in nearly every rule


def number(v: Column, path: str) -> Column:
    """A finite number; null for anything else."""
    x = F.try_variant_get(v, path, "double")
    return F.when((kind(v, path) == "number") & (F.abs(x) < float("inf")), x)


def string(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "string", F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "boolean", F.try_variant_get(v, path, "boolean"))


def items(v: Column, path: str) -> Column:
    """The values of an array, as variants; null for anything else."""
    return F.when(kind(v, path) == "array", F.try_variant_get(v, path, "array<variant>"))


def numbers(v: Column, path: str) -> Column:
    """An array of numbers alone; null for anything else."""
    held = items(v, path)
    return F.when(F.forall(held, lambda x: number(x, "$").isNotNull()), F.transform(held, lambda x: number(x, "$")))


def strings(v: Column, path: str) -> Column:
    held = items(v, path)
    return F.when(F.forall(held, lambda x: F.coalesce(kind(x) == "string", F.lit(False))), F.transform(held, lambda x: F.try_variant_get(x, "$", "string")))


def given(v: Column, path: str) -> Column:
    """Whether a field is there, null or not."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def let(x: Column, of) -> Column:
    """of(x), with x computed once."""
    return F.transform(F.array(x), of)[0]


def yes(rule: Column) -> Column:
    """A rule that has no answer isn't kept."""
    return F.coalesce(rule, F.lit(False))


def whole(x: Column) -> Column:
    return yes((x == F.floor(x)) & (F.abs(x) <= 2**53 - 1))


def first_issue(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that isn't kept; null if all are."""
    return gates.first_reason(*((code, ~yes(rule)) for code, rule in rules))
