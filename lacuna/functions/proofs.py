"""Typed proof hash of nested values: SHA-256 of a canonical text in which each number is its IEEE-754 double.

The text tags every value with its kind, gives numbers as sixteen hexadecimal digits (minus zero as zero) and sorts the fields
of structs and the keys of maps by their UTF-8 bytes, so that it depends neither on a number format nor on column order.
Everything is an expression of the value's type, so Spark makes the text without Python. Kinds: null, boolean, any number,
string, array, struct, map with string keys; others are refused when the expression is built.

A value with NaN, an infinite number or a whole number beyond 2**53 - 1 has no text and no hash (null). An empty array, struct
or map has one; a null anywhere is the kind null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the name of the encoding, hashed in front of the text.
ENCODING = "typed-json-finite-f64be-v1"
_SAFE = 2**53 - 1
#: Stands for a value without a text; it can't occur in one, since control characters are escaped.
_NONE = "\0"
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string, escaping no more than it must."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(_SHORT.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def double_hex(x: Column) -> Column:
    """The sixteen hexadecimal digits of a double, zero without a sign."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(x == 0, F.lit(0.0)).otherwise(x))
    return F.lower(F.lpad(F.hex(bits.cast("long")), 16, "0"))


def _number(x: Column) -> Column:
    d = x.cast("double")
    sound = ~F.isnan(d) & (F.abs(d) <= _SAFE) & (x <= _SAFE) & (x >= -_SAFE)  # doubles beyond are all whole
    return F.when(sound, F.concat(F.lit('["number","'), double_hex(d), F.lit('"]'))).otherwise(F.lit(_NONE))


def _list(parts: Column, kind: str) -> Column:
    return F.concat(F.lit(f'["{kind}",['), F.array_join(parts, ","), F.lit("]]"))


def canonical(x: Column, kind: T.DataType) -> Column:
    """The text of a value, with _NONE in it where there is none."""
    if isinstance(kind, T.BooleanType):
        text = F.when(x, F.lit('["bool",true]')).otherwise(F.lit('["bool",false]'))
    elif isinstance(kind, T.NumericType):
        text = _number(x)
    elif isinstance(kind, T.StringType):
        text = F.concat(F.lit('["string",'), quoted(x), F.lit("]"))
    elif isinstance(kind, T.NullType):
        return F.lit('["null"]')
    elif isinstance(kind, T.ArrayType):
        text = _list(F.transform(x, lambda v: canonical(v, kind.elementType)), "array")
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        text = _list(F.array(*(F.concat(F.lit(f"[{json.dumps(f.name, ensure_ascii=False)},"), canonical(x.getField(f.name), f.dataType), F.lit("]")) for f in fields)), "object")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        text = _list(F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(F.lit("["), quoted(k), F.lit(","), canonical(F.element_at(x, k), kind.valueType), F.lit("]"))), "object")
    else:
        raise TypeError(f"no proof text for {kind.simpleString()}")
    return F.when(x.isNull(), F.lit('["null"]')).otherwise(text)


def proof_hash(x: Column, kind: T.DataType) -> Column:
    """Lower-case hexadecimal SHA-256 of the encoding's name, a zero byte and the text; null if there is no text."""
    text = canonical(x, kind)
    return F.when(~F.contains(text, F.lit(_NONE)), F.sha2(F.concat(F.lit(ENCODING + "\0"), text), 256))
