"""A document's text as Python's ``json.dumps(..., indent=2, sort_keys=True)`` prints it, with a line end, in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

from sylvatica.functions.floats import python_text

#: Characters with an escape of their own.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
INDENT = "  "


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.translate(F.lpad(F.hex(code.cast("long")), 4, "0"), "ABCDEF", "abcdef"))


def _escaped(character: Column) -> Column:
    """A character as it stands in an ASCII document: beyond the first plane as two units."""
    code = F.ascii(character)
    beyond = code - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(beyond, 10)), _unit(F.lit(0xDC00) + beyond.bitwiseAND(F.lit(0x3FF))))
    short = F.element_at(F.create_map(*[F.lit(x) for item in _SHORT.items() for x in item]), character)
    return F.coalesce(short, F.when((code >= 32) & (code < 127), character).when(code > 0xFFFF, pair).otherwise(_unit(code)))


def quoted(text: Column) -> Column:
    """A JSON string.  Only texts that need escapes are taken apart."""
    plain = F.when(text.rlike(r'[^ -~]|["\\]'), F.array_join(F.transform(F.split(text, ""), _escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), plain, F.lit('"'))


def _block(items: Column, brackets: str, level: int) -> Column:
    inner, outer = "\n" + INDENT * (level + 1), "\n" + INDENT * level
    return F.concat(F.lit(brackets[0] + inner), F.array_join(items, "," + inner), F.lit(outer + brackets[1]))


def _printed(value: Column, kind: DataType, level: int) -> Column:
    if isinstance(kind, StructType):
        named = [F.concat(F.lit(f"{_key(f.name)}: "), _printed(value[f.name], f.dataType, level + 1)) for f in sorted(kind.fields, key=lambda f: f.name)]
        told = _block(F.array(*named), "{}", level) if named else F.lit("{}")
    elif isinstance(kind, ArrayType):
        told = F.when(F.size(value) > 0, _block(F.transform(value, lambda x: _printed(x, kind.elementType, level + 1)), "[]", level)).otherwise(F.lit("[]"))
    elif isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value))
        printed = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), _printed(e["value"], kind.valueType, level + 1)))
        told = F.when(F.size(value) > 0, _block(printed, "{}", level)).otherwise(F.lit("{}"))
    elif isinstance(kind, StringType):
        told = quoted(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        spelled = python_text(value.cast("double"))
        told = F.when(F.isnan(value), F.lit("NaN")).when(F.abs(value) == float("inf"), F.regexp_replace(spelled, "inf", "Infinity")).otherwise(spelled)
    elif isinstance(kind, (BooleanType, IntegralType)):
        told = value.cast("string")
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(value.isNotNull(), told).otherwise(F.lit("null"))


def _key(name: str) -> str:
    import json

    return json.dumps(name)


def canonical(value: Column, kind: DataType) -> Column:
    """The document: keys sorted, two blanks of indent, all but ASCII escaped, a line end at its end."""
    return F.concat(_printed(value, kind, 0), F.lit("\n"))
