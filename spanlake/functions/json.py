"""Column helpers for semi-structured event bodies.

Bodies travel as JSON text and are parsed once into VARIANT; these helpers give
the JavaScript-style coercions the event model is defined by (a field is
"defined" unless missing or JSON null; ids and names accept strings, numbers and
booleans; JSON kept as text). All are plain Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def vget(v: Column, path: str) -> Column:
    """Sub-value of a VARIANT at a JSON path (SQL NULL when missing)."""
    return F.try_variant_get(v, path, "variant")


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("ARRAY"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(vtype(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    return F.coalesce(vtype(v).rlike(_NUMBER_TYPES), F.lit(False))


def is_bool(v: Column) -> Column:
    return F.coalesce(vtype(v) == "BOOLEAN", F.lit(False))


def is_defined(v: Column) -> Column:
    """Present and not JSON null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def js_string(v: Column) -> Column:
    """string → itself, number/boolean → text, anything else → NULL."""
    scalar = is_string(v) | is_number(v) | is_bool(v)
    return F.when(scalar, F.try_variant_get(v, "$", "string"))


def json_text(v: Column) -> Column:
    """Serialise a defined value (any JSON type) back to text; NULL otherwise."""
    return F.when(is_defined(v), F.to_json(v))


def object_text(v: Column) -> Column:
    """Serialise only when the value is a JSON object."""
    return F.when(is_object(v), F.to_json(v))


def lenient_number(text: Column) -> Column:
    """JavaScript ``Number(text)`` restricted to finite results.

    Blank text is 0, decimal and exponent forms and 0x-hex parse, anything else
    (``1d``, ``abc``, ``Infinity``) is NULL. Spark's own cast accepts ``1d``,
    hence the explicit patterns.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    hexa = t.rlike(r"^0[xX][0-9a-fA-F]+$")
    as_double = (t).try_cast("double")
    # digit by digit, so that any length is a number
    digits = F.when(hexa, F.filter(F.split(F.substr(t, F.lit(3)), ""), lambda c: c != ""))
    hex_value = F.aggregate(digits, F.lit(0.0), lambda acc, c: acc * 16 + F.conv(c, 16, 10).try_cast("double"))
    return (
        F.when(t == "", F.lit(0.0))
        .when(decimal & ~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf"))), as_double)
        .when(hexa & (F.abs(hex_value) != F.lit(float("inf"))), hex_value)
    )


def js_number(v: Column) -> Column:
    """Finite number, or a string that parses as one; NULL otherwise."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double")).when(
        is_string(v), lenient_number(F.try_variant_get(v, "$", "string"))
    )


def nonnegative_number(v: Column) -> Column:
    """Non-negative finite number from a number or non-blank numeric text."""
    s = F.try_variant_get(v, "$", "string")
    n = F.when(is_number(v), F.try_variant_get(v, "$", "double")).when(
        is_string(v) & (F.trim(s) != ""), lenient_number(s)
    )
    return F.when(n >= 0, n)


def parse_or_text(text: Column) -> Column:
    """JSON-parse text when it is valid JSON, else keep it as a JSON string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))
