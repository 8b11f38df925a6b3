"""Values with a static kind, and the language's own rules to coerce and compare them.

Kinds: str, int, float, bool, invalid. A missing field of an instance counts as '', so as 0 where a number is wanted.
Conditions may be NULL for false; `holds` closes them where that matters, and leaves a plain comparison alone so that
it reaches the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    #: The Python value of a literal.
    literal: object = None
    #: Whether col may be NULL for a missing field.
    open: bool = False


def literal(x: object) -> Value:
    if isinstance(x, int) and not -(2**63) <= x < 2**63:
        x = float(x)  # no column type of Spark holds these exactly and computes with them
    kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "str"
    return Value(kind, F.lit(x), x)


def field_value(col: Column, dtype: T.DataType) -> Value:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value("int", col, open=True)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Value("float", col, open=True)
    if isinstance(dtype, T.BooleanType):
        return Value("bool", col, open=True)
    return Value("str", col if isinstance(dtype, T.StringType) else col.cast("string"), open=True)


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


#: The largest and smallest whole numbers; text beyond them stands for the nearest.
MOST, LEAST = 2**63 - 1, -(2**63)
_HEX_MOST = 2**64 - 1


def _digits(digits: Column, base: int, fit: int, most: int) -> Column:
    """A whole number of digits as a double; one of over `fit` digits, leading zeros aside, is `most`."""
    own = F.ltrim(digits, F.lit("0"))
    short = F.when(F.char_length(own) <= fit, own)
    return F.least(F.coalesce(F.conv(F.when(short != "", short).otherwise(F.when(short == "", "0")), base, 10).try_cast("double"), F.lit(float(most))), F.lit(float(most)))


def text_number(s: Column) -> Column:
    """The double that a text stands for: hexadecimal after 0x, octal after 0, decimal, inf; else, and for '', 0.

    Whole numbers stay within 64 bits: unsigned after a plain 0x, else signed. No text raises an error.
    """
    t = F.ltrim(s, F.lit(" \t\n\x0b\f\r"))
    sign = F.when(F.startswith(t, F.lit("-")), -1.0).otherwise(1.0)
    body = F.regexp_extract(t, r"^[+-]?0[xX]?([0-9a-fA-F]+)$", 1)
    whole = F.least(F.greatest(t.try_cast("double"), F.lit(float(LEAST))), F.lit(float(MOST)))
    return (
        F.when(t.rlike(r"^[+-]?(0|[1-9]\d*)$"), whole)
        .when(t.rlike(r"^0x[0-9a-fA-F]+$"), _digits(body, 16, 16, _HEX_MOST))
        .when(t.rlike(r"^[+-]?0[xX][0-9a-fA-F]+$"), _digits(body, 16, 16, MOST) * sign)
        .when(t.rlike(r"^[+-]?0[0-7]+$"), _digits(body, 8, 21, MOST) * sign)
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
        .when(t.rlike(r"^(?i)[+-]?inf(inity)?$"), F.lit(float("inf")) * sign)
        .otherwise(F.lit(0.0))
    )


def xnum(v: Value) -> Column:
    """A number; never NULL."""
    if v.kind == "str":
        return F.coalesce(text_number(F.coalesce(v.col, F.lit(""))), F.lit(0.0))
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False)).cast("int")
    if v.kind == "invalid":
        return F.lit(0)
    return F.coalesce(v.col, F.lit(0)) if v.open else v.col


def whole(v: Value, most: int = MOST, least: int = LEAST) -> Column:
    """The number as a bigint, its fraction cut off, held between least and most; what is no number is 0."""
    if v.kind == "int":
        return F.least(F.greatest(xnum(v).cast("bigint"), F.lit(least).cast("bigint")), F.lit(most).cast("bigint"))
    x = xnum(v).cast("double")
    cut = F.coalesce(x.try_cast("bigint"), F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x > 0, F.lit(MOST)).otherwise(F.lit(LEAST)))
    return F.least(F.greatest(cut, F.lit(least).cast("bigint")), F.lit(most).cast("bigint"))


def xbool(v: Value) -> Column:
    """A condition; fractions are cut first, so 0.5 is false."""
    if v.kind == "bool":
        return v.col
    if v.kind == "int":
        return v.col != 0
    return F.abs(xnum(v)) >= 1


def xstr(v: Value) -> Column:
    """Text; never NULL. Computed fractions have six decimals, as fields of a table print as Spark prints them."""
    if v.kind == "str":
        return F.coalesce(v.col, F.lit("")) if v.open else v.col
    if v.kind == "bool":
        return F.when(v.col, "true").otherwise("false")
    if v.kind == "invalid":
        return F.lit("")
    if v.kind == "float" and not v.open:
        return F.format_string("%f", v.col.cast("double"))
    return F.coalesce(v.col.cast("string"), F.lit(""))


_PLAIN = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _with_literal(op: str, v: Value, x: object) -> Column:
    """v op x for a field v: bare if a missing field fails it, with IS NULL if a missing field passes."""
    passes = _PLAIN[op]("" if v.kind == "str" else 0, x)
    c = _PLAIN[op](v.col, F.lit(x))
    return (c | v.col.isNull()) if v.open and passes else c


def compare(op: str, a: Value, b: Value, compat: bool) -> Column:
    """a op b. Two texts compare as texts, also two fields; else numbers. Truth and text, or truth and a fraction, have no order: equal under compat, else NULL."""
    kinds = {a.kind, b.kind}
    if "invalid" in kinds or ("bool" in kinds and kinds & {"str", "float"}):
        return F.lit(op in ("=", "<=", ">=")) if compat else F.lit(None).cast("boolean")
    if "bool" in kinds:  # false comes after true
        return _PLAIN[op](holds(xbool(b)).cast("int"), holds(xbool(a)).cast("int"))
    if a.open and b.open:
        return _PLAIN[op](xstr(a), xstr(b))
    if b.literal is not None and (a.kind == "str") == (b.kind == "str"):
        return _with_literal(op, a, b.literal)
    if a.literal is not None and (a.kind == "str") == (b.kind == "str"):
        return _with_literal(_MIRROR[op], b, a.literal)
    if kinds == {"str"}:
        return _PLAIN[op](xstr(a), xstr(b))
    return _PLAIN[op](xnum(a), xnum(b))
