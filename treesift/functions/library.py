"""The closed table of scalar functions. A wrong number of arguments gives false, an unknown name an invalid value, both with a warning.

Positions and lengths count bytes, and translate() maps bytes; a cut inside a character leaves its bytes as they are.
No value of a column raises an error: a position is held within a text, a bad pattern matches nothing.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from treesift.functions.coerce import Value, holds, literal, whole, xbool, xnum, xstr
from treesift.plans.ast import UnsupportedFeature
from treesift.shipping import ship

log = logging.getLogger("treesift")
#: POSIX classes of regular expressions.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}"}


def _text(c: Column) -> Value:
    return Value("str", c)


def _truth(c: Column) -> Value:
    return Value("bool", c)


def _float(c: Column) -> Value:
    return Value("float", c)


def _number(v: Value) -> Value:
    return v if v.kind in ("int", "float") else Value("float", xnum(v).cast("double"))


def _bytes(c: Column) -> Column:
    """A text's bytes as the characters U+0000 to U+00FF."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def _joined(c: Column) -> Column:
    return F.encode(c, "ISO-8859-1").cast("string")


def _substring(s: Value, pos: Value, length: Value | None = None) -> Value:
    most = 2**31 - 1
    first, n = whole(pos, most, 1).cast("int"), whole(length, most, 0).cast("int") if length else F.lit(most)
    return _text(F.substring(xstr(s).cast("binary"), first, n).cast("string"))


def _after(s: Value, t: Value) -> Value:
    text, find = xstr(s), xstr(t)
    found = F.instr(text, find)
    return _text(F.when(found > 0, F.substring(text, found + F.length(find), F.lit(2**31 - 1))).otherwise(""))


def _before(s: Value, t: Value) -> Value:
    text, find = xstr(s), xstr(t)
    found = F.instr(text, find)
    return _text(F.when(found > 0, F.substring(text, F.lit(1), found - 1)).otherwise(""))


def _translate(s: Value, a: Value, b: Value) -> Value:
    plain = [v.literal for v in (a, b) if isinstance(v.literal, str) and v.literal.isascii()]
    if len(plain) == 2:  # ASCII is never part of another character
        return _text(F.translate(xstr(s), *plain))
    return _text(_joined(F.call_function("translate", *[_bytes(xstr(v)) for v in (s, a, b)])))


def _java(pattern: str, flags: str) -> str:
    """A pattern with POSIX classes and flags as Java's; ValueError for an unknown class."""
    unknown = [m[1] for m in re.finditer(r"\[:(\w+):\]", pattern) if m[1] not in POSIX]
    if unknown:
        raise ValueError(f"no such class: {unknown[0]}")
    java = re.sub(r"\[:(\w+):\]", lambda m: POSIX[m[1]], pattern)
    return ("(?i)" if "i" in flags else "") + ("(?m)" if "n" in flags else "(?s)") + java


def _groups(java: str) -> int | None:
    """How many groups a pattern has; None if it is none."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and hasattr(spark, "_jvm"):
            return spark._jvm.java.util.regex.Pattern.compile(java).matcher("").groupCount()
        return re.compile(java).groups
    except Exception as e:
        log.warning("no pattern: %r: %s", java, str(e).splitlines()[0])
        return None


def _python(pattern: str) -> str:
    """A pattern with POSIX classes spelled out for Python; bytes beyond ASCII belong to none."""
    spelled = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "punct": r"!-/:-@\[-`{-~", "space": r"\s", "blank": r" \t", "cntrl": r"\x00-\x1f\x7f", "graph": "!-~", "print": " -~", "xdigit": "0-9A-Fa-f"}
    return re.sub(r"\[:(\w+):\]", lambda m: spelled[m[1]], pattern)


def _computed_match(pattern: Column, text: Column, flags: str, group: int | None) -> Column:
    """rematch() of a pattern that differs by row: Spark's own functions would end the job at a bad one, so Arrow batches go through Python."""
    bits, spell = (re.I if "i" in flags else 0) | (re.M if "n" in flags else re.S), _python

    @F.pandas_udf("string")
    def found(patterns: pd.Series, texts: pd.Series) -> pd.Series:
        known: dict[str, re.Pattern | None] = {}
        out = []
        for p, t in zip(patterns, texts, strict=True):
            if p not in known:
                try:
                    known[p] = re.compile(spell(p), bits)
                except (re.error, KeyError, RecursionError, OverflowError):
                    known[p] = None
            m = known[p].search(t) if known[p] is not None else None
            out.append(None if m is None else (m[group or 0] or "") if (group or 0) <= known[p].groups else "")
        return pd.Series(out, dtype=object)

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return found(pattern, text)


def _rematch(pattern: Value, s: Value, flags: Value | None = None) -> Value:
    if flags and not isinstance(flags.literal, str):
        raise UnsupportedFeature("rematch() with computed flags")
    said = flags.literal if flags else ""
    if set(said) & set("b^$"):
        raise UnsupportedFeature(f"rematch() flags in {said!r}")
    m = re.search(r"m(\d?)", said)
    group = 0 if "s" in said else int(m[1] or 1) if m else None
    if not isinstance(pattern.literal, str):
        hit = _computed_match(xstr(pattern), xstr(s), said, group)
        return _truth(hit.isNotNull()) if group is None else _text(F.coalesce(hit, F.lit("")))
    try:
        java = _java(pattern.literal, said)
        n = _groups(java)
    except ValueError as e:
        log.warning("no pattern: %s", e)
        n = None
    if group is None:
        return literal(False) if n is None else _truth(xstr(s).rlike(java))
    return literal("") if n is None or group > n else _text(F.regexp_extract(xstr(s), java, group))


def _sum(*args: Value) -> Value:
    total = F.lit(0.0)
    for a in args:
        total = total + xnum(a)
    return _float(total)


def _edge(x: Value, to: Callable[[Column], Column]) -> Value:
    """ceil or floor of a double; those from 2**52 on have no fraction."""
    c = xnum(x).cast("double")
    return _float(F.when(F.abs(c) < 2.0**52, to(c).cast("double")).otherwise(c))


def _choose(c: Value, a: Value, b: Value) -> Value:
    kind = a.kind if a.kind == b.kind else "str"
    pick = {"str": xstr, "bool": lambda v: holds(xbool(v))}.get(kind, xnum)
    return Value(kind, F.when(xbool(c), pick(a)).otherwise(pick(b)))


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "boolean": (1, 1, lambda x: _truth(holds(xbool(x)))),
    "ceiling": (1, 1, lambda x: _edge(x, F.ceil)),
    "choose": (3, 3, _choose),
    "choose2": (2, 2, lambda a, b: _choose(a, a, b)),
    "concat": (2, 999, lambda *a: _text(F.concat(*map(xstr, a)))),
    "contains": (2, 2, lambda s, t: _truth(F.contains(xstr(s), xstr(t)))),
    "ends-with": (2, 2, lambda s, t: _truth(F.endswith(xstr(s), xstr(t)))),
    "false": (0, 0, lambda: literal(False)),
    "floor": (1, 1, lambda x: _edge(x, F.floor)),
    "normalize-space": (1, 1, lambda s: _text(F.trim(F.regexp_replace(xstr(s), r"[ \t\n\x0b\f\r]+", " ")))),
    "not": (1, 1, lambda x: _truth(~holds(xbool(x)))),
    "number": (1, 1, _number),
    "rematch": (2, 3, _rematch),
    "round": (1, 1, lambda x: _edge(x, F.round)),
    "starts-with": (2, 2, lambda s, t: _truth(F.startswith(xstr(s), xstr(t)))),
    "string": (1, 1, lambda x: _text(xstr(x))),
    "string-length": (1, 1, lambda s: Value("int", F.octet_length(xstr(s)))),
    "substring": (2, 3, _substring),
    "substring-after": (2, 2, _after),
    "substring-before": (2, 2, _before),
    "sum": (0, 999, _sum),
    "translate": (3, 3, _translate),
    "true": (0, 0, lambda: literal(True)),
}


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        log.warning("unknown function %s()", name)
        return Value("invalid", F.lit(None).cast("bigint"))
    least, most, build = FUNCTIONS[name]
    if not least <= len(args) <= most:
        log.warning("%s() takes %d to %d arguments, not %d", name, least, most, len(args))
        return literal(False)
    return build(*args)
