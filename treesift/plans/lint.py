"""Checks of format strings before they run: what is likely a slip, as messages."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from treesift.operators.formats import _CONVERSION, _FREE, COLORS, Descriptor, effect_code, parse_format

_SILENT = ("color", "decoration", "label", "note", "title")


def lint(text: str) -> list[str]:
    """Messages about a format string, none if it is sound; a format that can't be parsed gives that one message."""
    try:
        fields = parse_format(text)
    except ValueError as e:
        return [str(e)]
    found: list[str] = []
    depth = 0
    for k, d in enumerate(fields):
        found += _field(d, fields[k - 1] if k else None)
        depth += {"start-anchor": 1, "stop-anchor": -1}.get(d.role, 0)
        if depth < 0:
            found.append("an anchor is closed that was not opened")
            depth = 0
    if depth:
        found.append("an anchor is not closed")
    return found


def check_types(text: str, schema: T.StructType, inputs: dict[str, list[str]] | None = None) -> list[str]:
    """Messages about a format's fields against a schema: fields without a column, and conversions that their columns' types don't fit."""
    found: list[str] = []
    for d in parse_format(text):
        if d.role != "value" or "argument" in d.modifiers:
            continue
        for form in filter(None, (d.form, d.encoding)):
            names = (inputs or {}).get(d.content, [d.content])
            letters = [x for m in _CONVERSION.finditer(form) if m[3] not in _FREE for x in ["d"] * m[2].count("*") + [m[3]]]
            if letters and len(letters) != len(names):
                found.append(f"{d.content!r} has {len(names)} values for {len(letters)} conversions")
            found += [m for letter, name in zip(letters, names, strict=False) if (m := _fits(letter, name, schema))]
        if not d.form and not d.empty and d.content not in schema.names and not (inputs or {}).get(d.content):
            found.append(f"no column {d.content!r}")
    return list(dict.fromkeys(found))


def _fits(letter: str, name: str, schema: T.StructType) -> str | None:
    if name not in schema.names:
        return f"no column {name!r}"
    dtype = schema[name].dataType
    dtype = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if letter in "diouxXDUOcCp" and not whole:
        return f"%{letter} shows whole numbers, {name!r} is {dtype.simpleString()}"
    if letter in "eEfFgG" and not isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return f"%{letter} shows fractions, {name!r} is {dtype.simpleString()}"
    if letter in "sS" and not isinstance(dtype, T.StringType):
        return f"%{letter} shows texts, {name!r} is {dtype.simpleString()}"
    return None


def _conversions(form: str) -> int:
    return sum((m[3] not in _FREE) + m[2].count("*") for m in _CONVERSION.finditer(form))


def _field(d: Descriptor, before: Descriptor | None) -> list[str]:
    out: list[str] = []
    if d.role == "text":
        return ["a percent sign in text is literal"] if re.search(r"%[-0-9.]*[a-z]", d.content) else out
    if before is not None and before.role == "text" and re.search(r"(^|\s)[CDELNPTUVW]$", before.content):
        out.append("text before a field ends in what looks like its role")
    if d.encoding and d.role in _SILENT:
        out.append(f"a {d.role} has no encoding format")
    if d.content and d.form and d.role in ("color", "decoration", "label", "note"):
        out.append(f"a {d.role} has content or a format, not both")
    if d.form and d.encoding and _conversions(d.form) != _conversions(d.encoding):
        out.append("the encoding format takes another number of values")
    if "%" in d.content and d.role in _SILENT:
        out.append("a slash may be missing before the format")
    if "humanize" in d.modifiers and not d.form:
        out.append("humanize needs a format")
    if any(m.startswith("hn-") for m in d.modifiers) and "humanize" not in d.modifiers:
        out.append("hn- modifiers need the modifier h")
    if d.role == "color":
        for name in filter(None, (e.strip() for e in d.content.split(","))):
            if name in COLORS:
                out.append(f"colour {name!r} needs fg- or bg-")
            elif effect_code(name) is None:
                out.append(f"no such colour or effect: {name!r}")
    if d.role in ("start-anchor", "stop-anchor"):
        if d.content and not re.fullmatch(r"-?\d+", d.content):
            out.append("an anchor's content is its width")
        if d.form and d.form != "%d":
            out.append("an anchor's format is %d")
        if d.encoding or (d.content and d.form):
            out.append("an anchor has one width")
    if d.role == "value" and "argument" not in d.modifiers:
        out += _name(d.content)
    for m in _CONVERSION.finditer(d.form):
        if m[2].count(".") > 1 and m[3] not in "sS":
            out.append("a third width is for texts only")
    return out


def _name(name: str) -> list[str]:
    if not name:
        return ["a value needs a name"]
    checks = [
        (name[0].isdigit(), "a name starts with a digit"),
        ("_" in name, "a name has an underscore, not a hyphen"),
        (name != name.lower(), "a name has capitals"),
        (len(name) <= 2, "a name is too short to tell much"),
        (not re.fullmatch(r"[\w.-]+", name), "a name has an odd character"),
    ]
    return [f"{message}: {name!r}" for wrong, message in checks if wrong]
