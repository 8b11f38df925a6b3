"""The command-line front end: a format and its values become one row, rendered in a style."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift.operators.formats import _CONVERSION, Format, parse_format
from treesift.operators.render import info_of
from treesift.operators.select import select
from treesift.options import Options
from treesift.sources.encoders import ENCODERS, encode

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "\\": "\\"}


def unescaped(text: str) -> str:
    """Backslash escapes as their characters."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            out.append(_ESCAPES.get(text[at + 1], text[at + 1]))
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treesift", exit_on_error=False)
    for style in ("text", "json", "xml", "html"):
        p.add_argument(f"--{style}", dest="style", action="store_const", const=style)
    p.add_argument("--options", default="")
    for path in ("wrap", "open", "close", "instance", "leading-xpath"):
        p.add_argument(f"--{path}", default="")
    p.add_argument("--depth", type=int, default=0)
    for flag in ("pretty", "top-wrap", "not-first", "continuation"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("format", nargs="?", default="")
    p.add_argument("values", nargs="*")
    return p


def command(spark: SparkSession, arguments: Sequence[str]) -> DataFrame:
    """(line): what the command prints, as one row.

    --wrap puts the output inside containers, --instance inside one element; --open and --close give only the tags of
    a path, which have a form in XML and JSON. Filters see the values as a row named by --instance, else by the last
    of --wrap, else `data`; a row that they hide prints nothing. An encoder, as in `--options @csv`, takes the values as
    its record. --pretty, or options `pretty` and `indent`, lay JSON and XML out; --depth says how deep they start.
    --continuation, with which a shell script glues lines, has no row to change.
    """
    a = _parser().parse_args(list(arguments))
    options = Options.parse(a.options)
    style = a.style or options.style
    text = unescaped(a.format)
    row, schema, arguments_for = [], [], []
    values = iter(a.values)
    for d in parse_format(text):
        if "argument" in d.modifiers:
            d = type(d)(d.role, next(values, ""), d.modifiers, d.form, d.encoding)
            arguments_for.append(d.content)
        if d.role == "value" and d.content not in [f.name for f in schema] and (not d.form or _CONVERSION.search(d.form)):
            m = _CONVERSION.search(d.form) if d.form else None
            kind = T.LongType() if m and m[3] in "diouxXDU" else T.DoubleType() if m and m[3] in "eEfFgG" else T.StringType()
            given = next(values, None)
            row.append(given if given is None or isinstance(kind, T.StringType) else int(given, 0) if isinstance(kind, T.LongType) else float(given))
            schema.append(T.StructField(d.content, kind))
    df = spark.createDataFrame([tuple(row)], T.StructType(schema)) if schema else spark.range(1, numPartitions=1).select()
    path = [p for p in a.wrap.split("/") if p]
    flags = options.flags
    row_name = a.instance or (path[-1] if path else "data")
    if options.filters:
        df = select(df, options.filters, row_name, keys=[d.content for d in parse_format(text) if "key" in d.modifiers])
    if style in ENCODERS:
        return encode(df, ":".join([style, *options.encoder_options]), row_name)
    pretty = options.indent if a.pretty or "pretty" in flags else None
    not_first, no_top = a.not_first or "not-first" in flags, "no-top" in flags
    xpath = f"{a.leading_xpath}/{'/'.join(path)}".rstrip("/") if "xpath" in flags else None
    form = Format(text, rename=options.rename, underscores="underscores" in flags, units="units" in flags, keys="keys" in flags, xpath=xpath, arguments=arguments_for, color="color" in flags, no_humanize="no-humanize" in flags, info=info_of(df) if "info" in flags else None, pretty=pretty, depth=a.depth + len([*path, *filter(None, a.open.split("/"))]) + bool(a.instance))
    line = form.render(df, style) if text else F.lit("")
    if style in ("xml", "json"):
        names = [*path, *([a.instance] if a.instance else [])]
        opens, closes = [p for p in a.open.split("/") if p], [p for p in a.close.split("/") if p]
        top = a.top_wrap and not no_top

        def at(depth: int) -> str:
            return "" if pretty is None else "\n" + " " * (pretty * (a.depth + depth))

        deep = len(opens) + len(names)
        if style == "xml":
            head = "".join(f"{at(k)}<{n}>" for k, n in enumerate([*opens, *names]))
            tail = "".join(f"{at(deep - 1 - k)}</{n}>" for k, n in enumerate([*reversed(names), *reversed(closes)]))
        else:
            line = F.regexp_replace(line, r"^\{|\s*\}$", "") if text else line
            head = (", " if not_first else "") + ("{" if top and not a.close else "") + "".join(f'{at(k + 1)}"{n}": {{' for k, n in enumerate([*opens, *names]))
            tail = "".join(f"{at(deep - k)}}}" for k in range(len(names) + len(closes))) + (at(0) + "}" if top and not a.open else "")
        line = F.concat(F.lit(head), line, F.lit(tail))
        line = F.regexp_replace(line, r"^\n", "") if pretty is not None else line
    return df.select(line.alias("line"))
