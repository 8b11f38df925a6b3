"""A whole option string applied to a DataFrame: filters, renaming, then a style or an encoder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift.operators.formats import Format
from treesift.operators.select import select
from treesift.operators.trees import json_document, tree_json, tree_xml, xml_document
from treesift.options import Options
from treesift.sources.encoders import ENCODERS, encode

#: Metadata of a column that option `info` shows: its type and what it means.
INFO_TYPE, INFO_HELP = "type", "help"


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with its columns and nested fields under their new names."""

    def changed(dtype: T.DataType) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return T.StructType([T.StructField(names.get(f.name, f.name), changed(f.dataType), f.nullable, f.metadata) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(changed(dtype.elementType), dtype.containsNull)
        return dtype

    return df.select(*[F.col(f"`{f.name}`").cast(changed(f.dataType)).alias(names.get(f.name, f.name)) for f in df.schema.fields])


def info_of(df: DataFrame) -> dict[str, tuple[str, str]]:
    """(type, help) of the columns that have such metadata."""
    found = {f.name: (f.metadata.get(INFO_TYPE, ""), f.metadata.get(INFO_HELP, "")) for f in df.schema.fields}
    return {n: x for n, x in found.items() if any(x)}


def render(df: DataFrame, options: str | Options, table: str, text: str = "", top: str = "", keys: Sequence[str] = (), document: bool = False, **select_options) -> DataFrame:
    """(line), or one column of an encoder: df's rows as the options say.

    `filter=` words are a union of filters over the table; `map=` renames columns at any depth. With a format `text` its fields are
    rendered in the style; without one, whole rows as trees below the containers of `top`, all of them one document if `document`.
    Styles text, html and sdparams need a format. `pretty` and `indent` lay trees out; `no-top` and `not-first` are for
    JSON documents; `info` shows columns' metadata in HTML, `xpath` their paths. `@name:options` is an encoder. Words
    that say how to write to a terminal or a locale (`utf8`, `flush`, `warn`, ...) have no data to change.
    """
    o = Options.parse(options) if isinstance(options, str) else options
    flags = o.flags
    if o.filters:
        df = select(df, o.filters, table, keys=keys, **select_options)
    if o.style in ENCODERS:
        return encode(_renamed(df, o.rename), ":".join([o.style, *o.encoder_options]), table, [o.rename.get(k, k) for k in keys])
    if text:
        xpath = "/" + "/".join([*filter(None, top.split("/")), table]) if "xpath" in flags else None
        form = Format(text, rename=o.rename, underscores="underscores" in flags, units="units" in flags, keys="keys" in flags, xpath=xpath, info=info_of(df) if "info" in flags else None, color="color" in flags, no_humanize="no-humanize" in flags)
        return df.select(form.render(df, o.style).alias("line"))
    layout = {"pretty": "pretty" in flags, "indent": o.indent, "underscores": "underscores" in flags}
    named, own_keys = _renamed(df, o.rename), [o.rename.get(k, k) for k in keys]
    if o.style == "json":
        if document:
            return json_document(named, table, top or "data", **layout, no_top="no-top" in flags, not_first="not-first" in flags)
        return tree_json(named, top, **layout)
    if o.style == "xml":
        shown = own_keys if "keys" in flags else []
        return xml_document(named, table, top or "data", shown) if document else tree_xml(named, table, top, shown, **layout)
    raise ValueError(f"style {o.style} needs a format")
