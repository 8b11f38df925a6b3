"""Hierarchies: constructors of containers, lists, leaf-lists and attributes, and their text as JSON or XML.

Containers are structs, lists are arrays of structs, leaf-lists are arrays, and columns whose name starts with `_` are
attributes. Serialisers are Column expressions over a row's whole tree: no shuffle and no Python. A missing (null) node
is left out; JSON shows no attributes. An empty table gives no lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift.operators.formats import escape_json, escape_xml


def container(name: str, *columns: Column) -> Column:
    return F.struct(*columns).alias(name)


def leaf_list(name: str, *columns: Column) -> Column:
    """A list of bare values, as texts; missing ones are left out."""
    return F.array_compact(F.array(*[c.cast("string") for c in columns])).alias(name)


def attribute(name: str, value: Column) -> Column:
    return value.cast("string").alias(f"_{name}")


def versioned(df: DataFrame, version: str) -> DataFrame:
    """Every row with the attribute `version`."""
    return df.withColumn("_version", F.lit(version))


def nested_list(df: DataFrame, name: str, within: Sequence[str], columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """A row for each value of `within`, with its rows as a list ordered by `order_by`; a list is one value, so it must fit in a row."""
    own = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order_by)], F.struct(*columns).alias("it"))
    grouped = df.groupBy(*within).agg(F.sort_array(F.collect_list(own)).alias("__list"))
    return grouped.select(*within, F.transform("__list", lambda x: x["it"]).alias(name))


_BARE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


class _Layout:
    """Line breaks and indents, or none."""

    def __init__(self, pretty: bool, indent: int):
        self.pretty, self.indent = pretty, indent

    def line(self, depth: int) -> str:
        return "\n" + " " * (self.indent * depth) if self.pretty else ""


def _json(c: Column, dtype: T.DataType, depth: int, layout: _Layout, name_of: Callable[[str], str]) -> Column:
    inside, end = layout.line(depth + 1), layout.line(depth)
    if isinstance(dtype, T.StructType):
        colon = ": " if layout.pretty else ":"
        members = [F.concat(F.lit(f'{inside}"{name_of(f.name)}"{colon}'), _json(c[f.name], f.dataType, depth + 1, layout, name_of)) for f in dtype.fields if not f.name.startswith("_")]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit(f"{end}}}")))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(F.array_compact(c), lambda x: F.concat(F.lit(inside), _json(x, dtype.elementType, depth + 1, layout, name_of)))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit(f"{end}]"))
    text = c.cast("string")
    return text if isinstance(dtype, _BARE) else F.concat(F.lit('"'), escape_json(text), F.lit('"'))


def _xml(name: str, c: Column, dtype: T.DataType, depth: int, layout: _Layout, keys: frozenset, name_of: Callable[[str], str]) -> Column:
    start, end, tag = layout.line(depth), layout.line(depth), name_of(name)
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.transform(F.array_compact(c), lambda x: _xml(name, x, dtype.elementType, depth, layout, keys, name_of)), "")
    if isinstance(dtype, T.StructType):
        marks = [F.coalesce(F.concat(F.lit(f' {f.name[1:]}="'), escape_xml(c[f.name].cast("string"), True), F.lit('"')), F.lit("")) for f in dtype.fields if f.name.startswith("_")]
        inner = [_xml(f.name, c[f.name], f.dataType, depth + 1, layout, keys, name_of) for f in dtype.fields if not f.name.startswith("_")]
        return F.when(c.isNotNull(), F.concat(F.lit(f"{start}<{tag}"), *marks, F.lit(">"), F.concat_ws("", *inner), F.lit(f"{end}</{tag}>")))
    key = ' key="key"' if name in keys else ""
    return F.concat(F.lit(f"{start}<{tag}{key}>"), escape_xml(c.cast("string")), F.lit(f"</{tag}>"))


def _namer(underscores: bool) -> Callable[[str], str]:
    return (lambda n: n.replace("-", "_")) if underscores else (lambda n: n)


def _wrapped(path: Sequence[str], row: DataFrame) -> tuple[Column, T.DataType]:
    """All columns as a struct below the containers of path."""
    c, dtype = F.struct(*[F.col(f"`{n}`") for n in row.columns]), row.schema
    for name in reversed(path):
        c, dtype = F.struct(c.alias(name)), T.StructType([T.StructField(name, dtype)])
    return c, dtype


def tree_json(df: DataFrame, wrap: str = "", pretty: bool = False, indent: int = 2, underscores: bool = False) -> DataFrame:
    """(line): each row as a JSON object below the containers of `wrap`, a path such as `top/data`."""
    c, dtype = _wrapped([p for p in wrap.split("/") if p], df)
    return df.select(_json(c, dtype, 0, _Layout(pretty, indent), _namer(underscores)).alias("line"))


def tree_xml(df: DataFrame, name: str, wrap: str = "", keys: Sequence[str] = (), pretty: bool = False, indent: int = 2, underscores: bool = False) -> DataFrame:
    """(line): each row as the element `name` below those of `wrap`; fields of `keys` are marked as such."""
    path = [p for p in wrap.split("/") if p]
    c, dtype = _wrapped([], df)
    layout, name_of = _Layout(pretty, indent), _namer(underscores)
    head = "".join(f"{layout.line(k)}<{name_of(p)}>" for k, p in enumerate(path))
    tail = "".join(f"{layout.line(k)}</{name_of(p)}>" for k, p in reversed(list(enumerate(path))))
    text = F.concat(F.lit(head), _xml(name, c, dtype, len(path), layout, frozenset(keys), name_of), F.lit(tail))
    return df.select(F.btrim(text, F.lit("\n")).alias("line"))


def xml_document(df: DataFrame, name: str, top: str = "data", keys: Sequence[str] = ()) -> DataFrame:
    """(line): the opening of the containers of `top`, an element for each row, and their closing, in this order of partitions."""
    spark, path = df.sparkSession, [p for p in top.split("/") if p]

    def edge(text: str) -> DataFrame:
        return spark.range(1, numPartitions=1).select(F.lit(text).alias("line"))

    opening, closing = "".join(f"<{p}>" for p in path), "".join(f"</{p}>" for p in reversed(path))
    return edge(opening).unionByName(tree_xml(df, name, keys=keys)).unionByName(edge(closing))


def json_document(df: DataFrame, name: str, top: str = "data", pretty: bool = False, indent: int = 2, underscores: bool = False, no_top: bool = False, not_first: bool = False) -> DataFrame:
    """(line): one JSON document in this order of partitions: the opening of `top`, the rows as the list `name`, the closing.

    `no_top` leaves out the outermost braces, `not_first` puts a comma before all, so that the text goes on one begun
    elsewhere. The row that no comma precedes is found by a first pass over the rows' numbers alone; the plan must give the same
    partitions both times, as scans and filters do (else checkpoint it).
    """
    spark, path, layout, name_of = df.sparkSession, [p for p in top.split("/") if p], _Layout(pretty, indent), _namer(underscores)
    colon, outer = ": " if pretty else ":", 0 if no_top else 1

    def edge(text: str) -> DataFrame:
        return spark.range(1, numPartitions=1).select(F.lit(text).alias("line"))

    heads = [f'"{name_of(p)}"{colon}{{' for p in path] + [f'"{name_of(name)}"{colon}[']
    opening = (", " if not_first else "") + ("" if no_top else "{") + "".join((layout.line(outer + k) if outer or k else "") + h for k, h in enumerate(heads))
    closes = ["]"] + ["}"] * len(path)
    closing = "".join(layout.line(outer + len(path) - k) + c for k, c in enumerate(closes)) + ("" if no_top else layout.line(0) + "}")
    c, dtype = _wrapped([], df)
    depth = outer + len(path) + 1
    text = F.concat(F.lit(layout.line(depth).removeprefix("\n")), _json(c, dtype, depth, layout, name_of))
    first = df.select(F.monotonically_increasing_id().alias("n")).agg(F.min("n")).first()[0]
    rows = df.select(text.alias("text"), F.monotonically_increasing_id().alias("n"))
    lines = rows.select(F.concat(F.when(F.col("n") == F.lit(first), "").otherwise(","), F.col("text")).alias("line"))
    return edge(opening).unionByName(lines).unionByName(edge(closing.removeprefix("\n")))
