"""Replay scripts: lines that open and close nodes and give fields, read into trees and then rows.

`+`/`-` container, `{`/`}` list, `<`/`>` instance, `[`/`]` leaf-list, `$` key, `=` field, `@` attribute, `?` filter,
`r` forget filters, `i` include, `q` stop, `#` comment. A script is a test's input and small, so it is read on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class Replay:
    """One block of a script: the filters in force and the tree that follows."""

    filters: list[str] = field(default_factory=list)
    tree: dict = field(default_factory=dict)
    keys: set[str] = field(default_factory=set)


def read_replay(lines: Iterable[str], include: Callable[[str], Iterable[str]] | None = None) -> list[Replay]:
    """The blocks of a script; each `r` begins one. ValueError for a line of no kind or a close that fits no open node."""
    blocks = [Replay()]
    _read(lines, include, blocks)
    return [b for b in blocks if b.tree or b.filters]


def _read(lines: Iterable[str], include: Callable[[str], Iterable[str]] | None, blocks: list[Replay]) -> bool:
    open_nodes: list[tuple[str, str, object]] = []
    for raw in lines:
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        mark, rest = line[0], line[1:].strip()
        name, _, value = rest.partition(" ")
        value = value.strip()
        block = blocks[-1]
        here = open_nodes[-1][2] if open_nodes else block.tree
        if mark == "q":
            return True
        if mark == "r":
            blocks.append(Replay())
            open_nodes.clear()
        elif mark == "?":
            block.filters.append(rest)
        elif mark == "i":
            if include is None:
                raise ValueError("the script includes another one, and no reader is given")
            if _read(include(rest), include, blocks):
                return True
        elif mark in "+{<[":
            open_nodes.append((mark, rest, _opened(mark, rest, here)))
        elif mark in "-}>]":
            if not open_nodes or open_nodes[-1][0] != {"-": "+", "}": "{", ">": "<", "]": "["}[mark]:
                raise ValueError(f"nothing to close: {line!r}")
            open_nodes.pop()
        elif mark in "=$@":
            if mark == "$":
                block.keys.add(name)
            if name and value:
                if isinstance(here, list):
                    here.append(value)
                else:
                    here["_" + name if mark == "@" else name] = value
        else:
            raise ValueError(f"a line of no kind: {line!r}")
    return False


def _opened(mark: str, name: str, here: object) -> object:
    if mark == "<":
        made: dict = {}
        target = here if isinstance(here, list) else here.setdefault(name, [])
        target.append(made)
        return made
    return here.setdefault(name, {} if mark == "+" else [])


def _schema(values: list) -> T.DataType:
    """The type that all of the values fit: structs have every field that one of them has."""
    if any(isinstance(v, dict) for v in values):
        names = dict.fromkeys(n for v in values if isinstance(v, dict) for n in v)
        return T.StructType([T.StructField(n, _schema([v[n] for v in values if isinstance(v, dict) and n in v])) for n in names])
    if any(isinstance(v, list) for v in values):
        return T.ArrayType(_schema([x for v in values if isinstance(v, list) for x in v]))
    return T.StringType()


def instances(spark: SparkSession, replay: Replay, path: str) -> DataFrame:
    """The instances, or the one container, at a path such as `servers/item`, as rows of text columns."""
    at: object = replay.tree
    for step in path.split("/"):
        at = at.get(step, {}) if isinstance(at, dict) else {}
    rows = at if isinstance(at, list) else [at] if at else []
    return spark.createDataFrame(rows, _schema(rows) if rows else T.StructType([]))
