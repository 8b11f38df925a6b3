"""Nodes of a parsed filter."""

from __future__ import annotations

from dataclasses import dataclass, field


class FilterSyntaxError(ValueError):
    """The text is no filter."""


class UnsupportedFeature(FilterSyntaxError):
    """A known feature of wider path languages that this one rejects."""


@dataclass(frozen=True)
class Number:
    value: int | float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Attribute:
    name: str


@dataclass(frozen=True)
class Self:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negate:
    value: object


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Choice:
    """condition ? yes : no; yes is None for `condition ?: no`."""

    condition: object
    yes: object
    no: object


@dataclass(frozen=True)
class Step:
    name: str
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    absolute: bool = False
    negated: bool = field(default=False)
