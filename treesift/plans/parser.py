"""Text of a filter to a list of paths: a lexer by one pattern, and a precedence climber."""

from __future__ import annotations

import re

from treesift.plans.ast import Attribute, Binary, Call, Choice, Field, FilterSyntaxError, Negate, Not, Number, Path, Self, Step, Text, UnsupportedFeature

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
  | (?P<hex>0[xX][0-9a-fA-F]+)
  | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<dots>\.\.\.?)
  | (?P<name>[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_:.\-\x80-\U0010ffff]*)
  | (?P<op>&&|\|\||==|!=|<=|>=|\?:|//|::|[-+*/|!<>=()\[\],?:@.$])
)""",
    re.X | re.S,
)
#: Word operators; elsewhere these are names.
_WORDS = frozenset(["and", "or", "div", "mod", "_"])
_SAME = {"&&": "and", "||": "or", "==": "="}
#: Binding power of binary operators, all left-associative.
_POWER = {"or": 1, "and": 2, "=": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "_": 5, "+": 6, "-": 6, "*": 7, "div": 7, "mod": 7}
_NODE_TESTS = frozenset(["comment", "id", "key", "node", "text", "processing-instruction"])
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterSyntaxError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        at = m.end()
        ended = bool(found) and (found[-1][0] in ("string", "hex", "number", "name", "wild", "self") or found[-1][1] in (")", "]"))
        if kind == "name" and value in _WORDS and ended:
            kind = "op"
        elif value == "*" and kind == "op" and not ended:
            kind = "wild"
        elif value == "." and kind == "op":
            kind = "self"
        elif kind == "name" and "::" in value:
            raise UnsupportedFeature("axis names")
        found.append((kind, _SAME.get(value, value) if kind == "op" else value))
    return [*found, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.now
        if value is not None and not self.sees(value):
            raise FilterSyntaxError(f"expected {value!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def sees(self, *values: str) -> bool:
        return self.now[0] == "op" and self.now[1] in values

    def paths(self) -> list[Path]:
        found = [self.path()]
        while self.sees("|"):
            self.take()
            found.append(self.path())
        if self.now[0] != "end":
            raise FilterSyntaxError(f"unexpected {self.now[1]!r}")
        return found

    def path(self) -> Path:
        negated = absolute = False
        if self.sees("!"):
            self.take()
            negated = True
        if self.sees("("):
            raise UnsupportedFeature("grouped paths")
        if self.sees("/"):
            self.take()
            absolute = True
        steps = [self.step()]
        while self.sees("/"):
            self.take()
            steps.append(self.step())
        if self.sees("//"):
            raise UnsupportedFeature("//")
        return Path(tuple(steps), absolute, negated)

    def step(self) -> Step:
        kind, value = self.now
        if kind == "dots" or self.sees("//", "$", "::", "@"):
            raise UnsupportedFeature(value)
        if kind not in ("name", "wild"):
            raise FilterSyntaxError(f"expected a name, found {value or 'the end'!r}")
        self.take()
        if self.sees("("):
            raise UnsupportedFeature(f"{value}() in a path")
        predicates = []
        while self.sees("["):
            self.take()
            predicates.append(self.expression())
            self.take("]")
        return Step(value, tuple(predicates))

    def expression(self):
        left = self.binary(0)
        if self.sees("?:"):
            self.take()
            return Choice(left, None, self.expression())
        if self.sees("?"):
            self.take()
            yes = self.expression()
            self.take(":")
            return Choice(left, yes, self.expression())
        return left

    def binary(self, least: int):
        left = self.unary()
        while self.now[0] == "op" and _POWER.get(self.now[1], 0) > least:
            op = self.take()[1]
            left = Binary(op, left, self.binary(_POWER[op]))
        return left

    def unary(self):
        if self.sees("-"):
            self.take()
            return Negate(self.unary())
        if self.sees("!"):
            self.take()
            return Not(self.unary())
        return self.primary()

    def primary(self):
        kind, value = self.take()
        if kind == "string":
            return Text(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "hex":
            return Number(int(value, 16))
        if kind == "number":
            return Number(int(value) if value.isdigit() else float(value))
        if kind == "self":
            return Self()
        if kind == "name":
            if self.sees("("):
                if value in _NODE_TESTS:
                    raise UnsupportedFeature(f"{value}()")
                return Call(value, tuple(self.arguments()))
            if self.sees("/", "//"):
                raise UnsupportedFeature("a path of several steps in a predicate")
            if self.sees("["):
                raise UnsupportedFeature("a predicate in a predicate")
            if self.sees("|"):
                raise UnsupportedFeature("a union in a predicate")
            return Field(value)
        if (kind, value) == ("op", "@"):
            kind, value = self.take()
            if kind != "name":
                raise FilterSyntaxError("expected an attribute's name")
            return Attribute(value)
        if (kind, value) == ("op", "("):
            inner = self.expression()
            self.take(")")
            return inner
        if kind in ("dots", "wild") or value in ("//", "$", "::", "/"):
            raise UnsupportedFeature(value)
        raise FilterSyntaxError(f"unexpected {value or 'end'!r}")

    def arguments(self) -> list:
        self.take("(")
        found = []
        while not self.sees(")"):
            if found:
                self.take(",")
            found.append(self.expression())
        self.take(")")
        return found


def parse(text: str) -> list[Path]:
    """The paths of a filter; FilterSyntaxError or UnsupportedFeature where it has none."""
    return _Parser(text).paths()
