"""Trees built node by node: opens and closes that are checked, or completed, as they come.

A Builder holds the open nodes. Opening one in a place where it can't be closes what is in the way: an instance needs its
list, which is opened for it; a list or leaf-list takes nothing but its own. Closing a node closes what is still open inside.
Instances of a list have the members of all, those that one lacks as null. A marker is a fence: nothing outside it is closed until it is closed itself. With `strict`, whatever would need such a
repair raises StructureError instead. What comes out is a Column, so a tree is one expression over a DataFrame's row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAINER, LIST, INSTANCE, LEAF_LIST, MARKER = "container", "list", "instance", "leaf-list", "marker"


class StructureError(ValueError):
    """Opens and closes that don't nest."""


@dataclass
class _Node:
    kind: str
    name: str
    #: Members of containers and instances, in order of their first value; elements of lists and leaf-lists.
    members: dict = field(default_factory=dict)
    elements: list = field(default_factory=list)


class Builder:
    def __init__(self, strict: bool = False, remember: bool = True):
        """`remember`: a close without a name closes the innermost node of its kind."""
        self.strict, self.remember = strict, remember
        self.stack: list[_Node] = [_Node(CONTAINER, "")]

    @property
    def depth(self) -> int:
        """Nodes that are open, markers aside."""
        return sum(n.kind != MARKER for n in self.stack) - 1

    def _here(self) -> _Node:
        """The innermost node that isn't a marker."""
        return next(n for n in reversed(self.stack) if n.kind != MARKER)

    def _repair(self, why: str) -> None:
        if self.strict:
            raise StructureError(why)

    def _leave_lists(self, kind: str, name: str) -> None:
        """Close the list or leaf-list around, which can't hold this node."""
        while self._here().kind in (LIST, LEAF_LIST):
            if self.stack[-1].kind == MARKER:
                raise StructureError(f"{kind} {name!r} would close a list outside its marker")
            self._repair(f"{kind} {name!r} inside {self.stack[-1].kind} {self.stack[-1].name!r}")
            self._pop()

    def _pop(self) -> None:
        node = self.stack.pop()
        if node.kind == MARKER:
            return
        if node.kind == INSTANCE:
            self._here().elements.append(node.members)
            return
        if node.kind == LIST:
            names = list(dict.fromkeys(n for m in node.elements for n in m))
            value = F.array(*[F.struct(*[m.get(n, F.lit(None)).alias(n) for n in names]) for m in node.elements]) if names else None
        elif node.kind == LEAF_LIST:
            value = F.array(*node.elements) if node.elements else None
        else:
            value = F.struct(*[v.alias(n) for n, v in node.members.items()]) if node.members else None
        if value is not None:  # an empty node has no type to give it
            self._here().members[node.name] = value

    def open_container(self, name: str) -> Builder:
        self._leave_lists(CONTAINER, name)
        self.stack.append(_Node(CONTAINER, name))
        return self

    def open_list(self, name: str) -> Builder:
        self._leave_lists(LIST, name)
        self.stack.append(_Node(LIST, name))
        return self

    def open_instance(self, name: str) -> Builder:
        here = self._here()
        if here.kind != LIST or here.name != name:
            if here.kind == INSTANCE and here.name == name and self.stack[-1].kind != MARKER:
                self._repair(f"instance {name!r} inside another")
                self._pop()
            else:
                self._repair(f"instance {name!r} without its list")
                self.open_list(name)
        self.stack.append(_Node(INSTANCE, name))
        return self

    def open_leaf_list(self, name: str) -> Builder:
        self._leave_lists(LEAF_LIST, name)
        self.stack.append(_Node(LEAF_LIST, name))
        return self

    def open_marker(self, name: str) -> Builder:
        self.stack.append(_Node(MARKER, name))
        return self

    def _close(self, kind: str, name: str | None) -> Builder:
        if name is None and not self.remember:
            raise StructureError(f"a {kind} is closed without its name")
        for at in range(len(self.stack) - 1, 0, -1):
            node = self.stack[at]
            if node.kind == kind and name in (None, node.name):
                if at != len(self.stack) - 1:
                    self._repair(f"{self.stack[-1].kind} {self.stack[-1].name!r} is still open inside {kind} {node.name!r}")
                while len(self.stack) > at:
                    self._pop()
                return self
            if node.kind == MARKER and kind != MARKER:
                break
        raise StructureError(f"no open {kind} {name!r} to close" if name else f"no open {kind} to close")

    def close_container(self, name: str | None = None) -> Builder:
        return self._close(CONTAINER, name)

    def close_list(self, name: str | None = None) -> Builder:
        return self._close(LIST, name)

    def close_instance(self, name: str | None = None) -> Builder:
        return self._close(INSTANCE, name)

    def close_leaf_list(self, name: str | None = None) -> Builder:
        return self._close(LEAF_LIST, name)

    def close_marker(self, name: str) -> Builder:
        """Close all that was opened since, then the marker."""
        return self._close(MARKER, name)

    def close_all(self) -> Builder:
        """Close every open node, markers as well."""
        while len(self.stack) > 1:
            self._pop()
        return self

    def leaf(self, name: str, value: Column) -> Builder:
        """A value in the innermost node; in a leaf-list an element, whose name is the list's."""
        here = self._here()
        if here.kind == LEAF_LIST and here.name == name:
            here.elements.append(value)
            return self
        self._leave_lists("leaf", name)
        self._here().members[name] = value
        return self

    def attribute(self, name: str, value: Column) -> Builder:
        """An attribute of the innermost container or instance."""
        return self.leaf(f"_{name}", value.cast("string"))

    def transition(self, event: str, name: str, value: Column | None = None) -> Builder:
        """One step by the marks of replay scripts: + - { } < > [ ] open and close, = $ @ give a value."""
        opens = {"+": self.open_container, "{": self.open_list, "<": self.open_instance, "[": self.open_leaf_list}
        closes = {"-": self.close_container, "}": self.close_list, ">": self.close_instance, "]": self.close_leaf_list}
        if event in opens:
            return opens[event](name)
        if event in closes:
            return closes[event](name or None)
        if event in ("=", "$") and value is not None:
            return self.leaf(name, value)
        if event == "@" and value is not None:
            return self.attribute(name, value)
        raise StructureError(f"no such step: {event!r}")

    def columns(self) -> list[Column]:
        """The members of the outermost node, for a select; all that is open is closed (with `strict`: must be)."""
        if len(self.stack) > 1:
            self._repair(f"{self.stack[-1].kind} {self.stack[-1].name!r} is open at the end")
            self.close_all()
        return [v.alias(n) for n, v in self.stack[0].members.items()]
