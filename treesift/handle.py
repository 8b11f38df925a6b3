"""A handle: one output's options and open nodes over one DataFrame, from creation to its finished lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from treesift.operators.builder import Builder
from treesift.operators.render import render
from treesift.options import FLAGS, STYLES, Options
from treesift.sources.encoders import ENCODERS, write


class Handle:
    """Collects what rows show, then renders it; style and flags may change until then.

    Handles share nothing. After destroy() every call raises ValueError.
    """

    def __init__(self, df: DataFrame, table: str, options: str | Options = "", keys: Sequence[str] = (), top: str = "", strict: bool = False):
        self._df, self.table, self.keys, self.top, self.strict = df, table, tuple(keys), top, strict
        self._options = Options.parse(options) if isinstance(options, str) else options
        self._builder = Builder(strict)
        self._alive = True

    def _live(self) -> None:
        if not self._alive:
            raise ValueError("the handle was destroyed")

    @property
    def style(self) -> str:
        return self._options.style

    def set_style(self, name: str) -> Handle:
        self._live()
        if name not in STYLES and name not in ENCODERS:
            raise ValueError(f"no such style: {name!r}")
        self._options.style = name
        return self

    def set_options(self, text: str) -> Handle:
        """Adds the words of an option string to what is set."""
        self._live()
        more = Options.parse(text)
        if any(w.partition("=")[0] in STYLES or w[:1] in ("@", ":") for w in text.split(",")):
            self._options.style, self._options.encoder_options = more.style, more.encoder_options
        if "indent=" in text or text[:1] == ":":
            self._options.indent = more.indent
        self._options.flags |= more.flags
        self._options.filters += more.filters
        self._options.rename |= more.rename
        return self

    def set_flags(self, *names: str) -> Handle:
        self._live()
        if unknown := set(names) - set(FLAGS):
            raise ValueError(f"no such flags: {sorted(unknown)}")
        self._options.flags |= set(names)
        return self

    def clear_flags(self, *names: str) -> Handle:
        self._live()
        self._options.flags -= set(names)
        return self

    def is_set(self, name: str) -> bool:
        return name in self._options.flags

    @property
    def flags(self) -> frozenset[str]:
        return frozenset(self._options.flags)

    @property
    def depth(self) -> int:
        return self._builder.depth

    def step(self, event: str, name: str, value: Column | None = None) -> Handle:
        """Opens, closes or gives a value (see Builder.transition)."""
        self._live()
        self._builder.transition(event, name, value)
        return self

    def rows(self) -> DataFrame:
        """The DataFrame with the tree that was built; its own columns if none was."""
        self._live()
        columns = self._builder.columns()
        return self._df.select(*columns) if columns else self._df

    def lines(self, text: str = "", document: bool = False, **select_options) -> DataFrame:
        """The rows rendered as the options say, in a format if one is given."""
        return render(self.rows(), self._options, self.table, text, self.top, self.keys, document, **select_options)

    def finish(self, path: str, mode: str = "error", text: str = "", document: bool = False) -> None:
        """Writes the lines to files at path and ends the handle."""
        done = self.lines(text, document)
        if self.style in ENCODERS and done.columns != ["line"]:
            write(self.rows(), ":".join([self.style, *self._options.encoder_options]), self.table, path, self.keys, mode)
        else:
            done.write.mode(mode).text(path)
        self.destroy()

    def destroy(self) -> None:
        self._alive = False
