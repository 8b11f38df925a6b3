"""Option words, as in `json,pretty,filter=item[a > 1],map=old=new`; a comma inside a value is written `\\,`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

STYLES = ("text", "json", "xml", "html", "sdparams", "csv", "cbor", "fullpath")
FLAGS = ("pretty", "underscores", "keys", "units", "xpath", "info", "no-humanize", "no-top", "not-first", "color", "utf8", "no-locale", "flush", "flush-line", "warn", "dtrt")
#: Brief letters, as in `:JP`, and the words they stand for; `i` takes a number.
LETTERS = {"c": "color", "f": "flush", "F": "flush-line", "H": "html", "I": "info", "J": "json", "k": "keys", "n": "no-humanize", "P": "pretty", "T": "text", "U": "units", "u": "underscores", "W": "warn", "X": "xml", "x": "xpath"}


def _brief(letters: str) -> list[str]:
    """The words of brief letters."""
    words = []
    for letter, number in re.findall(r"(.)(\d*)", letters):
        if letter == "i" and number:
            words.append(f"indent={number}")
        elif letter in LETTERS and not number:
            words.append(LETTERS[letter])
        else:
            raise ValueError(f"unknown option letter {letter + number!r}")
    return words


@dataclass
class Options:
    style: str = "text"
    flags: set[str] = field(default_factory=set)
    filters: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    encoder_options: list[str] = field(default_factory=list)
    indent: int = 2

    @classmethod
    def parse(cls, text: str) -> Options:
        """ValueError for a word that is no option."""
        made = cls()
        if text.startswith(":"):
            text = ",".join(_brief(text[1:]))
        for word in (w.replace("\\,", ",") for w in re.split(r"(?<!\\),", text) if w):
            name, _, value = word.partition("=")
            if word.startswith("@"):
                made.style, *made.encoder_options = re.split(r"[:+]", word[1:])
            elif name in STYLES:
                made.style = name
            elif name == "filter":
                made.filters.append(value)
            elif name == "map":
                old, _, new = value.partition("=")
                made.rename[old] = new
            elif name == "indent":
                made.indent = int(value)
            elif name in FLAGS:
                made.flags.add(name)
            else:
                raise ValueError(f"unknown option {word!r}")
        return made
