"""Field descriptors `{modifiers:content/format/encoding-format}` and their rendering as Column expressions.

Styles: text, json, xml, html and sdparams; each gives one string column. Unmarked text is literal, `{{`...`}}` a literal
brace pair. A field's column is the one its content names; `inputs` names several for a format with several conversions.
Widths count terminal columns: combining marks take none, wide East Asian characters two.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions.coerce import Value, whole, xnum

#: Role letters and names.
ROLES = {"C": "color", "D": "decoration", "E": "error", "G": "gettext", "L": "label", "N": "note", "P": "padding", "T": "title", "U": "units", "V": "value", "W": "warning", "[": "start-anchor", "]": "stop-anchor"}
#: Modifier letters and names.
MODIFIERS = {"a": "argument", "c": "colon", "d": "display", "e": "encoding", "g": "gettext-field", "h": "humanize", "k": "key", "l": "leaf-list", "n": "no-quotes", "p": "plural", "q": "quotes", "t": "trim", "w": "white"}
#: Effects and colours as terminal codes.
EFFECTS = {"reset": 0, "normal": 0, "bold": 1, "underline": 4, "inverse": 7, "no-bold": 22, "no-underline": 24, "no-inverse": 27}
COLORS = {"black": 0, "red": 1, "green": 2, "yellow": 3, "blue": 4, "magenta": 5, "cyan": 6, "white": 7, "default": 9}
#: Modifiers without a letter.
LONG_MODIFIERS = frozenset(["comma", "hn-space", "hn-decimal", "hn-1000", "escape-slash", "escape-square", "escape-private"])


def effect_code(name: str) -> int | None:
    """The terminal code of an effect or of a colour with fg- or bg-."""
    ground, _, color = name.partition("-")
    if ground in ("fg", "bg") and color in COLORS:
        return (30 if ground == "fg" else 40) + COLORS[color]
    return EFFECTS.get(name)


@dataclass(frozen=True)
class Descriptor:
    role: str
    content: str
    modifiers: frozenset = field(default_factory=frozenset)
    form: str = ""
    encoding: str = ""
    #: A slash with nothing after it: the encoded value is true.
    empty: bool = False


def parse_format(text: str) -> list[Descriptor]:
    """The descriptors of a format string; ValueError for an unclosed brace or an unknown role or modifier."""
    found: list[Descriptor] = []
    plain, at = "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            found.append(Descriptor("text", plain))
            plain = ""

    while at < len(text):
        if text.startswith("{{", at):
            end = text.find("}}", at)
            if end < 0:
                raise ValueError("unclosed literal brace")
            plain += "{" + text[at + 2 : end] + "}"
            at = end + 2
        elif text[at] == "{":
            flush()
            end = text.find("}", at)
            if end < 0:
                raise ValueError("unclosed field")
            found.append(_descriptor(text[at + 1 : end]))
            at = end + 1
        else:
            plain += text[at]
            at += 1
    flush()
    return found


def _descriptor(body: str) -> Descriptor:
    head, colon, rest = body.partition(":")
    if not colon:
        raise ValueError(f"field without a colon: {body!r}")
    role, modifiers = "value", set()
    letters, *names = head.split(",")
    for c in letters:
        if c in ROLES:
            role = ROLES[c]
        elif c in MODIFIERS:
            modifiers.add(MODIFIERS[c])
        else:
            raise ValueError(f"unknown role or modifier {c!r}")
    for name in names:
        if name in ROLES.values():
            role = name
        elif name in MODIFIERS.values() or name in LONG_MODIFIERS:
            modifiers.add(name)
        elif name:
            raise ValueError(f"unknown role or modifier {name!r}")
    content, slash, forms = rest.partition("/")
    form, _, encoding = forms.partition("/")
    return Descriptor(role, content, frozenset(modifiers), form, encoding, bool(slash) and not forms)


def simplified(text: str) -> str:
    """The format as message catalogues hold it: fields without modifiers, formats and the text of other roles' marks."""
    parts = []
    for d in parse_format(text):
        if d.role == "text":
            parts.append(d.content.replace("{", "{{").replace("}", "}}"))
        elif d.role != "gettext":
            parts.append("{:" + d.content + "}")
    return "".join(parts)


_CONVERSION = re.compile(r"%([-+ #0]*)((?:\*|\d*)(?:\.(?:\*|\d*))*)(?:hh|h|ll|l|j|t|z|q)?([diouxXDUeEfFgGcCsSpm%])")
#: Conversions that take no value: a percent sign, and the text of the last error.
_FREE = "%m"
_WIDE = "[\\u1100-\\u115F\\u2E80-\\u303E\\u3041-\\u33FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uA000-\\uA4CF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFE30-\\uFE6F\\uFF00-\\uFF60\\uFFE0-\\uFFE6\\x{1F300}-\\x{1F64F}\\x{20000}-\\x{3FFFD}]"
_NO_WIDTH = "[\\p{Mn}\\p{Me}\\u200B-\\u200F]|\\x1B\\[[0-9;]*m"


def columns_wide(c: Column) -> Column:
    """How many terminal columns a text takes; colour codes take none."""
    return F.char_length(F.regexp_replace(F.regexp_replace(c, _NO_WIDTH, ""), _WIDE, "xx"))


def padded(c: Column, width: int | Column, left: bool) -> Column:
    """The text filled with spaces to a number of terminal columns; `left`, or a negative width of a column, puts the text first."""
    wide = F.lit(abs(width)) if isinstance(width, int) else F.abs(width)
    space = F.repeat(F.lit(" "), F.greatest(wide - columns_wide(c), F.lit(0)))
    first, last = F.concat(c, space), F.concat(space, c)
    if isinstance(width, int):
        return first if left or width < 0 else last
    return first if left else F.when(width < 0, first).otherwise(last)


def _filled(prefix: Column, body: Column, width: int | Column | None, flags: str, zeros: bool) -> Column:
    """A number's sign and digits at a width: with flag 0 and `zeros`, filled between them, else with spaces."""
    text = F.concat(prefix, body)
    if width is None:
        return text
    spaced = padded(text, width, "-" in flags)
    if "0" not in flags or "-" in flags or not zeros:
        return spaced
    wide = F.lit(width) if isinstance(width, int) else width
    full = F.concat(prefix, F.repeat(F.lit("0"), F.greatest(wide - F.char_length(text), F.lit(0))), body)
    return full if isinstance(width, int) else F.when(width < 0, spaced).otherwise(full)


def _typed(value: Column, numeric: bool) -> Value:
    return Value("float" if numeric else "str", value)


def _integer(value: Column, numeric: bool, letter: str, flags: str, width: int | Column | None, precision: int | Column | None) -> Column:
    """A whole number; texts count as the number they stand for, and what passes 64 bits as the nearest."""
    n = F.when(value.isNotNull(), F.coalesce(value.try_cast("bigint"), whole(_typed(value, numeric))) if numeric else whole(_typed(value, numeric)))
    if letter in "xXo":
        digits = F.conv(n.cast("string"), 10, 8) if letter == "o" else F.hex(n) if letter == "X" else F.lower(F.hex(n))
        prefix = F.when(n != 0, {"x": "0x", "X": "0X", "o": "0"}[letter]).otherwise("") if "#" in flags else F.lit("")
    else:
        digits = F.ltrim(n.cast("string"), F.lit("-"))
        prefix = F.when(n < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
    if precision is not None:
        least = F.lit(precision) if isinstance(precision, int) else precision
        digits = F.concat(F.repeat(F.lit("0"), F.greatest(least - F.char_length(digits), F.lit(0))), digits)
    return _filled(prefix, digits, width, flags, precision is None)


def _fraction(value: Column, numeric: bool, letter: str, flags: str, width: int | Column | None, precision: int | Column | None) -> Column:
    """A double in fixed (f), scientific (e) or the shorter of both forms (g)."""
    x = value.cast("double") if numeric else F.when(value.isNotNull(), xnum(_typed(value, numeric)))
    prefix = F.when(x < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
    size, kind = F.abs(x), letter.lower()
    places = F.lit(6 if precision is None else precision) if not isinstance(precision, Column) else F.when(precision < 0, 6).otherwise(precision)

    def shown(n: Column, how: str) -> Column:
        return F.call_function("format_string", F.concat(F.lit("%."), n.cast("string"), F.lit(how)), size)

    if kind == "g":
        places = F.greatest(places, F.lit(1))
        science = shown(places - 1, "e")
        power = F.regexp_extract(science, "e([-+][0-9]+)$", 1).try_cast("int")
        text = F.when((power < -4) | (power >= places), science).otherwise(shown(F.greatest(places - 1 - power, F.lit(0)), "f"))
        if "#" in flags:
            text = F.when(F.contains(text, F.lit(".")), text).otherwise(F.regexp_replace(text, r"($|e)", ".$1"))
        else:
            text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    else:
        text = shown(places, kind)
    text = F.when(F.isnan(size), "nan").when(size == float("inf"), "inf").otherwise(text)
    return _filled(prefix, F.upper(text) if letter in "EG" else text, width, flags, True)


def printf(form: str, c: Column, numeric: bool, *more: Column, error: str = "") -> Column:
    """Values in a printf format: length letters go, a number that meets `%s` is text; of the numbers in `%8.20.6s` the last two bound the text.

    A `*` in place of a width or precision takes a value of its own, a negative width puts the text first. `%m` is `error`.
    A text that meets a number's conversion counts as the number it stands for; no value raises an error. Fractions are
    rounded from their shortest decimal form, halves away from zero.
    """
    values, parts, at = iter((c, *more)), [], 0
    for m in _CONVERSION.finditer(form):
        flags, widths, letter = m.groups()
        parts.append(F.lit(form[at : m.start()]))
        at = m.end()
        if letter == "%":
            parts.append(F.lit("%"))
            continue
        given = [whole(Value("str", next(values, F.lit(0)).cast("string")), 10_000, -10_000).cast("int") if t == "*" else int(t) if t else None for t in widths.split(".")]
        width, bounds = given[0], [b for b in given[1:] if b is not None]
        value = F.lit(error) if letter == "m" else next(values, F.lit(None))
        letter = {"i": "d", "u": "d", "U": "d", "D": "d", "O": "o", "F": "f", "S": "s", "C": "c", "p": "x", "m": "s"}.get(letter, letter)
        if letter in "sc":
            text = value.cast("string")
            if letter == "c":
                text = F.char(value.try_cast("bigint")) if numeric else F.left(text, F.lit(1))
            for b in bounds:
                text = F.left(text, F.lit(b)) if isinstance(b, int) else F.when(b < 0, text).otherwise(F.left(text, b))
            parts.append(text if width is None else padded(text, width, "-" in flags))
        elif letter in "dxXo":
            parts.append(_integer(value, numeric, letter, flags, width, bounds[0] if bounds else None))
        else:
            parts.append(_fraction(value, numeric, letter, flags, width, bounds[0] if bounds else None))
    parts.append(F.lit(form[at:]))
    return F.concat(*parts)


def humanize(c: Column, base: int = 1024, space: bool = False, decimal: bool = False) -> Column:
    """44M style: the value over the largest power of base that it reaches, rounded by its last remainder; with `decimal`, one digit below ten."""
    suffixes = ["", "K" if base == 1024 else "k", "M", "G", "T", "P", "E"]
    gap = " " if space else ""
    n, out = F.greatest(F.coalesce(c.try_cast("bigint"), whole(Value("str", c.cast("string")))), F.lit(1 - 2**63)), None
    for k in range(len(suffixes) - 1, -1, -1):
        unit = base**k
        if k == 0:
            shown = F.concat(n.cast("string"), F.lit(gap))
        else:
            full = (F.abs(n) - F.abs(n) % unit) / unit
            part = F.floor((F.abs(n) % unit) / (base ** (k - 1)))
            rounded = (full + (part >= base // 2).cast("int")).cast("bigint")
            text = rounded.cast("string")
            if decimal:
                tenth = F.floor((part * 10 + base // 2) / base)
                small = (full < 9) | ((full == 9) & (part < (973 if base == 1024 else 950)))
                text = F.when(small, F.concat((full.cast("bigint") + (tenth >= 10).cast("int")).cast("string"), F.lit("."), (tenth % 10).cast("string"))).otherwise(text)
            shown = F.concat(F.when(n < 0, "-").otherwise(""), text, F.lit(gap + suffixes[k]))
        out = F.when(F.abs(n) >= (unit if k else 0), shown) if out is None else out.when(F.abs(n) >= (unit if k else 0), shown)
    return out


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def escape_xml(c: Column, quote: bool = False, control: str = " ") -> Column:
    """Text of an element, or of an attribute with `quote`; a control character becomes `control`, or with "private" U+E000 and up."""
    if control == "private":
        codes = [k for k in range(32) if k not in (9, 10, 13)]
        c = F.translate(c, "".join(map(chr, codes)), "".join(chr(0xE000 + k) for k in codes))
    else:
        c = F.regexp_replace(c, _CONTROL, control)
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;")) if quote else c


def escape_json(c: Column, slash: bool = False) -> Column:
    """Text between the quotes of a JSON string; `slash` escapes `/` as well. Texts without such characters are left as they are."""
    named = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    rest = [(chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in "\n\r\t\b\f"]
    done, full = c, c
    for a, b in [*named, *([("/", "\\/")] if slash else [])]:
        done = F.replace(done, F.lit(a), F.lit(b))
    full = done
    for a, b in rest:
        full = F.replace(full, F.lit(a), F.lit(b))
    return F.when(c.rlike("[\\x00-\\x07\\x0B\\x0E-\\x1F]"), full).otherwise(done)


def escape_sd(c: Column) -> Column:
    for a in ("\\", '"', "]"):
        c = F.replace(c, F.lit(a), F.lit("\\" + a))
    return c


class Format:
    """A parsed format bound to a DataFrame's columns.

    rename maps field names for encoded styles; `arguments` are the contents of fields with modifier `a`, in turn; `inputs`
    gives a field's columns where its format takes several; `catalog` holds translations: of whole formats in their
    simplified form (role G), and of values and texts (modifier g); attributes are columns shown as a field's attributes
    in XML; xpath is the path of the rows for HTML, keys marks key fields in XML, info is (type, help) by field for HTML;
    error is the text of `%m`; pretty gives JSON and XML a line for each field, indented by so many spaces for each level, `depth`
    being that of the rows; formatter(field, column, "display" or "encoding") gives a field's text in place of its
    format, or None to leave it.
    """

    def __init__(
        self,
        text: str,
        rename: Mapping[str, str] | None = None,
        underscores: bool = False,
        units: bool = False,
        keys: bool = True,
        xpath: str | None = None,
        arguments: Sequence[str] = (),
        inputs: Mapping[str, Sequence[str]] | None = None,
        catalog: Mapping[str, str] | None = None,
        attributes: Mapping[str, Sequence[str]] | None = None,
        info: Mapping[str, tuple[str, str]] | None = None,
        color: bool = True,
        no_humanize: bool = False,
        error: str = "",
        pretty: int | None = None,
        depth: int = 0,
        formatter: Callable[[Descriptor, Column, str], Column | None] | None = None,
    ):
        self.catalog = dict(catalog or {})
        self.fields = self._translated(self._argued(parse_format(text), iter(arguments)), text)
        self.rename, self.underscores, self.units, self.keys, self.xpath = dict(rename or {}), underscores, units, keys, xpath
        self.inputs, self.attributes, self.info = dict(inputs or {}), dict(attributes or {}), dict(info or {})
        self.color, self.no_humanize, self.error, self.formatter = color, no_humanize, error, formatter
        self.pretty, self.depth = pretty, depth

    @staticmethod
    def _argued(fields: list[Descriptor], arguments: Iterator[str]) -> list[Descriptor]:
        try:
            return [replace(d, content=next(arguments)) if "argument" in d.modifiers else d for d in fields]
        except StopIteration:
            raise ValueError("a field with modifier a lacks its argument") from None

    def _translated(self, fields: list[Descriptor], text: str) -> list[Descriptor]:
        """Fields in the order of the catalogue's format, where a field of role G asks for it and the catalogue has one."""
        at = next((k for k, d in enumerate(fields) if d.role == "gettext"), None)
        found = None if at is None else self.catalog.get(simplified(text))
        if found is None:
            return fields
        own = {d.content: d for d in fields[at + 1 :] if d.role != "text"}
        return [*fields[:at], *[own.get(d.content, d) if d.role != "text" else d for d in parse_format(found)]]

    def name(self, d: Descriptor) -> str:
        shown = self.rename.get(d.content, d.content)
        return shown.replace("-", "_") if self.underscores else shown

    def render(self, df: DataFrame, style: str) -> Column:
        return {"text": self._text, "json": self._json, "xml": self._xml, "html": self._html, "sdparams": self._sd}[style](df)

    def _values(self) -> list[Descriptor]:
        return [d for d in self.fields if d.role == "value" and "display" not in d.modifiers]

    def _type(self, df: DataFrame, d: Descriptor) -> str:
        name = self.inputs.get(d.content, [d.content])[0]
        return df.schema[name].dataType.simpleString() if name in df.columns else "string"

    def _message(self, c: Column) -> Column:
        """Texts that the catalogue knows, translated."""
        if not self.catalog:
            return c
        known = F.create_map(*[F.lit(x) for pair in self.catalog.items() for x in pair])
        return F.coalesce(F.try_element_at(known, c), c)

    def _shown(self, df: DataFrame, d: Descriptor, encoded: bool, element: Column | None = None) -> Column:
        form = d.encoding or (re.sub(r"^%\d+", "%", d.form) if encoded else d.form)
        if encoded and d.empty:
            return F.lit("true")
        if form and not [m for m in _CONVERSION.finditer(form) if m[3] not in _FREE] and d.content not in self.inputs:
            return printf(form, F.lit(None), False, error=self.error)
        c, *more = [element] if element is not None else [F.col(f"`{n}`") for n in self.inputs.get(d.content, [d.content])]
        numeric = self._type(df, d) != "string"
        own = self.formatter(d, c, "encoding" if encoded else "display") if self.formatter else None
        if own is not None:
            text = own
        elif "humanize" in d.modifiers and not encoded and not self.no_humanize:
            text = humanize(c, 1000 if "hn-1000" in d.modifiers else 1024, "hn-space" in d.modifiers, "hn-decimal" in d.modifiers)
        else:
            text = printf(form, c, numeric, *more, error=self.error) if form else c.cast("string")
        text = self._message(text) if "gettext-field" in d.modifiers and not encoded else text
        text = F.trim(text) if encoded and "trim" in d.modifiers else text
        return F.coalesce(text, F.lit("null" if not numeric and encoded and "no-quotes" in d.modifiers else "(null)"))

    def _plural(self, d: Descriptor, before: list[Column]) -> Column:
        """The content's first word if the last number before it is 1 (0 without a number), else the second."""
        one, _, many = d.content.partition(",")
        digits = F.regexp_extract(F.concat(F.lit(""), *before), "([0-9]+)[^0-9]*$", 1)
        words = [self.catalog.get(w, w) if "gettext-field" in d.modifiers else w for w in (one, many or one)]
        return F.when(digits.rlike("^0*1$"), F.lit(words[0])).otherwise(F.lit(words[1]))

    def _text(self, df: DataFrame) -> Column:
        parts: list[Column] = []
        anchors: list[tuple[int, int]] = []
        for d in self.fields:
            if "encoding" in d.modifiers or d.role == "gettext":
                continue
            if d.role == "value":
                c = self._shown(df, d, False) if "leaf-list" not in d.modifiers or not self._type(df, d).startswith("array") else F.array_join(F.col(f"`{d.content}`").cast("array<string>"), " ")
            elif d.role == "start-anchor":
                anchors.append((len(parts), int(d.content or d.form or 0)))
                continue
            elif d.role == "stop-anchor":
                if not anchors:
                    raise ValueError("an anchor is closed that was not opened")
                at, width = anchors.pop()
                inside = F.concat(*parts[at:]) if parts[at:] else F.lit("")
                parts[at:] = [padded(inside, abs(width), width < 0)]
                continue
            elif d.role == "color":
                c = F.lit(self._escape(d.content))
            elif "plural" in d.modifiers:
                c = self._plural(d, parts)
            elif d.role == "title" and d.form:
                c = printf(d.form, F.lit(d.content), False)
            else:
                c = F.lit(self.catalog.get(d.content, d.content) if "gettext-field" in d.modifiers else d.content)
            if "white" in d.modifiers and d.role in ("note", "units"):
                c = F.concat(F.lit(" "), c)
            if "colon" in d.modifiers:
                c = F.concat(c, F.lit(":"))
            if "white" in d.modifiers and d.role not in ("note", "units"):
                c = F.concat(c, F.lit(" "))
            parts.append(c)
        return F.concat(F.lit(""), *parts)

    def _escape(self, content: str) -> str:
        if not self.color:
            return ""
        codes = [effect_code(e.strip()) for e in content.split(",")] if content.strip() else [0]
        codes = [str(k) for k in codes if k is not None]
        return f"\x1b[{';'.join(codes)}m" if codes else ""

    def _bare(self, df: DataFrame, d: Descriptor) -> bool:
        """Whether JSON shows the value without quotes: one numeric conversion or a number's own type, unless modifiers say otherwise."""
        m = _CONVERSION.fullmatch(d.encoding or d.form or "")
        kind = re.sub(r"^array<(.*)>$", r"\1", self._type(df, d))
        native = not (d.form or d.encoding) and kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal") and not d.form
        return "quotes" not in d.modifiers and ("no-quotes" in d.modifiers or d.empty or native or bool(m and m[3] in "diouDOUeEfFgG" and "#" not in m[1]))

    def _json_value(self, df: DataFrame, d: Descriptor, element: Column | None) -> Column:
        text = self._shown(df, d, True, element)
        return text if self._bare(df, d) else F.concat(F.lit('"'), escape_json(text, "escape-slash" in d.modifiers), F.lit('"'))

    def _items(self, df: DataFrame, d: Descriptor) -> Callable[[Column], Column]:
        return lambda x: self._json_value(df, d, x)

    def _json(self, df: DataFrame) -> Column:
        parts = []
        for name, same in itertools.groupby(self._values(), key=lambda d: (self.name(d), "leaf-list" in d.modifiers)):
            ds = list(same)
            if not name[1]:
                parts += [F.concat(F.lit(f'"{name[0]}": '), self._json_value(df, d, None)) for d in ds]
                continue
            items = [F.array_join(F.transform(F.col(f"`{d.content}`"), self._items(df, d)), ", ") if self._type(df, d).startswith("array") else self._json_value(df, d, None) for d in ds]
            parts.append(F.concat(F.lit(f'"{name[0]}": ['), F.concat_ws(", ", *[F.nullif(i, F.lit("")) for i in items]), F.lit("]")))
        inside, end = self._break(1), self._break(0)
        return F.concat(F.lit("{" + inside), F.concat_ws("," + inside if inside else ", ", *parts), F.lit(end + "}"))

    def _break(self, more: int) -> str:
        """The line break before a node so many levels below the rows; none unless pretty."""
        return "" if self.pretty is None else "\n" + " " * (self.pretty * (self.depth + more))

    def _units_of(self, d: Descriptor) -> str:
        after = self.fields[self.fields.index(d) + 1 :]
        own = itertools.takewhile(lambda x: x.role != "value", after)
        return next((x.content for x in own if x.role == "units"), "") if self.units else ""

    def _xml(self, df: DataFrame) -> Column:
        parts = []
        for d in self._values():
            units = self._units_of(d)
            head = [F.lit(f"{self._break(0)}<{self.name(d)}")]
            for a in self.attributes.get(d.content, ()):
                head.append(F.coalesce(F.concat(F.lit(f' {a.removeprefix("_")}="'), escape_xml(F.col(f"`{a}`").cast("string"), True), F.lit('"')), F.lit("")))
            head.append(F.lit((' key="key"' if self.keys and "key" in d.modifiers else "") + (f' units="{units}"' if units else "") + ">"))
            control = "private" if "escape-private" in d.modifiers else "[]" if "escape-square" in d.modifiers else " "
            tail = F.lit(f"</{self.name(d)}>")
            if "leaf-list" in d.modifiers and self._type(df, d).startswith("array"):
                parts.append(F.coalesce(F.array_join(F.transform(F.col(f"`{d.content}`"), self._element(df, d, head, control, tail)), ""), F.lit("")))
            else:
                parts.append(self._element(df, d, head, control, tail)(None))
        return F.concat(F.lit(""), *parts)

    def _element(self, df: DataFrame, d: Descriptor, head: list[Column], control: str, tail: Column) -> Callable[[Column | None], Column]:
        return lambda x: F.concat(*head, escape_xml(self._shown(df, d, True, x), control=control), tail)

    def _html(self, df: DataFrame) -> Column:
        parts: list[Column] = [F.lit('<div class="line">')]
        keys = [d for d in self.fields if d.role == "value" and "key" in d.modifiers]
        classes: list[str] = []
        for d in self.fields:
            if d.role == "value" and "encoding" not in d.modifiers:
                parts.append(F.lit(f'<div class="{" ".join(["data", *classes])}" data-tag="{self.name(d)}"'))
                if self.xpath is not None:
                    where = [F.lit(f' data-xpath="{self.xpath}')]
                    for k in keys if "key" not in d.modifiers else []:
                        where += [F.lit(f"[{self.name(k)}='"), escape_xml(self._shown(df, k, True), True), F.lit("']")]
                    parts += [*where, F.lit(f'/{self.name(d)}"')]
                if d.content in self.info:
                    kind, helped = self.info[d.content]
                    parts.append(F.lit((f' data-type="{kind}"' if kind else "") + (f' data-help="{helped}"' if helped else "")))
                if self.keys and "key" in d.modifiers:
                    parts.append(F.lit(' data-key="key"'))
                parts += [F.lit(">"), escape_xml(self._shown(df, d, False)), F.lit("</div>")]
            elif d.role == "color":
                named = [e.strip() for e in d.content.split(",") if effect_code(e.strip()) is not None]
                gone = {n.removeprefix("no-") for n in named if n.startswith("no-")}
                fresh = [("color-" if n[:3] in ("fg-", "bg-") else "effect-") + n for n in named if not n.startswith("no-") and n not in ("reset", "normal")]
                reset = not d.content.strip() or "reset" in named or "normal" in named
                classes = fresh if reset else [c for c in classes if c.removeprefix("effect-") not in gone] + fresh
            elif d.role not in ("value", "gettext", "start-anchor", "stop-anchor"):
                text = self._plural(d, parts) if "plural" in d.modifiers else F.lit(self.catalog.get(d.content, d.content) if "gettext-field" in d.modifiers else d.content)
                if "white" in d.modifiers and d.role in ("note", "units"):
                    parts.append(F.lit('<div class="padding"> </div>'))
                if d.content or "colon" in d.modifiers:
                    parts += [F.lit(f'<div class="{d.role}">'), escape_xml(F.concat(text, F.lit(":" if "colon" in d.modifiers else ""))), F.lit("</div>")]
                if "white" in d.modifiers and d.role not in ("note", "units"):
                    parts.append(F.lit('<div class="padding"> </div>'))
        return F.concat(*parts, F.lit("</div>"))

    def _sd(self, df: DataFrame) -> Column:
        return F.concat(F.lit(""), *[F.concat(F.lit(f'{self.name(d)}="'), escape_sd(self._shown(df, d, True)), F.lit('" ')) for d in self._values()])


def emit_field(df: DataFrame, marks: str, content: str, form: str = "", encoding: str = "", style: str = "text", **options) -> DataFrame:
    """One field, from its role and modifiers, content and formats, without a format string around it."""
    body = f"{marks}:{content}" + (f"/{form}" if form or encoding else "") + (f"/{encoding}" if encoding else "")
    return emit(df, "{" + body + "}", style, **options)


def emit(df: DataFrame, text: str, style: str = "text", **options) -> DataFrame:
    """One string column, `line`, for every row."""
    return df.select(Format(text, **options).render(df, style).alias("line"))
