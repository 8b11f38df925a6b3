"""Encoders: CSV records, full-path rows, replay events and CBOR, by name or one by one; and name maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_field(c: Column, quotes: bool = True) -> Column:
    """A CSV field: quoted if it has a quote, comma or line break, or white space at an end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[\n\r",]|^\s|\s$'), quoted).otherwise(text) if quotes else text


def csv_records(df: DataFrame, leafs: Sequence[str] = (), quotes: bool = True, dos: bool = False) -> DataFrame:
    """(record): a line for each row, of the leafs in their order; `dos` ends it in a carriage return."""
    names = list(leafs) or df.columns
    line = F.concat_ws(",", *[csv_field(F.col(f"`{n}`"), quotes) for n in names])
    return df.select((F.concat(line, F.lit("\r")) if dos else line).alias("record"))


def csv_header(df: DataFrame, leafs: Sequence[str] = ()) -> str:
    return ",".join(list(leafs) or df.columns)


#: Control characters that a full path writes as a backslash and a letter, from `b` for 1 to `z` for 25.
_LETTERED = {chr(k): chr(ord("a") + k) for k in range(1, 26)}


def quoted_value(c: Column) -> Column:
    """A value between the quotes of a path: quotes and control characters behind a backslash."""
    text = c.cast("string")
    plain = F.replace(F.replace(text, F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))
    full = plain
    for raw, letter in _LETTERED.items():
        full = F.replace(full, F.lit(raw), F.lit("\\" + letter))
    return F.concat(F.lit("'"), F.when(text.rlike("[\\x01-\\x19]"), full).otherwise(plain), F.lit("'"))


def fullpath_rows(df: DataFrame, path: str, keys: Sequence[str], slax: bool = False) -> DataFrame:
    """(line): `/path[key='v']/leaf='x'` for every leaf that is no key; a missing key is left out, a missing leaf has no line."""
    test = "==" if slax else "="
    lead = F.concat(F.lit("/" + path), *[F.coalesce(F.concat(F.lit(f"[{k}{test}"), quoted_value(F.col(f"`{k}`")), F.lit("]")), F.lit("")) for k in keys])
    leaves = [F.concat(lead, F.lit(f"/{c}="), quoted_value(F.col(f"`{c}`"))) for c in df.columns if c not in keys]
    return df.select(F.explode(F.array(*leaves)).alias("line")).where("line is not null")


def replay_events(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """(seq, event): the open, key, leaf and close events of each row, in order."""
    marks = [F.lit(f"[ {table}")]
    marks += [F.concat(F.lit(f"{'$' if c in keys else '='} {c} "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in [*keys, *[c for c in df.columns if c not in keys]]]
    return df.select(F.posexplode(F.array(*marks, F.lit(f"] {table}"))).alias("seq", "event"))


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def _head(major: int, n: Column) -> Column:
    """The hexadecimal head of a CBOR item: its kind and a number, in as few bytes as it needs."""
    first = major << 5
    sizes = [(1 << 8, 24, 2), (1 << 16, 25, 4), (1 << 32, 26, 8)]
    made = F.when(n < 24, _hex(F.lit(first) + n, 2))
    for most, code, digits in sizes:
        made = made.when(n < most, F.concat(F.lit(f"{first | code:02X}"), _hex(n, digits)))
    return made.otherwise(F.concat(F.lit(f"{first | 27:02X}"), _hex(n, 16)))


def _double_bits(x: Column) -> Column:
    """A double's 64 bits in hexadecimal, by arithmetic that powers of two keep exact."""
    a = F.abs(x)
    rough = F.floor(F.log2(F.when((a > 0) & (a < float("inf")), a).otherwise(1.0))).cast("int")
    power = F.greatest(rough - F.when(a < F.pow(F.lit(2.0), rough), 1).otherwise(0) + F.when((rough < 1023) & (a >= F.pow(F.lit(2.0), rough + 1)), 1).otherwise(0), F.lit(-1023))
    normal = F.shiftleft((power + 1023).cast("bigint"), 52) + ((a * F.pow(F.lit(2.0), -power) - 1) * 2.0**52).try_cast("bigint")
    tiny = (a * 2.0**537 * 2.0**537).try_cast("bigint")
    bits = F.when(a == 0, F.lit(0).cast("bigint")).when(power < -1022, tiny).otherwise(normal)
    signed = F.when(F.startswith(x.cast("string"), F.lit("-")), bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)
    special = F.when(F.isnan(x), "7FF8000000000000").when(x == float("inf"), "7FF0000000000000").when(x == float("-inf"), "FFF0000000000000")
    return F.coalesce(special, _hex(signed, 16))


def _cbor_text(c: Column) -> Column:
    return F.concat(_head(3, F.octet_length(c).cast("bigint")), F.hex(c))


def cbor_hex(c: Column, dtype: T.DataType) -> Column:
    """A value as CBOR in hexadecimal; maps and arrays have indefinite length, null is CBOR's own."""
    if isinstance(dtype, T.BooleanType):
        made = F.when(c, "F5").otherwise("F4")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = c.cast("bigint")
        made = F.when(n >= 0, _head(0, n)).otherwise(_head(1, F.bitwise_not(n)))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        made = F.concat(F.lit("FB"), _double_bits(c.cast("double")))
    elif isinstance(dtype, T.StructType):
        made = F.concat(F.lit("BF"), *[F.concat(_cbor_text(F.lit(f.name)), cbor_hex(c[f.name], f.dataType)) for f in dtype.fields], F.lit("FF"))
    elif isinstance(dtype, T.ArrayType):
        made = F.concat(F.lit("9F"), F.array_join(F.transform(c, lambda x: cbor_hex(x, dtype.elementType)), ""), F.lit("FF"))
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(_cbor_text(e["key"].cast("string")), cbor_hex(e["value"], dtype.valueType)))
        made = F.concat(F.lit("BF"), F.array_join(pairs, ""), F.lit("FF"))
    elif isinstance(dtype, T.BinaryType):
        made = F.concat(_head(2, F.octet_length(c).cast("bigint")), F.hex(c))
    else:
        made = _cbor_text(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), made), F.lit("F6"))


def cbor_records(df: DataFrame) -> DataFrame:
    """(record): each row as a CBOR map; texts that are no other kind's, such as dates, are text."""
    whole = F.struct(*[F.col(f"`{n}`") for n in df.columns])
    return df.select(F.unhex(cbor_hex(whole, df.schema)).alias("record"))


def read_name_map(text: str) -> dict[str, str]:
    """`old=new` lines; `#` starts a comment, a byte-order mark is passed over."""
    found = {}
    for line in text.removeprefix("﻿").splitlines():
        old, equals, new = line.partition("#")[0].partition("=")
        if equals and old.strip():
            found[old.strip()] = new.strip()
    return found


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def rows_at(df: DataFrame, path: str, table: str) -> DataFrame:
    """The instances of nested lists or containers that a relative path ends at, as rows; the table's own rows if the path names it."""
    steps = [p for p in path.split("/") if p]
    if not steps or steps[-1] == table:
        return df

    def routes(dtype: T.StructType, above: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in dtype.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                yield (*above, f.name)
                yield from routes(inner, (*above, f.name))

    found = [r for r in routes(df.schema, ()) if (table, *r)[-len(steps) :] == tuple(steps)]
    if not found:
        raise ValueError(f"no nested rows at {path!r}")
    for name in found[0]:
        dtype = df.schema[name].dataType
        df = df.select(F.explode(f"`{name}`").alias("x") if isinstance(dtype, T.ArrayType) else F.col(f"`{name}`").alias("x")).where("x is not null").select("x.*")
    return df


def leading_leaves(df: DataFrame) -> list[str]:
    """Columns before the first nested one: a nested node ends a record. Attributes are no leaves."""
    names = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            break
        if not f.name.startswith("_"):
            names.append(f.name)
    return names


def csv_encoded(df: DataFrame, table: str, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    """(line): a header, then a record for each row.

    Options: `path=a/b`, `leafs=x.y` (also `leaf=`, `leaves=`), `no-header`, `dos`, `no-quotes`, `debug`, `no-keys` and
    `value-only`, of which the last three change nothing; ValueError for another. The header is a partition of its own,
    before all others, so a written table has it once.
    """
    words = dict(o.partition("=")[::2] for o in options)
    if unknown := set(words) - {"path", "leaf", "leafs", "leaves", "no-header", "dos", "no-quotes", "debug", "no-keys", "value-only"}:
        raise ValueError(f"unknown options of csv: {sorted(unknown)}")
    rows = rows_at(df, words.get("path", ""), table)
    asked = next((words[w] for w in ("leafs", "leaf", "leaves") if w in words), "")
    names = [n for n in asked.split(".") if n] or leading_leaves(rows)
    missing = [n for n in names if n not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(n) for n in missing])
    end = "\r" if "dos" in words else ""
    lines = csv_records(rows, names, "no-quotes" not in words, "dos" in words).withColumnRenamed("record", "line")
    if "no-header" in words:
        return lines
    head = df.sparkSession.range(1, numPartitions=1).select(F.lit(csv_header(rows, names) + end).alias("line"))
    return head.unionByName(lines)


def fullpath_encoded(df: DataFrame, table: str, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    """(line): a full-path line for each leaf of each row, nested ones included; option `slax` tests keys with `==`, `flush` changes nothing."""
    if unknown := set(options) - {"slax", "flush"}:
        raise ValueError(f"unknown options of fullpath: {sorted(unknown)}")
    test = "==" if "slax" in options else "="

    def leaves(lead: Column, dtype: T.StructType, get: Callable[[str], Column]) -> Column:
        """An array of the lines below a node."""
        for k in keys:
            if k in dtype.names and not isinstance(dtype[k].dataType, (T.StructType, T.ArrayType)):
                lead = F.concat(lead, F.coalesce(F.concat(F.lit(f"[{k}{test}"), quoted_value(get(k)), F.lit("]")), F.lit("")))
        parts = [F.array().cast("array<string>")]
        for f in dtype.fields:
            if f.name.startswith("_") or f.name in keys:
                continue
            c, here = get(f.name), F.concat(lead, F.lit(f"/{f.name}"))
            if isinstance(f.dataType, T.StructType):
                parts.append(F.when(c.isNotNull(), leaves(here, f.dataType, c.getField)))
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                inner = f.dataType.elementType
                parts.append(F.flatten(F.transform(F.array_compact(c), below(here, inner))))
            elif isinstance(f.dataType, T.ArrayType):
                parts.append(F.transform(c, bare(here)))
            else:
                parts.append(F.array(F.concat(here, F.lit("="), quoted_value(c))))
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])

    def below(lead: Column, dtype: T.StructType) -> Callable[[Column], Column]:
        return lambda x: leaves(lead, dtype, x.getField)

    def bare(lead: Column) -> Callable[[Column], Column]:
        return lambda x: F.concat(lead, F.lit("="), quoted_value(x))

    lines = leaves(F.lit(f"/{table}"), df.schema, lambda n: F.col(f"`{n}`"))
    return df.select(F.explode(F.array_compact(lines)).alias("line"))


def _events_encoded(df: DataFrame, table: str, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    return replay_events(df, table, keys).select(F.col("event").alias("line"))


def _cbor_encoded(df: DataFrame, table: str, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    return cbor_records(df)


Encoder = Callable[[DataFrame, str, Sequence[str], Sequence[str]], DataFrame]
#: Encoders by name; each takes (rows, table name, key columns, option words) and gives one column.
ENCODERS: dict[str, Encoder] = {"csv": csv_encoded, "fullpath": fullpath_encoded, "fdr": _events_encoded, "cbor": _cbor_encoded}


def register(name: str, encoder: Encoder) -> None:
    """Adds an encoder, or puts it in another's place."""
    ENCODERS[name] = encoder


def encode(df: DataFrame, spec: str, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows by the encoder that spec names, with its options, as in `csv:path=item:no-header`; `+` separates as well."""
    name, *options = spec.removeprefix("@").replace("+", ":").split(":")
    if name not in ENCODERS:
        raise ValueError(f"no such encoder: {name!r}")
    return ENCODERS[name](df, table, keys, [o for o in options if o])


def write(df: DataFrame, spec: str, table: str, path: str, keys: Sequence[str] = (), mode: str = "error") -> None:
    """The encoded rows at path through Spark's own committer: lines as text files, binary records as Parquet."""
    done = encode(df, spec, table, keys)
    writer = done.write.mode(mode)
    if isinstance(done.schema[0].dataType, T.BinaryType):
        writer.parquet(path)
    else:
        writer.text(path)
