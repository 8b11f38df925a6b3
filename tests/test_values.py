"""Values that Spark's own casts would fail on, bytewise functions, number formats, positions, CBOR and full paths."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from treesift.functions.coerce import Value, text_number, whole, xbool
from treesift.operators.formats import Format, emit, humanize, printf
from treesift.operators.select import select
from treesift.plans.ast import UnsupportedFeature
from treesift.sources.encoders import cbor_records, encode, fullpath_rows

MOST = 2**63 - 1
TEXTS = {"": 0, "7": 7, " 8": 8, "-9": -9, "+3": 3, "010": 8, "-010": -8, "089": 89, "0": 0, "00": 0, "0x1F": 31, "0X1f": 31, "-0x10": -16, "0xffffffffffffffff": 2**64 - 1, "0x" + "f" * 30: 2**64 - 1, "0X" + "f" * 30: MOST, "0" + "7" * 40: MOST, "9" * 40: MOST, "-" + "9" * 40: -(2**63), "1e3": 1000, ".5": 0.5, "1e30": 1e30, "1e999": math.inf, "-inf": -math.inf, "Infinity": math.inf, "2gether": 0, "2.0.4.5": 0, "0x": 0, "0xg": 0, "1 ": 0, "\n4": 4, "--1": 0, "é": 0, "０": 0}


def lines(df):
    return [r[0] for r in df.collect()]


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_text_numbers(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert {r.t: r.n for r in df.select("t", text_number(F.col("t")).alias("n")).collect()} == {t: float(n) for t, n in TEXTS.items()}
    got = {r.t: (r.b, r.i) for r in df.select("t", xbool(Value("str", F.col("t"))).alias("b"), whole(Value("str", F.col("t"))).alias("i")).collect()}
    assert got == {t: (abs(n) >= 1, max(-(2**63), min(MOST, int(n) if math.isfinite(n) else int(math.copysign(2**70, n))))) for t, n in TEXTS.items()}


ODD = ["1e30", "-1e30", "0x" + "f" * 20, "9" * 30, "junk", "", None, "1e999", "0.5"]


@pytest.mark.parametrize("text", ["x", "x mod 2", "x mod 0", "x > 1", "-x", "substring('abcdef', x)", "substring('abcdef', x, x)", "round(x)", "floor(x) = ceiling(x)", "number(x) + 1", "boolean(x)", "x div x", "sum(x, x)", "rematch('[', x)", "rematch('(a)', x, 'm7')", "rematch('[[:nope:]]', x)", "rematch(x, 'abc')", "rematch(x, 'abc', 's') = ''", "translate(x, x, 'é')", "string(x) = concat(x, '')", "x _ x", "i", "-i < 0", "i mod 7", "substring('abc', i, i)", "f", "f mod 3", "-f", "round(f)", "substring('abc', f)", "x = i", "i > f", "x < f"])
def test_no_value_ends_a_query(spark, text):
    rows = [(x, i, f) for x, i, f in zip(ODD, [MOST, -(2**63), 0, 1, None, 5, 6, 7, 8], [1e300, -1e300, float("nan"), float("inf"), -0.0, None, 0.5, 2.0, 3.0], strict=True)]
    df = spark.createDataFrame(rows, "x string, i long, f double")
    select(df, f"item[{text}]", "item").collect()


def test_no_value_ends_a_format(spark):
    rows = [(x, i, f) for x, i, f in zip(ODD, [MOST, -(2**63), 0, 1, None, 5, 6, 7, 8], [1e300, -1e300, float("nan"), float("inf"), -0.0, None, 0.5, 2.0, 3.0], strict=True)]
    df = spark.createDataFrame(rows, "x string, i long, f double")
    forms = ("%d", "%5.3d", "%x", "%o", "%c", "%5.1f", "%e", "%g", "%s", "%-9d|", "%u")
    text = "".join("{:" + column + "/" + form + "}" for form in forms for column in ("x", "i", "f"))
    assert len(lines(emit(df, text))) == len(rows)
    assert len(lines(df.select(humanize(F.col("i"))))) == len(rows)


def test_bytes_and_patterns(spark):
    df = spark.createDataFrame([(1, "é1", "a.c", "é"), (2, "日本", "(", "x"), (3, "abc", "[[:digit:]]", "")], "id int, s string, p string, t string")

    def kept(text):
        return sorted(r.id for r in select(df, f"item[{text}]", "item").collect())

    assert kept("substring(s, 3, 1) = '1'") == [1]  # é has two bytes
    assert kept("substring(s, 4) = '本'") == [2]
    assert kept("string-length(substring(s, 2, 1)) = 1") == [1, 2, 3]
    assert kept("translate(s, 'é', 'e') = 'e1'") == [1]  # one byte of é becomes e, the other goes
    assert kept("translate(s, t, '') = '1'") == [1]
    assert kept("translate(s, 'ab', t) = 'xc'") == []
    assert kept("rematch(p, 'abc')") == [1]
    assert kept("rematch(p, 'a1c', 's') = '1'") == [3]
    assert kept("rematch('(.)\\\\1', 'xyy', 's') = 'yy'") == [1, 2, 3]
    assert kept("rematch('^b', s)") == [] and kept("rematch('B', s, 'i')") == [3]


def test_printf_is_c_printf(spark):
    whole_forms = ("%d", "%5d|", "%-5d|", "%05d", "%+d", "% d", "%.3d", "%8.3d|", "%-8.3d|", "%x", "%08x", "%06d", "%+5d", "%-6d|", "%i", "%X")
    fractions = ("%f", "%.2f", "%8.3f|", "%-8.1f|", "%08.2f", "%+.1f", "%e", "%.2E", "%12.3e", "%g", "%.3g", "%G", "%#g", "%.0f", "%.10g")
    for forms, values, dtype in ((whole_forms, [0, 7, 42, 12345678], "long"), (("%d", "%06d", "%+5d", "%.4d", "%-6d|", "%9.4d"), [-42, -1], "long"), (fractions, [0.0, 0.75, -1.3, 3.14159, 100.0, 123456.0, 1234567.0, 0.00001234, 1e20, -2.5e-7, 99999.7], "double")):
        df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
        rows = df.select("v", *[printf(f, F.col("v"), True).alias(f"c{k}") for k, f in enumerate(forms)]).collect()
        assert {(f, r.v): r[f"c{k}"] for r in rows for k, f in enumerate(forms)} == {(f, v): f % v for v in values for f in forms}
    octal = spark.createDataFrame([(0,), (31,)], "v long")
    assert [tuple(r) for r in octal.select(*[printf(f, F.col("v"), True) for f in ("%#x", "%#o", "%#X", "%o")]).collect()] == [("0", "0", "0", "0"), ("0x1f", "037", "0X1F", "37")]


def test_printf_extras(spark):
    df = spark.createDataFrame([(6, "ab", 42, 2)], "w int, s string, n int, p int")
    given = {"x": ["w", "s"], "y": ["w", "n"], "z": ["w", "p", "n"]}
    assert lines(emit(df, "{:x/%*s}|{:x/%-*s}|{:y/%0*d}|{:z/%*.*d}|", inputs=given)) == ["    ab|ab    |000042|    42|"]
    assert lines(emit(df, "{:e/%m}: {:s}", error="no such node")) == ["no such node: ab"]
    assert lines(emit(df, "{:n/%c}{:s/%c}{:s/%d}{:s/%%}")) == ["*a0%"]
    own = Format("{:n/%d}{:s}", formatter=lambda d, c, how: F.upper(c) if d.content == "s" else None)
    assert lines(df.select(own.render(df, "text"), )) == ["42AB"] and lines(df.select(own.render(df, "json"))) == ['{"n": 42, "s": "AB"}']


@pytest.fixture
def nested(spark):
    tree = "struct<item: array<struct<id: string, host: string, port: array<struct<n: int>>>>, tag: array<string>>"
    row = (1, ([("a", "x", [(1,), (2,)]), ("b", "y", [(3,), (4,)]), ("c", "x", [(5,)])], ["p", "q", "r"]))
    return spark.createDataFrame([row], f"key int, servers {tree}")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("servers/item[2]", "[b]"),
        ("servers/item[2]/port", "[b:3,4]"),
        ("servers/item[host = 'x'][2]/port[1]", "[c:5]"),
        ("servers/item[2]/port[2]", "[b:4]"),
        ("servers/item/port[1]", "[a:1 b:3 c:5]"),
        ("servers[1]/item[id = 'c']", "[c]"),
        ("servers[2]/item", None),
        ("servers/item[1] | servers/item[3]", "[a c]"),
        ("servers/item[1] | servers/item[host = 'y']", "[a b]"),
        ("servers/item[1]/port[2] | servers/item[2]/port[1]", "[a:2 b:3]"),
        ("!servers/item[2]", "[a c]"),
        ("servers/item[2.5]", None),
        ("servers/item[9]", None),
        ("servers/tag[2]", "(q)"),
        ("servers/tag[. != 'q'][2]", "(r)"),
        ("!servers/tag[1]", "[a b c](q,r)"),
    ],
)
def test_nested_positions(nested, text, want):
    rows = select(nested, text, "top", keys=["id"]).collect()
    if want is None:
        assert rows == []
        return
    s = rows[0].servers.asDict(recursive=True)
    deep = "/port" in text
    shown = "" if "item" not in s else "[" + " ".join(i["id"] + (":" + ",".join(str(p["n"]) for p in i["port"]) if deep else "") for i in s["item"]) + "]"
    shown += f"({','.join(s['tag'])})" if "tag" in s and not (want.startswith("[") and want.endswith("]")) else ""
    assert shown == want


def test_row_positions(spark):
    df = spark.range(1, 9).selectExpr("int(id) as n", "int(id % 2) as odd")

    def kept(text, **more):
        return sorted(r.n for r in select(df, text, "item", order_by=["n"], **more).collect())

    assert kept("item[2] | item[n > 6]") == [2, 7, 8]
    assert kept("item[2] | item[odd = 0][1] | item[8]") == [2, 8]
    assert kept("item[8] | item[n > 6]") == [7, 8]
    assert kept("!item[3]") == [1, 2, 4, 5, 6, 7, 8]
    assert kept("item[2]", within=["odd"]) == [3, 4]
    assert kept("!item[2]", within=["odd"]) == [1, 2, 5, 6, 7, 8]
    with pytest.raises(UnsupportedFeature):
        select(df, "item[1]", "item")


def test_row_predicates_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus", F.array(F.struct("o_custkey")).alias("line"))
    got = select(orders, 'orders[o_orderstatus = "O"]/line[o_custkey > 5]', "orders", keys=["o_orderkey"])
    assert "EqualTo(o_orderstatus,O)" in got._jdf.queryExecution().executedPlan().toString()


def brute_cbor(x):
    def head(major, n):
        for limit, code, form in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
            if n < limit:
                return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + struct.pack(form, n)

    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, dict):
        return b"\xbf" + b"".join(brute_cbor(str(k)) + brute_cbor(v) for k, v in x.items()) + b"\xff"
    if isinstance(x, list):
        return b"\x9f" + b"".join(map(brute_cbor, x)) + b"\xff"
    raw = bytes(x) if isinstance(x, (bytes, bytearray)) else x.encode()
    return head(2 if isinstance(x, (bytes, bytearray)) else 3, len(raw)) + raw


def test_cbor(spark):
    numbers = [0, 23, 24, 255, 256, 65535, 65536, 2**32 - 1, 2**32, MOST, -1, -24, -25, -256, -257, -(2**63)]
    doubles = [0.0, -0.0, 1.0, 0.5, -2.25, 3.14159, 1e300, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, math.inf, -math.inf, math.nan, 2.0**1023, 1 / 3]
    rows = [(n, d, f"text {k}" * k, bytes(range(k)), n > 0, [n, None], {"k": d}, ("é" * k, None)) for k, (n, d) in enumerate(zip(numbers, doubles, strict=True))] + [(None,) * 8]
    df = spark.createDataFrame(rows, "n long, d double, s string, b binary, t boolean, l array<long>, m map<string,double>, c struct<x: string, y: int>")
    want = sorted(brute_cbor(r.asDict(recursive=True)) for r in df.collect())
    assert sorted(bytes(r[0]) for r in cbor_records(df).collect()) == want


def test_full_paths_are_escaped(spark):
    df = one(spark, id="a'b", v="it's \"x\"\n\tend")
    assert lines(fullpath_rows(df, "row", ["id"])) == ["/row[id='a\\'b']/v='it\\'s \\\"x\\\"\\k\\jend'"]
    assert lines(encode(df, "fullpath", "row", ["id"])) == lines(fullpath_rows(df, "row", ["id"]))
    missing = spark.createDataFrame([(None, "x"), ("k", None)], "id string, v string")
    assert sorted(lines(fullpath_rows(missing, "row", ["id"]))) == ["/row/v='x'"]
