"""Filters, coercions, formats and encoders on small hand-made rows."""

import pytest

from treesift.functions.coerce import Value, text_number, xbool
from treesift.operators.formats import Format, emit, humanize, parse_format
from treesift.operators.select import select
from treesift.options import Options
from treesift.plans.ast import FilterSyntaxError, UnsupportedFeature
from treesift.plans.parser import parse
from treesift.sources.encoders import csv_records, fullpath_rows, read_name_map


def kept(spark, schema, rows, text, **options):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in select(df, text, "item", **options).orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("item[host = 'beta']", [2]),
        ("item[not(host = 'beta')]", [1, 3, 4]),
        ("item[price < 5]", [1, 4]),  # a missing price counts as 0
        ("item[number(price) == 2]", [1]),
        ("item[string-length(host) > 4]", [1, 3]),
        ("item[choose2(price, id) = 9]", [2]),
        ("item[price div 0 = 1]", []),
        ("item[0.5 and id > 0]", []),
        ("item[rematch('[[:digit:]]', price)]", [1, 2, 3]),
        ("item[rematch('([0-9]+)', price, 'm')]", [1, 2, 3]),
        ("item[host = 'alpha'] | item[id = 3]", [1, 3]),
        ("!item[id = 1]", [2, 3, 4]),
        ("/host", []),
    ],
)
def test_filters(spark, text, want):
    rows = [(1, "alpha", "2.0"), (2, "beta", "9"), (3, "gamma", "10"), (4, None, None)]
    assert kept(spark, "id int, host string, price string", rows, text) == want


def test_attributes_absent_never_match(spark):
    df = spark.createDataFrame([("eth0", "1"), (None, "2")], "_name string, ifindex string")
    assert [r.ifindex for r in select(df, "item[@name = 'eth0']", "item").collect()] == ["1"]
    assert [r.ifindex for r in select(df, "item[not(@name = 'x')]", "item").collect()] == ["1"]


def test_positions(spark):
    rows = [(1, "udp"), (2, "tcp4"), (3, "tcp4"), (4, "udp")]
    for text, want in (("item[2]", [2]), ("item[proto = 'tcp4'][2]", [3]), ("item[2][proto = 'tcp4']", [2]), ("item[9]", [])):
        assert kept(spark, "id int, proto string", rows, text, order_by=["id"]) == want
    with pytest.raises(UnsupportedFeature):
        kept(spark, "id int, proto string", rows, "item[2]")


def test_nested(spark):
    df = spark.createDataFrame([(1, [(1, "alpha"), (2, "beta")]), (2, [(3, "gamma")])], "id int, item array<struct<id:int,host:string>>")
    assert select(df, "*/item[host = 'beta']", "servers", keys=["id"]).collect() == [(1, [(2, "beta")])]
    assert select(df, "item[id > 1]/host", "servers", keys=["id"]).collect() == [(1, [(2, "beta")]), (2, [(3, "gamma")])]


@pytest.mark.parametrize("text", ["foo//goo", "item[a[b] = 1]", "item[a/b = 1]", "item[..//node()]", "item[$x]", "a::b", "item[a | b]"])
def test_unsupported(text):
    with pytest.raises(UnsupportedFeature):
        parse(text)


@pytest.mark.parametrize("text", ["", "item[", "item[a =]", "item]", "item[a b]", "item[(a]", "/"])
def test_syntax_errors(text):
    with pytest.raises(FilterSyntaxError):
        parse(text)


def test_numbers_in_text(spark):
    said = {"": 0, "010": 8, "0x1f": 31, "12": 12, "1.5": 1.5, "2gether": 0, "09": 9, "-7": -7, "1e3": 1000}
    df = spark.createDataFrame([(k,) for k in said], "s string")
    assert {r.s: r.n for r in df.select("s", text_number(df.s).alias("n")).collect()} == said
    truth = df.select("s", xbool(Value("str", df.s)).alias("b")).collect()
    assert {r.s for r in truth if r.b} == {"010", "0x1f", "12", "1.5", "09", "-7", "1e3"}


def test_formats(spark):
    df = spark.createDataFrame([("gum", 1412, None)], "name string, sold int, note string")
    line = lambda style, text, **o: emit(df, text, style, **o).first()[0]
    assert line("text", "{Lc:Name} {:name/%-5s}|{:sold/%6d}|{:note}") == "Name: gum  |  1412|(null)"
    assert line("json", "{:name}{:sold/%6u}{:note}", rename={"name": "title"}) == '{"title": "gum", "sold": 1412, "note": "(null)"}'
    assert line("xml", "{k:name}{:sold}{U:items}", units=True) == '<name key="key">gum</name><sold units="items">1412</sold>'
    assert line("sdparams", "{:name}{d:sold}") == 'name="gum" '
    assert line("text", "{{x}}{[:6}{:name}{]:}.") == "{x}   gum."
    with pytest.raises(ValueError, match="unclosed"):
        parse_format("{:x")
    assert Format("{:a-b}", underscores=True).name(parse_format("{:a-b}")[0]) == "a_b"


def test_humanize(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (44 * 2**20,), (1536,), (-2048,)], "n long")
    assert [r[0] for r in df.select(humanize(df.n)).collect()] == ["0", "1023", "1K", "44M", "2K", "-2K"]
    assert df.where("n = 1536").select(humanize(df.n, decimal=True)).first()[0] == "1.5K"


def test_encoders(spark):
    df = spark.createDataFrame([("a,b", 1), (' p"', 2)], "name string, n int")
    assert [r[0] for r in csv_records(df).collect()] == ['"a,b",1', '" p""",2']
    assert [r[0] for r in csv_records(df, ["n"], dos=True).collect()] == ["1\r", "2\r"]
    assert fullpath_rows(df, "item", ["n"]).first()[0] == "/item[n='1']/name='a,b'"
    assert read_name_map("﻿# c\na=b\n\nc = d # e\n") == {"a": "b", "c": "d"}


def test_options():
    made = Options.parse("json,pretty,filter=item[contains(a\\, 'x')],map=old=new,indent=4")
    assert (made.style, made.filters, made.rename, made.indent) == ("json", ["item[contains(a, 'x')]"], {"old": "new"}, 4)
    assert Options.parse("@csv:path=item:no-quotes").encoder_options == ["path=item", "no-quotes"]
    with pytest.raises(ValueError, match="unknown"):
        Options.parse("nonsense")


def test_pushdown(spark):
    df = select(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "lineitem[l_quantity > 45]", "lineitem").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_comment" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 590
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
