"""Trees, encoders by name, structured log messages, replay scripts, the command, and checks of formats."""

import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from treesift.functions import utf8
from treesift.operators.formats import Format, emit, emit_field, simplified
from treesift.operators.select import select
from treesift.operators.trees import attribute, container, leaf_list, nested_list, tree_json, tree_xml, versioned, xml_document
from treesift.options import Options
from treesift.plans.lint import lint
from treesift.sources.command import command
from treesift.sources.encoders import encode, register, write
from treesift.sources.replay import instances, read_replay
from treesift.sources.syslog import priority, syslog_messages


def lines(df):
    return [r[0] for r in df.collect()]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(
        [("one", 'a "quoted" <text>', {"n": 1}, [{"id": 1, "tag": "x"}, {"id": 2, "tag": None}], ["p", "q"]), ("two", None, None, [], None)],
        "name string, note string, box struct<n:int>, item array<struct<id:int,tag:string>>, words array<string>",
    )


def test_tree_json(tree):
    for pretty in (False, True):
        got = [json.loads(x) for x in lines(tree_json(tree, "top/data", pretty))]
        assert got[0] == {"top": {"data": {"name": "one", "note": 'a "quoted" <text>', "box": {"n": 1}, "item": [{"id": 1, "tag": "x"}, {"id": 2}], "words": ["p", "q"]}}}
        assert got[1] == {"top": {"data": {"name": "two", "item": []}}}
    assert lines(tree_json(tree.select("name", "box").limit(1), pretty=True)) == ['{\n  "name": "one",\n  "box": {\n    "n": 1\n  }\n}']


def test_tree_xml(spark, tree):
    got = lines(tree_xml(tree.select("name", "note", "item"), "row", "top", keys=["id"]))
    assert got[0] == '<top><row><name>one</name><note>a "quoted" &lt;text&gt;</note><item><id key="key">1</id><tag>x</tag></item><item><id key="key">2</id></item></row></top>'
    assert lines(tree_xml(tree.select("name").limit(1), "row", pretty=True)) == ["<row>\n  <name>one</name>\n</row>"]
    whole = xml_document(versioned(tree, "1.0"), "row", "top/data")
    parsed = xml.dom.minidom.parseString("".join(lines(whole)))
    assert [r.getAttribute("version") for r in parsed.getElementsByTagName("row")] == ["1.0", "1.0"]
    assert lines(tree_xml(tree.limit(0), "row")) == []


def test_constructors(spark):
    flat = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "g int, seq int, v string")
    built = nested_list(flat, "item", ["g"], ["seq", "v"], ["seq"]).orderBy("g")
    assert built.collect() == [(1, [(1, "a"), (2, "b")]), (2, [(1, "c")])]
    row = flat.where("g = 2").select(container("box", F.col("v"), attribute("g", F.col("g"))), leaf_list("all", F.col("seq"), F.lit(None), F.col("v")))
    assert lines(tree_xml(row, "row")) == ['<row><box g="2"><v>c</v></box><all>1</all><all>c</all></row>']


def test_encoders(spark, tree, tmp_path):
    assert lines(encode(tree, "@csv", "row")) == ["name,note", 'one,"a ""quoted"" <text>"', "two,"]
    assert lines(encode(tree, "csv:path=row/item:leafs=tag.id.none:no-header", "row")) == ["x,1,", ",2,"]
    assert lines(encode(tree, "csv+leaf=name+dos", "row")) == ["name\r", "one\r", "two\r"]
    assert lines(encode(tree.limit(1), "fullpath:slax", "row", ["name", "id"])) == [
        "/row[name=='one']/note='a \\\"quoted\\\" <text>'",
        "/row[name=='one']/box/n='1'",
        "/row[name=='one']/item[id=='1']/tag='x'",
        "/row[name=='one']/words='p'",
        "/row[name=='one']/words='q'",
    ]
    register("names", lambda df, table, keys, options: df.select(F.col("name").alias("line")))
    write(tree, "names", "row", str(tmp_path / "out"))
    assert sorted(lines(spark.read.text(str(tmp_path / "out")))) == ["one", "two"]
    for bad in ("none", "csv:nope", "csv:path=absent", "fullpath:nope"):
        with pytest.raises(ValueError):
            encode(tree, bad, "row")


def test_syslog(spark):
    df = spark.createDataFrame([("pump 4", 'p="7"]\n'), (None, "x")], "device string, reading string")
    at = F.lit("2031-11-02 05:06:07.089").cast("timestamp_ntz").cast("timestamp")
    got = lines(syslog_messages(df, "{:device} reports {:reading}\n", "state", priority("user", "warning"), at, "plant-a", "gauge", 9001))
    assert got[0] == '<12>1 2031-11-02T05:06:07.089+0000 plant-a gauge 9001 state [state@32473 device="pump 4" reading="p=\\"7\\"\\]\n"] ﻿pump 4 reports p="7"]\n'
    assert got[1].endswith('device="(null)" reading="x"] ﻿(null) reports x')
    assert " T3 [T3@77 " in lines(syslog_messages(df, "{:device}", "@T3@77", 14, F.lit(None).cast("timestamp")))[0]
    with pytest.raises(ValueError):
        syslog_messages(df, "{:device}", None, 999, F.current_timestamp())


def test_replay(spark):
    script = ["# two lists", "r", "?*/item[id = '2']", "+servers", "{item", "<item", "$ id 1", "= host alpha", ">item", "<item", "$ id 2", "@ mark on", "= host beta", ">item", "}item", "-servers", "q", "= never read"]
    (block,) = read_replay(script)
    assert (block.filters, block.keys) == (["*/item[id = '2']"], {"id"})
    rows = instances(spark, block, "servers/item")
    assert select(rows, "item[id = '2']", "item").select("host", "_mark").collect() == [("beta", "on")]
    assert select(instances(spark, block, "servers"), block.filters, "servers", keys=["id"]).select(F.col("item")[0]["host"]).collect() == [("beta",)]
    assert read_replay([]) == []
    for bad in (["-a"], ["x what"], ["+a", "}a"], ["i other"]):
        with pytest.raises(ValueError):
            read_replay(bad)


def test_command_applies_its_options(spark):
    shown = ["{:kind} {:load/%d}\\n", "barge", "40"]
    assert lines(command(spark, ["--options", "filter=data[load > 39]", *shown])) == ["barge 40\n"]
    assert lines(command(spark, ["--options", "filter=data[load > 40]", *shown])) == []
    assert lines(command(spark, ["--options", "@csv", *shown])) == ["kind,load", "barge,40"]
    assert lines(command(spark, ["--options", "@csv:no-header:leafs=load", *shown])) == ["40"]
    assert lines(command(spark, ["--xml", "--pretty", "--wrap", "top", *shown])) == ["<top>\n  <kind>barge</kind>\n  <load>40</load>\n</top>"]
    pretty = lines(command(spark, ["--options", "json,pretty,indent=1", "--top-wrap", "--wrap", "top", *shown]))[0]
    assert pretty == '{\n "top": {\n  "kind": "barge",\n  "load": 40\n }\n}'
    assert lines(command(spark, ["--options", "json,no-top,not-first", "--top-wrap", "--wrap", "top", *shown])) == [', "top": {"kind": "barge", "load": 40}']


def test_command(spark):
    text = "{k:kind} carries {:load/%d} crates.\\n"
    assert lines(command(spark, [text, "barge", "40"])) == ["barge carries 40 crates.\n"]
    assert lines(command(spark, ["--xml", text, "barge", "40"])) == ["<kind>barge</kind><load>40</load>"]
    assert json.loads(lines(command(spark, ["--json", "--top-wrap", "--wrap", "top/a", text, "barge", "40"]))[0]) == {"top": {"a": {"kind": "barge", "load": 40}}}
    assert lines(command(spark, ["--xml", "--open", "top/data"])) == ["<top><data>"]
    assert lines(command(spark, ["--xml", "--close", "top/data"])) == ["</data></top>"]


def test_format_modifiers(spark):
    df = spark.createDataFrame([(1, "日本", ["a", 'b"'], "a/b\x01"), (2, None, None, "é")], "n int, s string, l array<string>, c string")
    assert lines(emit(df, "{:n} {Np:byte,bytes}")) == ["1 byte", "2 bytes"]
    assert lines(emit(df, "{:s/%6s}|{:s/%-6s}|")) == ["  日本|日本  |", "(null)|(null)|"]
    assert lines(emit(df, "{l:l}", "json")) == ['{"l": ["a", "b\\""]}', '{"l": []}']
    assert lines(emit(df, "{l:l}", "xml")) == ['<l>a</l><l>b"</l>', ""]
    assert lines(emit(df, "{,escape-slash:c}", "json")) == ['{"c": "a\\/b\\u0001"}', '{"c": "é"}']
    assert lines(emit(df, "{:c}", "xml")) == ["<c>a/b </c>", "<c>é</c>"]
    assert lines(emit(df.limit(1), "{,escape-private:c}", "xml")) == ["<c>a/b\ue001</c>"]
    assert lines(emit(df.limit(1), "{a:/%d}", arguments=["n"])) == ["1"]
    assert lines(emit(df.limit(1), "{:on/}", "json")) == ['{"on": true}']
    assert lines(emit(df.limit(1), "{:color/green}", "json")) == ['{"color": "green"}']
    assert lines(emit(df, "{:at/%02d:%02d}", inputs={"at": ["n", "n"]})) == ["01:01", "02:02"]
    assert lines(emit(df, "{:at/%02d:%02d}", "json", inputs={"at": ["n", "n"]})) == ['{"at": "1:01"}', '{"at": "2:02"}']
    assert lines(emit(df, "{:s/%2.8.1s}")) == ["日", "(null)"]
    assert lines(emit(df.limit(1), "{C:bold,fg-red}{:n}{C:}")) == ["\x1b[1;31m1\x1b[0m"]
    assert lines(emit(df.limit(1), "{C:bold}{:n}", color=False)) == ["1"]
    assert lines(emit(df.limit(1), "{[:-4}{:n}{]:}|")) == ["1   |"]
    assert lines(emit_field(df.limit(1), "k", "n", "%03d", style="xml")) == ['<n key="key">1</n>']
    assert lines(emit(df.limit(1), "{:c}", "xml", attributes={"c": ["n"]})) == ['<c n="1">a/b </c>']
    assert lines(emit(df.limit(1), "{k:n}{:c}", "html", xpath="/data", keys=False, info={"c": ("string", "what")}))[0].count("data-xpath=\"/data[n='1']/c\" data-type=\"string\" data-help=\"what\"") == 1


def test_messages(spark):
    df = spark.createDataFrame([(3, "red")], "n int, color string")
    assert simplified("{G:}{Lwc:Count}{:n/%d} is {g:color}\n") == "{:Count}{:n} is {:color}\n"
    words = {"{:n} is {:color}": "{:color}: {:n}", "red": "rot"}
    assert lines(emit(df, "{G:}{:n/%03d} is {g:color}", catalog=words)) == ["rot: 003"]
    assert lines(emit(df, "{:n} {Ngp:byte,bytes}", catalog={"bytes": "octets"})) == ["3 octets"]
    assert lines(emit(df, "{G:}{:n}", catalog={})) == ["3"]


def test_lint():
    assert lint("{Lwc:Name}{:first-name/%-10s}\n") == []
    for bad in ("{:First_Name}", "{:}", "{:1st-name}", "{h:size}", "{,hn-space:size/%d}", "{C:red}", "{C:blink}", "{[:ten}{]:}", "{[:8}", "{]:}", "{:size/%d/%d%d}", "{L:Cost/%d}", "x %d", "{zz:name}", "{T:/%s/%s}", "{L:%6s}", "X{:name L{:}"):
        assert lint(bad), bad


def test_brief_options():
    o = Options.parse(":JPi4u")
    assert (o.style, o.indent, o.flags) == ("json", 4, {"pretty", "underscores"})
    for bad in (":Z", ":i"):
        with pytest.raises(ValueError):
            Options.parse(bad)


def test_utf8(spark):
    df = spark.createDataFrame([("aé日",), ("",), (None,)], "t string")
    for n, want in ((6, "aé日"), (5, "aé"), (3, "aé"), (2, "a"), (0, "")):
        assert lines(df.select(utf8.truncated(F.col("t"), n)))[0] == want
    raw = spark.createDataFrame([(b"a\xff",), (b"ok",), (None,)], "b binary")
    assert lines(raw.select(utf8.valid(F.col("b")))) == [False, True, None]
    assert lines(raw.select(utf8.made_valid(F.col("b")))) == ["a�", "ok", None]
    assert lines(df.select(utf8.compare_caseless(F.lit("ÄB"), F.lit("äb")))) == [0, 0, 0]
    assert lines(raw.select(utf8.joined(F.col("b"), F.lit("!")))) == ["a�!", "ok!", "!"]
