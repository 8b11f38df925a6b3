"""Whole option strings, documents, trees built node by node, handles, positions on streams, and types of formats."""

import json

import pytest
from pyspark.sql import functions as F

from treesift.handle import Handle
from treesift.operators.builder import Builder, StructureError
from treesift.operators.render import render
from treesift.operators.trees import json_document
from treesift.plans.ast import UnsupportedFeature
from treesift.plans.lint import check_types
from treesift.streaming.filter import nth_of_stream


def lines(df):
    return [r[0] for r in df.collect()]


@pytest.fixture
def boats(spark):
    return spark.createDataFrame([(1, "tug", 30.5), (2, "bar\"ge", 400.0), (3, "ferry", None)], "id int, kind string, in_load double").repartitionByRange(2, "id").sortWithinPartitions("id")


def test_render_options(boats):
    assert lines(render(boats, "json,filter=boat[in_load > 100],map=kind=sort", "boat")) == ['{"id":2,"sort":"bar\\"ge","in_load":400.0}']
    assert lines(render(boats, "@csv:no-header:leafs=sort.id,map=kind=sort,filter=boat[id = 1]", "boat")) == ["tug,1"]
    assert lines(render(boats, "xml,keys,filter=boat[id = 3]", "boat", keys=["id"], top="top")) == ['<top><boat><id key="key">3</id><kind>ferry</kind></boat></top>']
    assert lines(render(boats, "xml,filter=boat[id = 3],map=id=no", "boat", "{:id/%d}", keys=["id"])) == ["<no>3</no>"]
    assert lines(render(boats, "filter=boat[2]", "boat", "{:kind}", order_by=["id"])) == ['bar"ge']
    told = boats.select(F.col("id").alias("id", metadata={"type": "number", "help": "what it is"}))
    assert 'data-xpath="/top/boat/id" data-type="number" data-help="what it is"' in lines(render(told, "html,info,xpath", "boat", "{:id}", top="top"))[0]
    with pytest.raises(ValueError, match="needs a format"):
        render(boats, "html", "boat")


def test_json_documents(boats):
    for options in ("json", "json,pretty", "json,pretty,indent=4"):
        assert json.loads("\n".join(lines(render(boats, options, "boat", top="top/data", document=True)))) == {"top": {"data": {"boat": [{"id": 1, "kind": "tug", "in_load": 30.5}, {"id": 2, "kind": 'bar"ge', "in_load": 400.0}, {"id": 3, "kind": "ferry"}]}}}
    assert json.loads("".join(lines(json_document(boats.where("false"), "boat", "top")))) == {"top": {"boat": []}}
    assert json.loads("".join(lines(json_document(boats.where("id > 2"), "boat", "top")))) == {"top": {"boat": [{"id": 3, "kind": "ferry"}]}}
    piece = "".join(lines(json_document(boats, "boat", "data", no_top=True, not_first=True)))
    assert piece.startswith(', "data":{"boat":[') and json.loads("{" + piece[2:] + "}")["data"]["boat"][1]["id"] == 2


def tree(spark, builder):
    return json.loads(lines(spark.range(1).select(F.to_json(F.struct(*builder.columns()))))[0])


def test_builder(spark):
    b = Builder(strict=True)
    b.open_container("top").leaf("n", F.lit(1)).open_list("item")
    for k in range(2):
        b.open_instance("item").leaf("k", F.lit(k)).attribute("mark", F.lit("x")).close_instance("item")
    b.close_list("item").open_leaf_list("tag").leaf("tag", F.lit("a")).leaf("tag", F.lit("b")).close_leaf_list("tag").close_container("top")
    assert b.depth == 0
    assert tree(spark, b) == {"top": {"n": 1, "item": [{"k": 0, "_mark": "x"}, {"k": 1, "_mark": "x"}], "tag": ["a", "b"]}}


def test_builder_repairs(spark):
    b = Builder()
    b.open_container("top").open_instance("item").leaf("k", F.lit(0)).open_instance("item").leaf("k", F.lit(1))
    assert b.depth == 3
    b.open_list("inner").open_instance("inner").leaf("x", F.lit(5)).close_instance().leaf("after", F.lit(6)).close_container("top").leaf("last", F.lit(7))
    assert tree(spark, b) == {"top": {"item": [{"k": 0}, {"k": 1, "inner": [{"x": 5}], "after": 6}]}, "last": 7}


def test_builder_markers(spark):
    b = Builder().open_container("top").open_marker("m").open_container("in").leaf("x", F.lit(1))
    with pytest.raises(StructureError):
        b.close_container("top")
    b.close_marker("m").close_container("top")
    assert tree(spark, b) == {"top": {"in": {"x": 1}}}
    for bad in (lambda: Builder().close_list("x"), lambda: Builder(remember=False).open_container("a").close_container(), lambda: Builder(strict=True).open_instance("i"), lambda: Builder(strict=True).open_container("a").columns(), lambda: Builder().transition("~", "a"), lambda: Builder(strict=True).open_container("a").open_container("b").close_container("a"), lambda: Builder().close_marker("m"), lambda: Builder().open_list("l").open_marker("m").open_container("c")):
        with pytest.raises(StructureError):
            bad()


def test_handle(spark, boats, tmp_path):
    h = Handle(boats, "boat", "json", keys=["id"])
    for event, name, value in (("<", "hold", None), ("$", "id", F.col("id")), (">", "hold", None), ("+", "about", None), ("=", "kind", F.col("kind")), ("-", "", None)):
        h.step(event, name, value)
    assert h.depth == 0 and h.set_flags("keys").is_set("keys") and not h.clear_flags("keys").flags
    assert json.loads(lines(h.lines())[0]) == {"hold": [{"id": 1}], "about": {"kind": "tug"}}
    h = Handle(boats, "boat").set_options("xml,filter=boat[id = 1]").set_style("json")
    assert h.style == "json" and json.loads(lines(h.lines())[0])["kind"] == "tug"
    h.finish(str(tmp_path / "out"))
    assert len(lines(spark.read.text(str(tmp_path / "out")))) == 1
    for bad in (lambda: h.lines(), lambda: Handle(boats, "b").set_style("nope"), lambda: Handle(boats, "b").set_flags("nope")):
        with pytest.raises(ValueError):
            bad()


def test_positions_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "g string, n int, ok int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        nth_of_stream(stream, "item[ok = 1][3][n > 0]", "item", ["g"], ["n"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    parts = [[("a", 1, 1), ("a", 2, 0), ("b", 1, 1)], [("a", 4, 1), ("a", 3, 1), ("b", 2, 1), ("c", -1, 1)], [("b", 9, 1), ("a", 9, 1), ("c", -2, 1), ("c", -3, 1)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted((r.g, r.n) for r in spark.read.schema(schema).parquet(out).collect()) == [("a", 4), ("b", 9)]
    for bad in ("item[2][3]", "item[ok = 1]", "!item[1]", "item[1] | item[2]"):
        with pytest.raises(UnsupportedFeature):
            nth_of_stream(stream, bad, "item", ["g"])


def test_types_of_formats(boats):
    assert check_types("{:id/%d} {:kind/%-8s} {:in_load/%5.1f} {:in_load}", boats.schema) == []
    for bad in ("{:kind/%d}", "{:id/%s}", "{:id/%f}", "{:nope}", "{:nope/%d}", "{:id/%d:%d}", "{:id/%*d}", "{:in_load/%x}"):
        assert len(check_types(bad, boats.schema)) == 1, bad
    assert check_types("{:at/%d:%s}", boats.schema, {"at": ["id", "kind"]}) == []
