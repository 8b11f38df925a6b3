"""One query for each operator of the language, each over a whole table, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions import utf8
from treesift.handle import Handle
from treesift.operators.builder import Builder
from treesift.operators.formats import emit, emit_field, humanize
from treesift.operators.render import render
from treesift.operators.select import select
from treesift.operators.trees import attribute, container, leaf_list, nested_list, tree_json, tree_xml, versioned, xml_document
from treesift.plans.lint import check_types, lint
from treesift.sources.command import command
from treesift.sources.encoders import cbor_records, csv_records, encode, fullpath_rows, read_name_map, register, renamed, replay_events
from treesift.sources.replay import instances, read_replay
from treesift.sources.syslog import priority, syslog_messages
from treesift.streaming.filter import filter_stream, nth_of_stream, run_available
from treesift.streaming.sink import Writer, deliver, write_stream

Query = Callable[[SparkSession, str], DataFrame]

#: name: (table, filter, WHERE condition)
FILTERS = {
    "path_all": ("region", "region", "TRUE"),
    "path_absolute": ("region", "/region[r_regionkey = 1]", "r_regionkey = 1"),
    "path_wildcard": ("nation", "*[n_regionkey = 2]", "n_regionkey = 2"),
    "path_filter": ("lineitem", "lineitem[l_quantity > 45]", "l_quantity > 45"),
    "path_union": ("lineitem", "lineitem[l_quantity > 49] | lineitem[l_discount = 0]", "l_quantity > 49 OR l_discount = 0"),
    "path_not": ("orders", '!orders[o_orderstatus = "F"]', "NOT o_orderstatus = 'F'"),
    "pred_and": ("lineitem", "lineitem[l_quantity > 30 and l_discount < 0.03]", "l_quantity > 30 AND l_discount < 0.03"),
    "pred_or": ("part", "part[p_size = 1 || p_size = 50]", "p_size = 1 OR p_size = 50"),
    "pred_multi": ("customer", 'customer[c_mktsegment = "BUILDING"][c_acctbal > 0]', "c_mktsegment = 'BUILDING' AND c_acctbal > 0"),
    "pred_not_equal": ("nation", "nation[n_regionkey != 0]", "n_regionkey <> 0"),
    "pred_field_field": ("customer", "customer[c_mktsegment < c_name]", "c_mktsegment < c_name"),
    "pred_truth": ("supplier", "supplier[s_nationkey]", "s_nationkey <> 0"),
    "pred_arith": ("part", "part[p_size * 2 + 1 > 90]", "p_size * 2 + 1 > 90"),
    "pred_minus": ("part", "part[p_size - 5 < 0]", "p_size - 5 < 0"),
    "pred_negative": ("customer", "customer[c_acctbal < -500]", "c_acctbal < -500"),
    "pred_div": ("part", "part[p_size div 2 >= 20]", "p_size / 2.0 >= 20"),
    "pred_mod": ("part", "part[p_size mod 5 = 0]", "p_size % 5 = 0"),
    "pred_concat": ("nation", 'nation[(n_nationkey _ "x") = "7x"]', "n_nationkey || 'x' = '7x'"),
    "pred_hex": ("part", "part[p_size = 0x1F]", "p_size = 31"),
    "ternary": ("part", "part[(p_size > 25 ? p_size - 25 : p_size) < 5]", "CASE WHEN p_size > 25 THEN p_size - 25 ELSE p_size END < 5"),
    "elvis": ("supplier", "supplier[(s_nationkey ?: s_suppkey) > 20]", "CASE WHEN s_nationkey <> 0 THEN s_nationkey ELSE s_suppkey END > 20"),
    "fn_boolean": ("nation", "nation[boolean(n_regionkey)]", "n_regionkey <> 0"),
    "fn_ceiling": ("lineitem", "lineitem[ceiling(l_discount * 10) = 1]", "ceil(l_discount * 10) = 1"),
    "fn_choose": ("part", "part[choose(p_size > 10, p_size, 100) < 15]", "CASE WHEN p_size > 10 THEN p_size ELSE 100 END < 15"),
    "fn_choose2": ("nation", "nation[choose2(n_regionkey, n_nationkey) = 4]", "CASE WHEN n_regionkey <> 0 THEN n_regionkey ELSE n_nationkey END = 4"),
    "fn_concat": ("region", 'region[concat(r_name, "-", r_regionkey) = "ASIA-2"]', "r_name || '-' || r_regionkey = 'ASIA-2'"),
    "fn_contains": ("customer", 'customer[contains(c_mktsegment, "IL")]', "contains(c_mktsegment, 'IL')"),
    "fn_ends_with": ("part", 'part[ends-with(p_brand, "7")]', "ends_with(p_brand, '7')"),
    "fn_false": ("region", "region[false()]", "FALSE"),
    "fn_true": ("region", "region[true()]", "TRUE"),
    "fn_floor": ("lineitem", "lineitem[floor(l_discount * 100) = 4]", "floor(l_discount * 100) = 4"),
    "fn_normalize_space": ("part", 'part[normalize-space(concat("  ", p_brand, "   x ")) = "Brand#11 x"]', "p_brand = 'Brand#11'"),
    "fn_not": ("orders", 'orders[not(o_orderstatus = "O")]', "NOT o_orderstatus = 'O'"),
    "fn_number": ("part", 'part[number(substring-after(p_brand, "#")) > 12]', "CAST(split_part(p_brand, '#', 2) AS DOUBLE) > 12"),
    "fn_rematch": ("customer", 'customer[rematch("^build", c_mktsegment, "i")]', "regexp_matches(c_mktsegment, '(?i)^build')"),
    "rematch_group": ("part", 'part[rematch("([A-Za-z]+)#([0-9]+)", p_brand, "m2") == 17]', "regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) = '17'"),
    "fn_round": ("lineitem", "lineitem[round(l_quantity div 10) = 3]", "round(l_quantity / 10) = 3"),
    "fn_starts_with": ("customer", 'customer[starts-with(c_mktsegment, "MA")]', "starts_with(c_mktsegment, 'MA')"),
    "fn_string": ("nation", 'nation[string(n_regionkey) = "3"]', "CAST(n_regionkey AS VARCHAR) = '3'"),
    "fn_string_length": ("documents", "documents[string-length(text) > 4000]", "octet_length(encode(text)) > 4000"),
    "fn_substring": ("customer", 'customer[substring(c_mktsegment, 2, 3) = "UIL"]', "substr(c_mktsegment, 2, 3) = 'UIL'"),
    "fn_substring_after": ("part", 'part[substring-after(p_brand, "#") = "23"]', "split_part(p_brand, '#', 2) = '23'"),
    "fn_substring_before": ("part", 'part[substring-before(p_brand, "#") = "Brand"]', "split_part(p_brand, '#', 1) = 'Brand'"),
    "fn_sum": ("part", "part[sum(p_size, p_size, 1) > 90]", "p_size + p_size + 1 > 90"),
    "fn_translate": ("customer", 'customer[translate(c_mktsegment, "ABC", "xy") = "xUTOMOyILE"]', "translate(c_mktsegment, 'ABC', 'xy') = 'xUTOMOyILE'"),
    "wrong_arity": ("region", "region[not(true(), false())]", "FALSE"),
}


def _filter(table: str, text: str, **options) -> Query:
    return lambda spark, sf: select(spark.read.parquet(f"{sf}/{table}.parquet"), text, table, **options)


def _table(table: str, *columns: str) -> Query:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def _emit(style: str, text: str, table: str, *columns: str, **options) -> Query:
    return lambda spark, sf: emit(_table(table, *columns)(spark, sf), text, style, **options)


def _encode(spec: str, keys: tuple[str, ...], table: str, *columns: str) -> Query:
    return lambda spark, sf: encode(_table(table, *columns)(spark, sf), spec, table, keys)


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as trees: a container, an attribute, a leaf-list and the list of their nations."""
    nations = nested_list(_table("nation", "n_nationkey", "n_name", "n_regionkey")(spark, sf), "nation", ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"])
    rows = _table("region", "r_regionkey", "r_name")(spark, sf).join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(attribute("id", F.col("r_regionkey")), container("names", F.col("r_name").alias("long"), F.left("r_name", F.lit(2)).alias("short")), leaf_list("word", F.col("r_name"), F.col("r_regionkey")), "nation")


def _parts_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return nested_list(_table("part", "p_partkey", "p_brand", "p_size")(spark, sf), "part", ["p_brand"], ["p_partkey", "p_size"], ["p_partkey"])


def _log(spark: SparkSession, sf: str) -> DataFrame:
    df = _table("supplier", "s_suppkey", "s_nationkey")(spark, sf)
    return syslog_messages(df, "{:s_suppkey/%d} is in nation {:s_nationkey/%d}\n", "supplier", priority("local3", "info"), F.to_timestamp(F.lit("2031-11-02 05:06:07.089")), "depot-9", "stock", 70)


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    return _table("documents", "doc_id", "text")(spark, sf).select("doc_id", utf8.valid(F.col("text")).alias("valid"), F.octet_length(utf8.truncated(F.col("text"), 100)).cast("bigint").alias("n_bytes"))


def _missing(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("brand"), F.nullif(F.col("p_size"), F.lit(7)).alias("size"))
    return select(part, '*[!contains(brand, "#2") and size < 5]', "part")


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a tree with their lines, of which a nested path keeps the large ones."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("line"))
    tree = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    kept = select(tree, 'orders[o_orderstatus = "O"]/line[l_quantity > 48]', "orders", keys=["o_orderkey"])
    return kept.select("o_orderkey", F.size("line").cast("bigint").alias("n"), F.aggregate("line", F.lit(0).cast("bigint"), lambda a, x: a + x["l_partkey"]).alias("parts"))


def _leaf_self(spark: SparkSession, sf: str) -> DataFrame:
    kept = select(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding[. > 0]", "embeddings", keys=["vec_id"])
    return kept.select("vec_id", F.size("embedding").cast("bigint").alias("n"))


def _stream_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/treesift-stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = _stream_folder(spark)
    return run_available(spark, sf, "nation", "nation[n_regionkey > 1]", f"{folder}/out", f"{folder}/state")


def _stream_encoder(spark: SparkSession, sf: str) -> DataFrame:
    folder, schema = _stream_folder(spark), spark.read.parquet(f"{sf}/nation.parquet").schema
    stream = filter_stream(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/nation.parque[t]"), "nation[n_regionkey > 1]", "nation")
    write_stream(stream, "csv:no-header:leafs=n_nationkey.n_name", "nation", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("value string").text(f"{folder}/out").withColumnRenamed("value", "line")


CSV = ("part", "p_partkey", "p_name", "p_brand")
OTHERS: dict[str, tuple[Query, str | None]] = {
    "pos_nth": (_filter("nation", "nation[3]", order_by=["n_nationkey"]), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2"),
    "pos_qualified": (_filter("customer", 'customer[c_mktsegment = "BUILDING"][2]', order_by=["c_custkey"]), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1 OFFSET 1"),
    "pos_then_test": (_filter("customer", 'customer[2][c_custkey > 0]', order_by=["c_custkey"]), "SELECT * FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 1) WHERE c_custkey > 0"),
    "pos_within": (_filter("customer", "customer[2]", order_by=["c_custkey"], within=["c_nationkey"]), "SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 2"),
    "pos_truthy": (_filter("customer", 'customer[2 and c_mktsegment = "BUILDING"]'), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "missing_fields": (_missing, "SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand, nullif(p_size, 7) AS size FROM part WHERE NOT contains(coalesce(nullif(p_brand, 'Brand#11'), ''), '#2') AND coalesce(nullif(p_size, 7), 0) < 5"),
    "path_leaf": (_filter("customer", "c_name", keys=["c_custkey"]), "SELECT c_custkey, c_name FROM customer"),
    "path_nested": (_nested, "SELECT o_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_quantity > 48 GROUP BY o_orderkey"),
    "leaf_self": (_leaf_self, "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0)) > 0"),
    "fmt_text": (_emit("text", "{Lwc:Part}{k:p_partkey/%05d} {:p_brand/%-12s}|{[:8}{:p_size/%d}{]:}\n", "part", "p_partkey", "p_brand", "p_size"), "SELECT 'Part: ' || printf('%05d', p_partkey) || ' ' || rpad(p_brand, CAST(greatest(12, length(p_brand)) AS INT), ' ') || '|' || lpad(CAST(p_size AS VARCHAR), CAST(greatest(8, length(CAST(p_size AS VARCHAR))) AS INT), ' ') || chr(10) AS line FROM part"),
    "fmt_json": (_emit("json", "{k:p_partkey/%d}{:p_brand}{q:p_size/%d}", "part", "p_partkey", "p_brand", "p_size"), """SELECT '{"p_partkey": ' || p_partkey || ', "p_brand": "' || p_brand || '", "p_size": "' || p_size || '"}' AS line FROM part"""),
    "fmt_xml": (_emit("xml", "{k:p_partkey}{:p_name}", "part", "p_partkey", "p_name"), """SELECT '<p_partkey key="key">' || p_partkey || '</p_partkey><p_name>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p_name>' AS line FROM part"""),
    "fmt_html": (_emit("html", "{Lc:Part}{:p_partkey}", "part", "p_partkey"), """SELECT '<div class="line"><div class="label">Part:</div><div class="data" data-tag="p_partkey">' || p_partkey || '</div></div>' AS line FROM part"""),
    "fmt_sdparams": (_emit("sdparams", "{:r_regionkey}{:r_name}", "region", "r_regionkey", "r_name"), """SELECT 'r_regionkey="' || r_regionkey || '" r_name="' || r_name || '" ' AS line FROM region"""),
    "csv_records": (lambda s, sf: csv_records(_table(*CSV)(s, sf)), """SELECT p_partkey || ',' || CASE WHEN regexp_matches(p_name, '[\\n\\r",]|^\\s|\\s$') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || p_brand AS record FROM part"""),
    "fullpath_rows": (lambda s, sf: fullpath_rows(_table("nation", "n_nationkey", "n_name", "n_regionkey")(s, sf), "nation", ["n_nationkey"]), "SELECT '/nation[n_nationkey=''' || n_nationkey || ''']/n_name=''' || n_name || '''' AS line FROM nation UNION ALL SELECT '/nation[n_nationkey=''' || n_nationkey || ''']/n_regionkey=''' || n_regionkey || '''' FROM nation"),
    "replay_events": (lambda s, sf: replay_events(_table("region", "r_regionkey", "r_name")(s, sf), "region", ["r_regionkey"]), "SELECT 0 AS seq, '[ region' AS event FROM region UNION ALL SELECT 1, '$ r_regionkey ' || r_regionkey FROM region UNION ALL SELECT 2, '= r_name ' || r_name FROM region UNION ALL SELECT 3, '] region' FROM region"),
    "cbor_records": (lambda s, sf: cbor_records(_table("region", "r_regionkey", "r_name")(s, sf)).select(F.hex("record").alias("record")), "SELECT 'BF6B' || hex('r_regionkey') || printf('%02X', r_regionkey) || '66' || hex('r_name') || printf('%02X', 96 + length(r_name)) || hex(r_name) || 'FF' AS record FROM region"),
    "rename_map": (lambda s, sf: renamed(_table("region", "r_regionkey", "r_name")(s, sf), read_name_map("# names\nr_name=name\nr_regionkey = key\n")), "SELECT r_regionkey AS key, r_name AS name FROM region"),
    "trim": (lambda s, sf: emit(_table("region", "r_name")(s, sf).select(F.concat(F.lit("  "), "r_name", F.lit(" ")).alias("r_name")), "{t:r_name}", "sdparams"), """SELECT 'r_name="' || r_name || '" ' AS line FROM region"""),
    "humanize": (lambda s, sf: _table("orders", "o_orderkey")(s, sf).select("o_orderkey", humanize(F.col("o_orderkey") * 1000).alias("size")), "SELECT o_orderkey, CASE WHEN o_orderkey * 1000 >= 1073741824 THEN (o_orderkey * 1000 // 1073741824 + CAST(o_orderkey * 1000 % 1073741824 // 1048576 >= 512 AS INT)) || 'G' WHEN o_orderkey * 1000 >= 1048576 THEN (o_orderkey * 1000 // 1048576 + CAST(o_orderkey * 1000 % 1048576 // 1024 >= 512 AS INT)) || 'M' WHEN o_orderkey * 1000 >= 1024 THEN (o_orderkey * 1000 // 1024 + CAST(o_orderkey * 1000 % 1024 >= 512 AS INT)) || 'K' ELSE CAST(o_orderkey * 1000 AS VARCHAR) END AS size FROM orders"),
    "tree_json": (lambda s, sf: tree_json(_regions(s, sf), "top/region"), """SELECT '{"top":{"region":{"names":{"long":"' || r_name || '","short":"' || r_name[:2] || '"},"word":["' || r_name || '","' || r_regionkey || '"],"nation":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}}}' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""),
    "tree_xml": (lambda s, sf: tree_xml(_regions(s, sf), "region", "top", ["n_nationkey"]), """SELECT '<top><region id="' || r_regionkey || '"><names><long>' || r_name || '</long><short>' || r_name[:2] || '</short></names><word>' || r_name || '</word><word>' || r_regionkey || '</word>' || string_agg('<nation><n_nationkey key="key">' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name></nation>', '' ORDER BY n_nationkey) || '</region></top>' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""),
    "xml_document": (lambda s, sf: xml_document(versioned(_table("nation", "n_name")(s, sf), "1.0"), "nation", "top/data"), """SELECT '<top><data>' AS line UNION ALL SELECT '<nation version="1.0"><n_name>' || n_name || '</n_name></nation>' FROM nation UNION ALL SELECT '</data></top>'"""),
    "csv_encoder": (_encode("@csv:leafs=s_name.s_suppkey", (), "supplier", "s_suppkey", "s_name"), "SELECT 's_name,s_suppkey' AS line UNION ALL SELECT s_name || ',' || s_suppkey FROM supplier"),
    "csv_path": (lambda s, sf: encode(_parts_by_brand(s, sf), "csv:path=brand/part:no-header:dos", "brand"), "SELECT p_partkey || ',' || p_size || chr(13) AS line FROM part"),
    "fullpath_nested": (lambda s, sf: encode(_parts_by_brand(s, sf), "fullpath:slax", "brand", ["p_brand", "p_partkey"]), "SELECT '/brand[p_brand==''' || p_brand || ''']/part[p_partkey==''' || p_partkey || ''']/p_size=''' || p_size || '''' AS line FROM part"),
    "fdr_encoder": (_encode("fdr", ("r_regionkey",), "region", "r_regionkey", "r_name"), "SELECT '[ region' AS line FROM region UNION ALL SELECT '$ r_regionkey ' || r_regionkey FROM region UNION ALL SELECT '= r_name ' || r_name FROM region UNION ALL SELECT '] region' FROM region"),
    "syslog_messages": (_log, """SELECT '<158>1 2031-11-02T05:06:07.089+0000 depot-9 stock 70 supplier [supplier@32473 s_suppkey="' || s_suppkey || '" s_nationkey="' || s_nationkey || '"] ' || chr(65279) || s_suppkey || ' is in nation ' || s_nationkey AS line FROM supplier"""),
    "emit_field": (lambda s, sf: emit_field(_table("nation", "n_nationkey")(s, sf), "k", "n_nationkey", "%03d", style="xml"), """SELECT '<n_nationkey key="key">' || n_nationkey || '</n_nationkey>' AS line FROM nation"""),
    "fmt_plural": (_emit("text", "{:n_regionkey} {Ngp:region,regions}", "nation", "n_regionkey"), "SELECT n_regionkey || CASE WHEN n_regionkey = 1 THEN ' region' ELSE ' regions' END AS line FROM nation"),
    "fmt_gettext": (_emit("text", "{G:}{:n_nationkey/%d} is {:n_name}", "nation", "n_nationkey", "n_name", catalog={"{:n_nationkey} is {:n_name}": "{:n_name}: {:n_nationkey}"}), "SELECT n_name || ': ' || n_nationkey AS line FROM nation"),
    "fmt_color": (_emit("text", "{C:bold,fg-red}{:r_name}{C:}", "region", "r_name"), "SELECT chr(27) || '[1;31m' || r_name || chr(27) || '[0m' AS line FROM region"),
    "fmt_argument": (_emit("sdparams", "{a:/%d}", "region", "r_regionkey", arguments=("r_regionkey",)), """SELECT 'r_regionkey="' || r_regionkey || '" ' AS line FROM region"""),
    "fmt_units": (_emit("xml", "{:p_size/%d}{U:cm}", "part", "p_size", units=True), """SELECT '<p_size units="cm">' || p_size || '</p_size>' AS line FROM part"""),
    "fmt_xpath": (_emit("html", "{k:r_regionkey}{:r_name}", "region", "r_regionkey", "r_name", xpath="/top/region", keys=False), """SELECT '<div class="line"><div class="data" data-tag="r_regionkey" data-xpath="/top/region/r_regionkey">' || r_regionkey || '</div><div class="data" data-tag="r_name" data-xpath="/top/region[r_regionkey=''' || r_regionkey || ''']/r_name">' || r_name || '</div></div>' AS line FROM region"""),
    "fmt_leaf_list": (lambda s, sf: emit(_table("embeddings", "vec_id", "embedding")(s, sf).select(F.col("vec_id"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("sign")), "{l:sign}", "json"), """SELECT '{"sign": [' || array_to_string(list_transform(embedding, lambda x: CAST(x > 0 AS INT)), ', ') || ']}' AS line FROM embeddings"""),
    "command": (lambda s, sf: command(s, ["--xml", "--wrap", "top", "{k:kind} carries {:load/%d} crates.\\n", "barge", "40"]), "SELECT '<top><kind>barge</kind><load>40</load></top>' AS line"),
    "utf8_truncate": (_cut, "SELECT doc_id, TRUE AS valid, list_max(list_filter(list_transform(range(0, 101), lambda k: octet_length(encode(left(text, k)))), lambda n: n <= 100)) AS n_bytes FROM documents"),
    "stream_encoder": (_stream_encoder, "SELECT n_nationkey || ',' || n_name AS line FROM nation WHERE n_regionkey > 1"),
    "stream_filter": (_stream, "SELECT * FROM nation WHERE n_regionkey > 1"),
}


#: Texts that stand for numbers, or don't: as they are given, and the number each stands for.
NUMBERS = {"7": 7, " 8": 8, "010": 8, "089": 89, "0x1F": 31, "-0x10": -16, "0xfffffffffffffffffff": 18446744073709551615, "99999999999999999999": 9223372036854775807, "1e30": 1e30, "2gether": 0, "": 0, ".5": 0.5, "-inf": "-infinity", "2.0.4.5": 0}
WORDS = ("é1", "日本", "abc", "aéb", "", "ｘ")


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _numbers(text: str) -> Query:
    return lambda s, sf: select(_values(s, list(enumerate(NUMBERS)), "k int, x string"), f"item[{text}]", "item").select("k")


def _numbers_sql(where: str) -> str:
    rows = ", ".join(f"({k}, CAST('{n}' AS DOUBLE))" for k, n in enumerate(NUMBERS.values()))
    return f"SELECT k FROM (VALUES {rows}) AS v(k, x) WHERE {where}"


def _words(text: str) -> Query:
    return lambda s, sf: select(_values(s, list(enumerate(WORDS)), "k int, x string"), f"item[{text}]", "item").select("k")


def _words_sql(where: str) -> str:
    """Conditions over x and its UTF-8 bytes in hexadecimal, h."""
    rows = ", ".join(f"({k}, '{x}', '{x.encode().hex()}')" for k, x in enumerate(WORDS))
    return f"SELECT k FROM (VALUES {rows}) AS v(k, x, h) WHERE {where}"


def _customers_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    return nested_list(_table("customer", "c_nationkey", "c_custkey", "c_acctbal")(spark, sf), "customer", ["c_nationkey"], ["c_custkey", "c_acctbal"], ["c_custkey"])


def _nested_place(text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        kept = select(_customers_by_nation(spark, sf), text, "nation", keys=["c_nationkey", "c_custkey"])
        return kept.select("c_nationkey", F.explode("customer").alias("c")).select("c_nationkey", "c.c_custkey")

    return run


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """A replay script, and the rows that its filter leaves."""
    script = ["r", "?region[@on = '1' and size > 2]", "{region"]
    for k in range(6):
        script += ["<region", f"$ id {k}", f"@ on {k % 2}", f"= size {k}", ">region"]
    (block,) = read_replay([*script, "}region", "q"])
    return select(instances(spark, block, "region"), block.filters, "region", keys=["id"]).select("id", "size")


def _attribute(spark: SparkSession, sf: str) -> DataFrame:
    return select(_table("nation", "n_nationkey", "n_regionkey")(spark, sf).withColumnRenamed("n_regionkey", "_region"), "nation[@region = 2]", "nation").select("n_nationkey")


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """A row decided by its last field keeps its containers, or with compat loses those before it."""
    df = _table("nation", "n_nationkey", "n_name", "n_regionkey")(spark, sf).select("n_nationkey", F.struct("n_name").alias("box"), "n_regionkey")
    kept = [select(df, "nation[n_regionkey = 3]", "nation", compat=c) for c in (False, True)]
    return kept[0].select("n_nationkey", F.col("box.n_name").alias("name")).unionByName(kept[1].select("n_nationkey", F.lit(",".join(kept[1].columns)).alias("name")))


ODD_TEXT = 'a<b>&"]\\/\n\x01'


def _escapes(spark: SparkSession, sf: str) -> DataFrame:
    """A text with what each style escapes, in three of them."""
    df = _table("region", "r_regionkey")(spark, sf).select(F.lit(ODD_TEXT).alias("t"))
    return reduce(DataFrame.unionByName, [emit(df, "{,escape-slash:t}", s).select(F.lit(s).alias("style"), "line") for s in ("json", "xml", "sdparams")])


ESCAPED = {"json": r'{"t": "a<b>&\"]\\\/\n\u0001"}', "xml": '<t>a&lt;b&gt;&amp;"]\\/\n </t>', "sdparams": 't="a<b>&\\"\\]\\\\/\n\x01" '}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '") + "'"


class _FolderWriter(Writer):
    """Writes a partition's lines to a file below a folder that all executors share."""

    def __init__(self, folder: str):
        self.lines, self.folder = [], folder

    def write(self, line: str) -> None:
        self.lines.append(line)

    def flush(self) -> None:
        folder = Path(self.folder)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / uuid.uuid4().hex).write_text("".join(x + "\n" for x in self.lines))


def _writers(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{_stream_folder(spark)}/lines"
    deliver(encode(_table("nation", "n_nationkey", "n_name")(spark, sf), "csv:no-header", "nation"), partial(_FolderWriter, folder.removeprefix("file://")))
    return spark.read.text(folder).withColumnRenamed("value", "line")


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    register("shout", lambda df, table, keys, options: df.select(F.upper(F.concat_ws(options[0], *[F.col(c).cast("string") for c in df.columns])).alias("line")))
    return encode(_table("region", "r_regionkey", "r_name")(spark, sf), "shout:~", "region")


def _stream_nth(spark: SparkSession, sf: str) -> DataFrame:
    folder, schema = _stream_folder(spark), spark.read.parquet(f"{sf}/customer.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/customer.parque[t]").select("c_custkey", "c_nationkey", "c_acctbal")
    kept = nth_of_stream(stream, "customer[c_acctbal > 0][2]", "customer", ["c_nationkey"], ["c_custkey"])
    kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/out")


def _built(spark: SparkSession, sf: str) -> DataFrame:
    """A tree built node by node, with a list opened for its instances and closed by a marker."""
    b = Builder()
    b.open_container("top").leaf("id", F.col("n_nationkey")).open_marker("m").open_instance("part").leaf("name", F.col("n_name")).close_instance().open_instance("part").leaf("region", F.col("n_regionkey")).close_marker("m")
    b.open_leaf_list("w").leaf("w", F.col("n_name")).close_container("top")
    return tree_json(_table("nation", "n_nationkey", "n_name", "n_regionkey")(spark, sf).select(*b.columns()))


def _handled(spark: SparkSession, sf: str) -> DataFrame:
    h = Handle(_table("nation", "n_nationkey", "n_name", "n_regionkey")(spark, sf), "nation", "json,map=n_name=name", keys=["n_nationkey"])
    return h.set_options("filter=nation[n_regionkey = 1]").set_style("xml").set_flags("keys").lines()


def _caseless(spark: SparkSession, sf: str) -> DataFrame:
    df = _values(spark, [(1, "ÄB", "äb"), (2, "a", "B"), (3, "c", "B")], "k int, a string, b string")
    return df.select("k", utf8.compare_caseless(F.col("a"), F.col("b")).alias("c"), utf8.joined(F.col("a"), F.col("b")).alias("ab"))


def _linted(spark: SparkSession, sf: str) -> DataFrame:
    """Messages about formats: slips in their text, and fields that the table's types don't fit."""
    schema = spark.read.parquet(f"{sf}/part.parquet").schema
    return _values(spark, [(m,) for m in [*lint("{C:blink}"), *check_types("{:size/%d}{:p_name/%f}", schema)]], "message string")


def _document(spark: SparkSession, sf: str) -> DataFrame:
    return render(_table("nation", "n_nationkey", "n_name")(spark, sf).coalesce(1), "json,filter=nation[n_nationkey > 20]", "nation", top="top", document=True)


PRINTED = (0, 7, -42, 12345678)
OTHERS |= {
    "coerce_text": (_numbers("x = 31"), _numbers_sql("x = 31")),
    "coerce_text_order": (_numbers("x > 30"), _numbers_sql("x > 30")),
    "coerce_text_truth": (_numbers("x"), _numbers_sql("abs(x) >= 1")),
    "coerce_text_unsigned": (_numbers("x >= 18446744073709551615"), _numbers_sql("x >= 18446744073709551615")),
    "coerce_mod_large": (_numbers("x mod 8 = 0"), _numbers_sql("isfinite(x) AND x - 8 * trunc(x / 8) = 0")),
    "fn_substring_bytes": (_words("substring(x, 3, 1) = '1'"), _words_sql("h[5:6] = '31'")),
    "fn_substring_cut": (_words("string-length(substring(x, 2, 3)) = 3"), _words_sql("length(h) >= 8")),
    "fn_translate_bytes": (_words("translate(x, 'é', 'e') = 'e1'"), _words_sql("replace(replace(h, 'c3', '65'), 'a9', '') = '6531'")),
    "fn_translate_computed": (_words("translate(x, concat(x, 'b'), '') = ''"), _words_sql("TRUE")),
    "fn_rematch_computed": (_filter("customer", 'customer[rematch(substring(c_mktsegment, 1, 3), "MACHINERY AUTO")]'), "SELECT * FROM customer WHERE contains('MACHINERY AUTO', c_mktsegment[1:3])"),
    "fn_rematch_bad": (_filter("region", 'region[not(rematch("(", r_name))]'), "SELECT * FROM region"),
    "pos_nested": (_nested_place("nation/customer[2]"), "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 2"),
    "pos_nested_test": (_nested_place("nation/customer[c_acctbal > 0][2]/c_acctbal"), "SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 2"),
    "pos_nested_union": (_nested_place("nation/customer[1] | nation/customer[c_acctbal < 0]"), "SELECT c_nationkey, c_custkey FROM customer QUALIFY c_acctbal < 0 OR row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1"),
    "pos_nested_not": (_nested_place("!nation/customer[1]"), "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) > 1"),
    "pos_union": (_filter("nation", "nation[3] | nation[n_regionkey = 1] | nation[n_regionkey = 2][1]", order_by=["n_nationkey"]), "SELECT * FROM nation WHERE n_regionkey = 1 OR n_nationkey = (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 1 OFFSET 2) OR n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)"),
    "pos_not": (_filter("nation", "!nation[3]", order_by=["n_nationkey"]), "SELECT * FROM nation WHERE n_nationkey <> (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 1 OFFSET 2)"),
    "pos_stream": (_stream_nth, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 2"),
    "path_several": (lambda s, sf: select(s.read.parquet(f"{sf}/nation.parquet"), ["nation[n_regionkey = 1]", "nation[n_nationkey < 3]"], "nation"), "SELECT * FROM nation WHERE n_regionkey = 1 OR n_nationkey < 3"),
    "path_not_nested": (_nested_place("!nation/customer[c_acctbal > 0]"), "SELECT c_nationkey, c_custkey FROM customer WHERE NOT c_acctbal > 0"),
    "attribute": (_attribute, "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"),
    "late_decision": (_late, "SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_nationkey, 'n_nationkey,n_regionkey' FROM nation WHERE n_regionkey = 3"),
    "replay_script": (_replayed, "SELECT id, size FROM (VALUES ('3', '3'), ('5', '5')) AS v(id, size)"),
    "register_encoder": (_registered, "SELECT upper(r_regionkey || '~' || r_name) AS line FROM region"),
    "writers": (_writers, "SELECT n_nationkey || ',' || n_name AS line FROM nation"),
    "fmt_escapes": (_escapes, f"SELECT style, line FROM region, (VALUES {', '.join(f'({_sql_text(s)}, {_sql_text(x)})' for s, x in ESCAPED.items())}) AS v(style, line)"),
    "fmt_numbers": (lambda s, sf: emit(_values(s, [(n, n / 8.0) for n in PRINTED], "n long, f double"), "{:n/%d}|{:n/%9.4d}|{:n/%-6d}|{:n/%010d}|{:n/%+d}|{:f/%8.3f}"), f"SELECT line FROM (VALUES {', '.join(_sql_text('%d|%9.4d|%-6d|%010d|%+d|%8.3f' % (n, n, n, n, n, n / 8.0)).join('()') for n in PRINTED)}) AS v(line)"),
    "fmt_star": (lambda s, sf: emit(_table("nation", "n_name")(s, sf).withColumn("wide", F.lit(30)), "{:n/%*s}|", inputs={"n": ["wide", "n_name"]}), "SELECT lpad(n_name, 30, ' ') || '|' AS line FROM nation"),
    "fmt_error": (lambda s, sf: emit(_table("region", "r_name")(s, sf), "{:r_name}: {:why/%m}", error="not found"), "SELECT r_name || ': not found' AS line FROM region"),
    "fmt_title": (_emit("text", "{T:Name/%-10s}{:r_name}", "region", "r_name"), "SELECT rpad('Name', 10, ' ') || r_name AS line FROM region"),
    "fmt_display": (_emit("sdparams", "{d:r_name}{e:r_regionkey}{:r_name}", "region", "r_name", "r_regionkey"), """SELECT 'r_regionkey="' || r_regionkey || '" r_name="' || r_name || '" ' AS line FROM region"""),
    "fmt_encoding": (_emit("text", "{d:r_name}{e:r_regionkey}", "region", "r_name", "r_regionkey"), "SELECT r_name AS line FROM region"),
    "fmt_roles": (_emit("text", "{D:(}{E:bad }{W:odd }{:r_name}{D:)}{P:  }{Nw:note}{L:end}", "region", "r_name"), "SELECT '(bad odd ' || r_name || ')   noteend' AS line FROM region"),
    "fmt_no_quotes": (_emit("json", "{n:r_name}{q:r_regionkey}{n:r_regionkey/%d}", "region", "r_name", "r_regionkey"), """SELECT '{"r_name": ' || r_name || ', "r_regionkey": "' || r_regionkey || '", "r_regionkey": ' || r_regionkey || '}' AS line FROM region"""),
    "fmt_comma": (_emit("json", "{,comma:r_name}", "region", "r_name"), """SELECT '{"r_name": "' || r_name || '"}' AS line FROM region"""),
    "fmt_private": (lambda s, sf: emit(_table("region", "r_name")(s, sf).select(F.concat("r_name", F.lit("\x02")).alias("t")), "{,escape-private:t}{,escape-square:t}", "xml"), "SELECT '<t>' || r_name || chr(57346) || '</t><t>' || r_name || '[]</t>' AS line FROM region"),
    "fmt_formatter": (lambda s, sf: emit(_table("region", "r_name")(s, sf), "{:r_name}", formatter=lambda d, c, how: F.reverse(c)), "SELECT reverse(r_name) AS line FROM region"),
    "humanize_decimal": (lambda s, sf: _table("orders", "o_orderkey")(s, sf).select("o_orderkey", humanize(F.col("o_orderkey") * 0 + 1536, decimal=True, space=True).alias("size"), humanize(F.col("o_orderkey") * 0 + 44_000_000, 1000).alias("tens")), "SELECT o_orderkey, '1.5 K' AS size, '44M' AS tens FROM orders"),
    "json_document": (_document, """SELECT '{"top":{"nation":[' AS line UNION ALL SELECT CASE WHEN n_nationkey = 21 THEN '' ELSE ',' END || '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' FROM nation WHERE n_nationkey > 20 UNION ALL SELECT ']}}'"""),
    "options_render": (lambda s, sf: render(_table("nation", "n_nationkey", "n_name", "n_regionkey")(s, sf), "json,underscores,map=n_name=the-name,filter=nation[contains(n_name\\, '1')]", "nation"), """SELECT '{"n_nationkey":' || n_nationkey || ',"the_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation WHERE contains(n_name, '1')"""),
    "options_encoder": (lambda s, sf: render(_table("nation", "n_nationkey", "n_name")(s, sf), "@csv:no-header:leafs=name,map=n_name=name,filter=nation[n_nationkey < 5]", "nation"), "SELECT n_name AS line FROM nation WHERE n_nationkey < 5"),
    "fullpath_escapes": (lambda s, sf: fullpath_rows(_table("region", "r_name")(s, sf).select(F.concat(F.lit("it's "), "r_name").alias("k"), F.concat(F.lit('"\n'), "r_name").alias("v")), "region", ["k"]), "SELECT '/region[k=''it' || chr(92) || '''s ' || r_name || ''']/v=''' || chr(92) || '\"' || chr(92) || 'k' || r_name || '''' AS line FROM region"),
    "builder": (_built, """SELECT '{"top":{"id":' || n_nationkey || ',"part":[{"name":"' || n_name || '"},{"region":' || n_regionkey || '}],"w":["' || n_name || '"]}}' AS line FROM nation"""),
    "handle": (_handled, """SELECT '<nation><n_nationkey key="key">' || n_nationkey || '</n_nationkey><name>' || n_name || '</name><n_regionkey>' || n_regionkey || '</n_regionkey></nation>' AS line FROM nation WHERE n_regionkey = 1"""),
    "command_filter": (lambda s, sf: command(s, ["--options", "json,filter=data[load > 39]", "--top-wrap", "{k:kind} carries {:load/%d}", "barge", "40"]), """SELECT '{"kind": "barge", "load": 40}' AS line"""),
    "utf8_caseless": (_caseless, "SELECT k, c, ab FROM (VALUES (1, 0, 'ÄBäb'), (2, -1, 'aB'), (3, 1, 'cB')) AS v(k, c, ab)"),
    "lint": (_linted, "SELECT message FROM (VALUES ('no such colour or effect: ''blink'''), ('no column ''size'''), ('%f shows fractions, ''p_name'' is string')) AS v(message)"),
}


def queries() -> dict[str, Query]:
    return {name: _filter(table, text) for name, (table, text, _) in FILTERS.items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT * FROM {table} WHERE {where}" for name, (table, _, where) in FILTERS.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
