"""The filter cases of FIXTURES.md, on rows of text columns."""

import pytest

from treesift.operators.select import select
from treesift.plans.ast import FilterSyntaxError, UnsupportedFeature

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CASES = [
    ("item[host = 'beta']", "id host", [("1", "alpha"), ("2", "beta"), ("3", "gamma")], ["2"]),
    ("item[type = 'A' and color = 'red']", "data type color", [("1", "A", "red"), ("2", "A", "blue"), ("3", "B", "red")], ["1"]),
    ("item[not(color='red')]", "id color", [("1", "red"), ("2", "blue"), ("3", "red"), ("4", "green")], ["2", "4"]),
    ("item[number(price) == 2]", "price", [("2.0",), ("2gether",), ("3",), ("2.0.4.5",)], ["2.0"]),
    ("item[ceiling(price) == floor(price)]", "price", [("2.0",), ("2.5",), ("3.0",), ("3.9",)], ["2.0", "3.0"]),
    ("item[round(val) = 3]", "val", [("2.6",), ("3.0",), ("3.4",), ("3.5",), ("3.6",)], ["2.6", "3.0", "3.4"]),
    ("item[string-length(name) > 4]", "name", [("eth0",), ("lo0",), ("wlan0",), ("e1",)], ["wlan0"]),
    ("item[sum(rx, tx) > 100]", "id rx tx", [("1", "80", "40"), ("2", "30", "60"), ("3", "50", "50")], ["1"]),
    (f"item[translate(proto, '{LOWER}', '{UPPER}') = 'HTTP']", "proto", [("http",), ("ftp",), ("HTTP",)], ["HTTP", "http"]),
    ("item[choose2(override, base-id) = '42']", "id override base-id", [("1", "99", "42"), ("2", None, "42"), ("3", "42", "10"), ("4", None, "10")], ["2", "3"]),
    ("item[(score ?: default_score) > 10]", "id score default_score", [("a", "15", "5"), ("b", "0", "20"), ("c", None, "8"), ("d", "5", "50")], ["a", "b"]),
    ("item[normalize-space(text) = 'hello world']", "val text", [("1", "  hello   world "), ("2", "hello world"), ("3", "helloworld")], ["1", "2"]),
    ("item[rematch(\"tcp\", protocol, \"i\")]", "protocol", [("TCP4",), ("udp",), ("tcp6",)], ["TCP4", "tcp6"]),
    ("item[rematch(\":([0-9]+)\", address, \"m\")]", "address", [("127.0.0.1:8080",), ("127.0.0.1:0",), ("/var/run/log",)], ["127.0.0.1:8080"]),
    ("item[!contains(path, \"/var/run/\")]", "id path", [("1", "/var/run/log"), ("2", None), ("3", "/tmp/x")], ["2", "3"]),
    ("item[on-order > in-stock]", "name on-order in-stock", [("bolt", "42", "144"), ("water", "2", "14"), ("gum", "10", "54"), ("rope", "2", "4"), ("ladder", "1", "2")], ["bolt", "water"]),
    ("item[price < 5]", "id price", [("1", "4"), ("2", None), ("3", "6")], ["1", "2"]),
    ("item[flag]", "id flag", [("1", "1"), ("2", "0"), ("3", "yes"), ("4", "0.5"), ("5", "0x10"), ("6", "010")], ["1", "5", "6"]),
    ("item[size = 8]", "id size", [("1", "010"), ("2", "8"), ("3", "10")], ["1", "2"]),
    ("item[size mod 3 = 1 && size >= 4]", "size", [("1",), ("4",), ("7",), ("9",)], ["4", "7"]),
    ("item[(a _ b) = 'xy']", "id a b", [("1", "x", "y"), ("2", "xy", ""), ("3", "y", "x")], ["1", "2"]),
    ("item[substring(name, 0, 2) = 'et']", "name", [("eth0",), ("te",)], ["eth0"]),
    ("item[substring-before(name, '.') = '' and substring-after(name, '.') = '']", "name", [("a.b",), ("ab",)], ["ab"]),
    ("item[not(true(), false())]", "id", [("1",)], []),
    ("item[2 - 3 = -1]", "id", [("1",)], ["1"]),
]


@pytest.mark.parametrize(("text", "columns", "rows", "want"), CASES, ids=[c[0][:40] for c in CASES])
def test_case(spark, text, columns, rows, want):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns.split()))
    assert sorted(r[0] for r in select(df, text, "item").collect()) == want


POSITIONS = [
    ("socket[2 and protocol='tcp4']", [("tcp4", 100), ("tcp4", 200), ("udp", 300)], [100, 200]),
    ("socket[2][protocol='tcp4']", [("tcp4", 100), ("tcp4", 200), ("udp", 300)], [200]),
    ("socket[protocol='tcp4'][2]", [("udp", 100), ("tcp4", 200), ("tcp4", 300)], [300]),
    ("socket[2]", [("a", 1), ("b", 2), ("c", 3)], [2]),
]


@pytest.mark.parametrize(("text", "rows", "want"), POSITIONS)
def test_position(spark, text, rows, want):
    df = spark.createDataFrame(rows, "protocol string, seq int")
    assert [r.seq for r in select(df, text, "socket", order_by=["seq"]).collect()] == want


def test_costs(spark):
    df = spark.createDataFrame([(1, ["425", "455"])], "id int, cost array<string>")
    assert select(df, "cost[. > 450]", "item", keys=["id"]).collect() == [(1, ["455"])]


def test_nested_before_the_deciding_field(spark):
    df = spark.createDataFrame([("tcp", ("a",), "8080", ("b",)), ("udp", ("c",), "53", ("d",))], "protocol string, local struct<address:string>, port string, remote struct<address:string>")
    text = "socket[protocol = 'tcp' and port = '8080']"
    assert select(df, text, "socket").collect() == [("tcp", ("a",), "8080", ("b",))]
    assert select(df, text, "socket", compat=True).collect() == [("tcp", "8080", ("b",))]
    assert select(df, "socket[protocol = 'tcp']", "socket", compat=True).columns == df.columns


@pytest.mark.parametrize("text", ["foo//goo", "item[a[b] = 1]", "item[a/b = 1]", "item[..//node()]", "item[a =", "item[", "item]", "item[a | b]", "item[$x = 1]", "child::item", "item[text() = 1]", "", "item[a = 'x]"])
def test_rejected(spark, text):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises((FilterSyntaxError, UnsupportedFeature)):
        select(df, text, "item")
