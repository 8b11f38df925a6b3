"""Positions in long lists: the time grows with the list, not with its square."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from treesift.operators.select import select
from treesift.queries import oracle_sql, queries

#: Elements of the longest list, and what a test may take; with places found anew for each element it takes longer.
LENGTH, SECONDS = 12_000, 15


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A folder with a nation of LENGTH customers, one of three and one of one."""
    folder = tmp_path_factory.mktemp("customers")
    nation = f"CASE WHEN id < {LENGTH} THEN 0 WHEN id < {LENGTH + 3} THEN 1 ELSE 2 END AS c_nationkey"
    df = spark.range(LENGTH + 4).selectExpr("id * 7 AS c_custkey", nation, "CASE WHEN id % 3 = 0 THEN -1.5D WHEN id % 3 = 1 THEN 0D ELSE 2.5D END AS c_acctbal")
    df.repartition(3, "c_custkey").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def timed(df):
    began = time.monotonic()
    rows = df.collect()
    assert time.monotonic() - began < SECONDS
    return rows


@pytest.mark.parametrize("name", ["pos_nested", "pos_nested_not", "pos_nested_union", "pos_nested_test"])
def test_query_of_a_long_list(spark, customers, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{customers}/customer.parquet/*.parquet'")
    want = duck.execute(f"SELECT c_nationkey, c_custkey FROM ({oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, timed(queries()[name](spark, customers)))) == sorted(want)


@pytest.mark.parametrize("name", ["pos_nested_union", "pos_nested_test"])
def test_list_is_made_once(spark, customers, name):
    """Its condition and those that Spark infers from explode would each make it again."""
    plan = queries()[name](spark, customers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(p0") == 1


@pytest.mark.parametrize(("text", "want"), [("tag[. != 't1'][2]", ["t2"]), ("!tag[2]", ["t0", *[f"t{k}" for k in range(2, LENGTH)]])])
def test_long_leaf_list(spark, text, want):
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda k: F.concat(F.lit("t"), k.cast("string"))).alias("tag"))
    assert [r.tag for r in timed(select(df, text, "top", keys=["id"]))] == [want]


@pytest.mark.parametrize(("text", "want"), [("top/item[v > 0][2]", [4]), ("top/item[3][v > 0]", [3]), ("top/item[v > 0][2][2]", None), ("top/item[2147483648]", None), ("top/item[99999999999999999999] | top/item[v > 0][1]", [3])])
def test_position_among_elements_left(spark, text, want):
    """Taken from the elements left, not looked for in them; one that no list has leaves none."""
    df = spark.createDataFrame([(1, [(1, None), (2, -1.0), (3, 0.5), (4, 2.0)]), (2, None)], "id int, item array<struct<k:int,v:double>>")
    kept = select(df, text, "top", keys=["id"])
    assert [[e.k for e in r.item] for r in kept.collect()] == ([] if want is None else [want])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan or want is None
