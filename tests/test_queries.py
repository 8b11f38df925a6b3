"""Every query of the language against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from treesift.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in names]).collect())
    if name in oracle_sql():
        want = duck.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()[name]})").fetchall()
        assert got == rows(want)
    else:
        assert len(got) == df.count()
