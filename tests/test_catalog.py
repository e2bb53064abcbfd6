"""Every query of the catalog against its SQL in DuckDB, over the smallest test data."""

import os

import duckdb
import pytest

from quarrylight.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test data isn't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        return round(x, 4) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.SQL:
        assert got
        return
    relation = duck.sql(catalog.SQL[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    assert [TYPES[str(relation.types[i])] for i in place] == [dict(df.dtypes)[c] for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in place) for r in relation.fetchall())
