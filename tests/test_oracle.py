"""Every query of the catalogue that SQL can express against DuckDB, over the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from kgspark import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = catalog_queries.queries()[name](spark, SF)
    asked = duck.execute(catalog_queries.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(found.columns)
    expected = Counter(tuple(map(comparable, r)) for r in asked.fetchall())
    assert Counter(tuple(map(comparable, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect()) == expected
    assert expected or name in ("lookup_hard_filters",)
