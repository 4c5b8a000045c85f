"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return Counter(tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    duck.execute("CREATE OR REPLACE TABLE want AS " + registry.oracle_sql()[name])
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM want")
    assert sorted(duck.sql("FROM want").columns) == columns
    assert rows(df.select(*columns).collect()) == rows(want.fetchall())
