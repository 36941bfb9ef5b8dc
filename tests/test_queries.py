import datetime
import math
from pathlib import Path

import duckdb
import pytest

from quire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((repr([plain(v[k]) for k in order]) for v in values))


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, sql, name):
    found = registry.queries()[name](spark, sf)
    if name not in registry.oracle_sql():
        assert len(found.collect()) > 0
        return
    want = sql.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())
