"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from strataweave import registry

ORACLE = registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, bool):
        return value
    return round(float(value), 5) if isinstance(value, (int, float)) else str(value)


def rows_of(frame, columns):
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query(spark, duck, key):
    got = registry.queries()[key](spark, SMALL)
    frame = got.toPandas()
    assert list(frame.columns) == got.columns
    if key in ORACLE:
        found = duck.execute(ORACLE[key])
        names = [d[0] for d in found.description]
        expected = pd.DataFrame(found.fetchall(), columns=names)
        assert sorted(names) == sorted(got.columns)
        assert rows_of(frame, sorted(names)) == rows_of(expected, sorted(names))
