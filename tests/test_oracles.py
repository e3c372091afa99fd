"""Every registered query with a DuckDB statement gives its rows (small scale)."""

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.8g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_statement(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    expected = sorted(tuple(plain(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect()) == expected


def test_entry_point_imports_and_lists_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(registry.queries()) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
