"""Every query with SQL against DuckDB on the smallest tables."""

import pathlib

import duckdb
import pytest

from quern import queries
from quern.operators import rank

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(a) == rows(b)


def test_minmax_groups(spark):
    """Null groups, null values and equal values."""
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), (None, 5.0), (None, 7.0)]
    got = rank.minmax(spark.createDataFrame(rows, "g string, x double"), "g", {"s": "x"}).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted([("a", 1.0, 0.0), ("a", 3.0, 1.0), ("a", None, None), ("b", 2.0, 0.0), (None, 5.0, 0.0), (None, 7.0, 1.0)], key=key)
    assert rank.minmax(spark.createDataFrame([], "g string, x double"), "g", {"s": "x"}).count() == 0
