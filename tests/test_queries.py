"""Every registered query against DuckDB on the smallest tables."""

import datetime
import decimal
import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from provframe.plans.catalogue import ORACLES, QUERIES

from .conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 9)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()[:10]
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def results(spark):
    """All Spark results; jobs of different queries overlap."""

    def run(item):
        name, query = item
        try:
            df = query(spark, SF_SMALL)
            return name, table(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # reported by the query's own test
            return name, e

    with ThreadPoolExecutor(8) as pool:
        return dict(pool.map(run, QUERIES.items()))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, results, duck):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    duck.execute(ORACLES[name])
    want = table([c[0] for c in duck.description], duck.fetchall())
    assert got == want
