"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from pliego.plans import registry
from pliego.plans.contract_view import TABLES

from conftest import SF_SMALL
from oracle_compare import canon

registry.load_all()
NAMES = sorted(registry.QUERIES)
SQL = registry.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(SQL) == set(NAMES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "precio_referencia" in df.columns


SPARK_TO_DUCKDB = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema.fields:
        assert SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString()) == types.get(f.name), f.name
    res = con.execute(SQL[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert canon(cols, rows) == canon(ocols, orows)
