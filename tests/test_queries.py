"""Every registered query runs, and agrees with its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paperledger.plans import catalog, storage  # noqa: F401 (adds its queries to the catalog)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, tables, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    wanted = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert set(entry.oracle_sql()) <= set(entry.queries())
