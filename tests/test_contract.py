"""Every core query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import database, rows_of, rows_of_sql
from stratafold.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = rows_of(catalogue.QUERIES[name](spark, FOLDER))
    if name in catalogue.ORACLES:
        assert got == rows_of_sql(db, catalogue.ORACLES[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_name", "bal"] and df.count() == 10


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p4_found", "p5_found"} <= set(entry.queries())


def test_merge_sees_every_order(spark, db):
    keys = [r.o_orderkey for r in catalogue.QUERIES["q61_merge_whole"](spark, FOLDER).collect()]
    every = [k for (k,) in db.execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
    assert keys == sorted(keys) and set(keys) == set(every) and max(keys) >= 900 and len(keys) > len(every)
