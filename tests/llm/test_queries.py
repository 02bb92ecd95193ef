"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import pytest

from compare import database, rows_of, rows_of_sql
from stratafold import storage
from stratafold.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = rows_of(queries.QUERIES[name](spark, FOLDER))
    if name in queries.ORACLES:
        assert got == rows_of_sql(db, queries.ORACLES[name])


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p3_clusters", "p3_pivots", "p7_assignments", "p8_found", "p8_lines"])
def test_only_the_result_stays(spark, name):
    """Of everything a query writes below the shared folder its result is left."""

    def folders():
        place, fs = storage._hadoop(spark, storage.workspace(spark, "x"))
        place = place.getParent()
        return {s.getPath().getName() for s in fs.listStatus(place)} if fs.exists(place) else set()

    before = folders()
    queries.QUERIES[name](spark, FOLDER).count()
    assert len(folders() - before) == 1
