"""Every registered query of the library against its SQL."""

import pytest

from lexiloom.jobs import catalog

from .compare import duck, same
from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    same(got, con.sql(catalog.ORACLES[name]).df())
    # two empty results prove nothing
    assert len(got)


def test_approximate_concepts_are_near(spark):
    exact = {r["document_id"]: r["concepts"] for r in catalog.QUERIES["a8_concepts"](spark, SF).collect()}
    for r in catalog.QUERIES["a8_concepts_approximate"](spark, SF).collect():
        assert abs(r["concepts"] - exact[r["document_id"]]) <= max(2, 0.15 * exact[r["document_id"]])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
