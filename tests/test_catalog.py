import pytest

import oracle
from kbspark.plans import catalog, catalog_code, catalog_more, catalog_rest  # noqa: F401 (registers further queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, db, name):
    oracle.same(catalog.QUERIES[name](spark, SF), db, catalog.SQL[name])


def test_hashed_embedding(spark):
    rows = catalog.QUERIES["vec_hashed_embedding"](spark, SF).collect()
    for row in rows:
        length = sum(x * x for x in row.vector)
        assert len(row.vector) == 64 and (length == 0 or abs(length - 1) < 1e-9)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "file_path", "symbol", "edge_type", "neighbour"]
