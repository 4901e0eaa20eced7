"""Every registered query of the engine runs and, where SQL can express it, agrees with DuckDB on the small tables."""

import duckdb
import pytest

from loomstone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(testdata):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{testdata}/{t}.parquet')")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    show = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(show, r)) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, testdata, name):
    got = catalog.QUERIES[name](spark, testdata).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(con.sql(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
