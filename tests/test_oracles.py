"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from arborlane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _rows(names, rows, order):
    at = [names.index(n) for n in order]
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    sql = catalog.oracles().get(name)
    if sql is None:
        assert rows and got.columns
        return
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, rows, sorted(names)) == _rows(names, found.fetchall(), sorted(names))
