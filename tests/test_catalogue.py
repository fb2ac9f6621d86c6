"""Every named query against the same query in SQL, on the smallest tables."""

import duckdb
import pytest

from folioweave.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return db


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(map(tuple, got.select(columns).collect())) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0  # what they say: tests/test_flow.py, tests/test_whole.py
