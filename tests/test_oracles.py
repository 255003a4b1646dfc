"""Every query that has SQL gives DuckDB's rows, on the smallest tables."""

import duckdb
import pytest

from gleanwork import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    said = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == names
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in said.fetchall()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
