"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from recallgrid import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert len(at) == len(rel.columns)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


#: No facts are similar enough in the smallest tables; test_functions.py has rows of its own for it.
EMPTY_HERE = {"backlog_apply"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - EMPTY_HERE))
def test_rows_only(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0
