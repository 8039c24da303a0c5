"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from attestra.plans import answer_queries, book, catalog_queries, evidence_queries, more_queries, stream_queries, structure_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(book.QUERIES))
def test_query(spark, duck, name):
    df = book.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in book.ORACLE:
        assert rows
        return
    cursor = duck.execute(book.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
