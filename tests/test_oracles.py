"""Every registered takeoff query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import catalog
from plumbline.sources.synth import BASE


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    r = con.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    got = sorted(tuple(plain(row[x]) for x in cols) for row in df.collect())
    assert got and got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(1).count() == 1


def test_the_rest_does_not_need_llm():
    import pathlib

    top = pathlib.Path(__file__).parents[1] / "plumbline"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "plumbline.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
