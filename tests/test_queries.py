"""Every query that SQL expresses gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from folio.plans import catalogue

DATA = os.environ.get("FOLIO_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "-"
    return repr(round(float(value), 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    rows = got.collect()
    assert rows
    if name not in catalogue.ORACLE_SQL:
        return
    columns = sorted(got.columns)
    found = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_capitals_of_several_letters(spark, tmp_path):
    texts = ["\u00dfheit. \u00df", "\ufb01ne", "\u1f80\u1f80", "\u1f88", "\u0149", "\u0264", "\u01c6", "\u00e9t\u00e9. a", "x", "", None]
    texts += [chr(c) for c in range(0x20, 0x3000)] + [chr(c) for c in range(0xA640, 0xD800)] + [chr(c) for c in range(0xF900, 0x11000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in catalogue.QUERIES["capitalize"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = dict(duck.sql(catalogue.ORACLE_SQL["capitalize"]).fetchall())
    assert [(texts[i][:9], got[i], w) for i, w in wanted.items() if got[i] != w] == []
    assert len(got) == len(wanted) == len(texts)


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
