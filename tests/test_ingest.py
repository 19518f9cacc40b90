"""Row ingestion, sessions, write streams, routines."""

import pytest

from weir.functions.routines import MaterializedView, python_udf, sql_function, table_function
from weir.sources.ingest import WriteStream, commit_streams, insert_all, list_rows, read_session
from weir.sources.tables import Catalog


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("t", spark.createDataFrame([], "k long, s string, b boolean, d date, a array<long>, r struct<x:double>"))
    return c


def test_insert_all(catalog):
    good = {"k": "7", "s": 5, "b": "true", "d": "2024-02-29", "a": [1, None], "r": {"x": 2}}
    errors = insert_all(catalog, "t", [good, {"k": 1.5}, {"zz": 1}, {"d": "no"}])
    assert [e["index"] for e in errors] == [1, 2, 3] and catalog.read("t").count() == 0
    insert_all(catalog, "t", [good, {"k": 1.5}], skip_invalid=True)
    insert_all(catalog, "t", [{"k": 9, "zz": 1}], ignore_unknown=True)
    assert sorted(r["k"] for r in list_rows(catalog, "t")) == [7, 9]
    assert list_rows(catalog, "t", start=1, most=5, columns=["k"])[0].keys() == {"k"}


def test_read_session_is_one_version(spark, catalog):
    catalog.insert("t", spark.range(50).selectExpr("id as k"))
    parts = read_session(catalog, "t", columns=["k"], restriction="k < 30", streams=3)
    catalog.truncate("t")
    assert sorted(r.k for p in parts for r in p.collect()) == list(range(30))
    assert "PushedFilters: [IsNotNull(k), LessThan(k,30)]" in parts[0]._jdf.queryExecution().toString()


def test_write_streams(spark, catalog):
    rows = lambda a, b: spark.range(a, b).selectExpr("id as k")
    s = WriteStream(catalog, "t")
    assert s.append(rows(0, 3), 0) == 3
    with pytest.raises(ValueError):
        s.append(rows(0, 3), 0)
    b = WriteStream(catalog, "t", "BUFFERED")
    b.append(rows(3, 5))
    assert catalog.read("t").count() == 3
    b.flush()
    p, q = WriteStream(catalog, "t", "PENDING"), WriteStream(catalog, "t", "PENDING")
    p.append(rows(5, 7)), q.append(rows(7, 10))
    with pytest.raises(ValueError):
        commit_streams([p, q])
    p.finalize(), q.finalize()
    before = catalog._now("t")["version"]
    commit_streams([p, q])
    assert catalog._now("t")["version"] == before + 1 and sorted(r.k for r in catalog.read("t").select("k").collect()) == list(range(10))


def test_routines(spark):
    python_udf(spark, "shout", "def f(x):\n    return None if x is None else x.upper() + '!'", "f", "string")
    sql_function(spark, "twice", "x BIGINT", "x * 2")
    table_function(spark, "upto", "n BIGINT", "i BIGINT", "SELECT id FROM range(10) WHERE id < n")
    assert spark.sql("SELECT shout('a') AS s, twice(4) AS t").first()[:] == ("A!", 8)
    assert spark.sql("SELECT sum(i) FROM upto(4)").first()[0] == 6
    seen = []
    view = MaterializedView(lambda: seen.append(1) or spark.range(2))
    assert view.read().count() == view.read().count() == 2 and len(seen) == 2
