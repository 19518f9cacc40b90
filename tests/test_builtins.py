"""Functions of the dialect from SQL text, by values that its documentation and arithmetic give."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weir.functions.udfs import farm_fingerprint
from weir.plans.dialect import Session
from weir.sources.tables import Catalog, Conflict

VALUES = {
    "DIV(9007199254740993, 1)": 9007199254740993, "CEIL(CAST('1e300' AS FLOAT64))": 1e300, "FLOOR(CAST('1e19' AS FLOAT64))": 1e19, "FLOOR(-2.5)": -3, "JSON_VALUE('{\"a\":\"[x\"}', '$.a')": "[x", "CONTAINS_SUBSTR('the ﬁne', 'FINE')": True,
    "INSTR('banana', 'a', -1)": 6, "INSTR('banana', 'an', -3)": 4, "INSTR('banana', 'an', 1, 2)": 4, "DATETIME_DIFF(DATETIME '9999-12-31 23:59:59.999999', DATETIME '9999-12-31 23:59:59.998', MILLISECOND)": 1,
    "TO_BASE32(b'abcde\\xff')": "MFRGGZDF74======", "FARM_FINGERPRINT('1footrue')": -1541654101129638711, "SOUNDEX('Robert')": "R163", "SAFE.DIV(1, 0)": None, "SAFE.LOG(-1.0)": None, "SAFE.PARSE_DATE('%Y', 'x')": None,
    "FORMAT('%T|%t|%\\'d|%5.1f|%-4s|', 'q', [1, 2], 1234567, 2.25, 'ab')": '"q"|[1, 2]|1,234,567|  2.2|ab  |', "FORMAT('%t', DATE '2024-02-03')": "2024-02-03", "CAST(DATE '2024-02-03' AS STRING FORMAT 'DD Mon YYYY')": "03 Feb 2024",
    "SAFE_CAST('x' AS DATE FORMAT 'YYYY')": None, "TRUNC(NUMERIC '12345678901234567890.123456789', 9)": Decimal("12345678901234567890.123456789"), "LAX_INT64('\"12\"')": 12, "JSON_QUERY_ARRAY('[1,{\"a\":2}]')": ["1", '{"a":2}'],
    "ARRAY(SELECT x FROM UNNEST([3, 1, 2]) AS x ORDER BY x DESC LIMIT 2)": [3, 2], "2 IN UNNEST([1, 2])": True, "NORMALIZE_AND_CASEFOLD('Éﬁ', NFKC)": "éfi", "DATE_BUCKET(DATE '2024-01-10', INTERVAL 1 MONTH)": dt.date(2024, 1, 1),
    "EXTRACT(WEEK FROM DATE '2024-01-07')": 1, "LAST_DAY(DATE '2024-02-03', QUARTER)": dt.date(2024, 3, 31), "NET.REG_DOMAIN('http://a.b.co.uk/x')": "b.co.uk", "PARSE_NUMERIC('1,234.5') + 0": Decimal("1234.5"), "0x1F": 31,
}


@pytest.fixture(scope="module")
def s(spark):
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "false")
    yield Session(spark)
    spark.conf.unset("spark.sql.decimalOperations.allowPrecisionLoss")


@pytest.mark.parametrize("text", VALUES)
def test_values(s, text):
    got = s.query(f"SELECT {text} AS v").first()[0]
    want = VALUES[text]
    assert got == want and (want is None or not isinstance(want, str) or isinstance(got, str))


@pytest.mark.parametrize("text", ["ACOS(2.0)", "LN(0.0)", "ARRAY_FIRST(ARRAY_SLICE([1], 3, 4))", "ERROR('no')", "PARSE_JSON('{')"])
def test_errors(s, text):
    with pytest.raises(Exception):  # noqa: B017
        s.query(f"SELECT {text} AS v").collect()


def test_fingerprints_of_all_lengths_differ():
    found = {farm_fingerprint(bytes(range(n))) for n in range(200)}
    assert len(found) == 200 and farm_fingerprint(b"2applefalse") == 2794438866806483259


def files(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*.parquet"))


def test_appends_and_changes_write_only_what_they_must(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("t", spark.range(100).repartitionByRange(10, "id"))
    before = files(tmp_path)
    assert c.insert("t", spark.range(100, 103)) == 3
    new = set(files(tmp_path)) - set(before)
    assert sum(spark.read.parquet(f"{tmp_path}/{f}").count() for f in new) == 3
    before = files(tmp_path)
    assert c.delete("t", F.col("id") == 5) == 1
    new = set(files(tmp_path)) - set(before)
    assert sum(spark.read.parquet(f"{tmp_path}/{f}").count() for f in new) < 20
    assert sorted(r[0] for r in c.read("t").collect()) == [x for x in range(103) if x != 5]
    assert c.read("t", version=1).count() == 100 and c.restore("t", 1) == 4 and c.read("t").count() == 100


def test_a_dead_writer_stops_nobody(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("t", spark.range(3))
    (tmp_path / "c" / "t" / "manifests" / "_dead.tmp").write_text('{"version": 2, "sch')
    assert c.insert("t", spark.range(2)) == 2 and c.read("t").count() == 5
    with pytest.raises(Conflict):
        c._commit("t", 1, c.read("t").schema, [], {})


def test_columns_and_options(spark, tmp_path):
    s = Session(spark, Catalog(spark, f"file://{tmp_path}/c"))
    s.run("CREATE TABLE t (k INT64 NOT NULL, v STRING DEFAULT 'x', d DATE) PARTITION BY d OPTIONS (partition_expiration_days = 3); INSERT INTO t (k, d) VALUES (1, CURRENT_DATE()), (2, DATE '2020-01-01')")
    assert [tuple(r)[:2] for r in s.query("SELECT * FROM t").collect()] == [(1, "x")]  # the other's partition is past its time
    with pytest.raises(Exception):  # noqa: B017
        s.execute("INSERT INTO t (v) VALUES ('y')")
    s.run("ALTER TABLE t ALTER COLUMN v SET DEFAULT 'z'; ALTER TABLE t ALTER COLUMN k DROP NOT NULL; ALTER TABLE t RENAME COLUMN v TO w; INSERT INTO t (d) VALUES (CURRENT_DATE())")
    assert s.row_count == 1 and s.query("SELECT COUNT(*) AS n, COUNT(k) AS k FROM t").first()[:] == (2, 1)
    s.catalog.set_column("t", "k", kind="double")
    assert dict(s.query("SELECT * FROM t").dtypes)["k"] == "double"
    spark.range(4).write.parquet(f"{tmp_path}/ext")
    s.execute(f"CREATE EXTERNAL TABLE e OPTIONS (format = 'PARQUET', uris = ['file://{tmp_path}/ext'])")
    assert s.query("SELECT COUNT(*) AS n FROM e").first()[0] == 4
    s.run("CREATE SCHEMA a; DROP SCHEMA a; DROP SCHEMA IF EXISTS a")
    assert s.catalog.schemas() == []
