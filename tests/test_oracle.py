"""Every registered query of the engine against its SQL."""

import datetime
import math

import duckdb
import pytest

from weir.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, dict):
        return {k: norm(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return norm(x.asDict())
    if isinstance(x, (list, tuple)):
        return [norm(v) for v in x]
    return bytes(x) if isinstance(x, (bytearray, memoryview)) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    have = sorted(str(norm([r[c] for c in cols])) for r in df.collect())
    if name not in ORACLE:
        return
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str(norm([r[i] for i in at])) for r in rel.fetchall())
    assert len(have) == len(want)
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    assert not bad, f"{len(bad)} of {len(want)}: {bad[:3]}"
