"""Operators on small tables with awkward rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weir.operators import graph as G
from weir.operators import privacy
from weir.operators import relational as R
from weir.operators import text as X
from weir.operators import timeseries as S
from weir.sources import files
from weir.streaming import events as E


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_unnest(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, xs array<string>")
    assert rows(R.unnest(df, "xs", "x", offset="o"), "k", "o", "x") == [(1, 0, "a"), (1, 1, None)]
    assert rows(R.unnest(df, "xs", "x", left=True), "k", "x") == [(1, "a"), (1, None), (2, None), (3, None)] or len(rows(R.unnest(df, "xs", "x", left=True))) == 4
    two = spark.createDataFrame([(1, [1, 2], ["p"])], "k int, xs array<int>, ys array<string>")
    both = {"xs": "a", "ys": "b"}
    assert rows(R.unnest_zip(two, both), "a", "b") == [(1, "p"), (2, None)]
    assert rows(R.unnest_zip(two, both, mode="TRUNCATE", offset="o"), "o", "a", "b") == [(0, 1, "p")]
    with pytest.raises(Exception, match="different lengths"):
        R.unnest_zip(two, both, mode="STRICT").collect()


def test_pivot_counts_nothing_as_zero(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", None, 2), ("y", "b", None)], "k string, p string, v int")
    got = rows(R.pivot(df, ["k"], "p", {"a": "a", "b": "b", "none": None}, {"n": F.count, "s": F.sum}, "v"))
    assert got == [("x", 1, 1, 0, None, 1, 2), ("y", 0, None, 0, None, 0, None)]


def test_set_operators_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2.0)], "s string, d double")
    assert rows(R.union_by_name(a, b, mode="FULL")) == [(1, "x", None), (None, "y", 2.0)]
    assert R.union_by_name(a, b, mode="LEFT").columns == ["i", "s"] and R.union_by_name(a, b, mode="INNER").columns == ["s"]
    with pytest.raises(ValueError):
        R.union_by_name(a, b)


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    seed = spark.createDataFrame([(1,)], "n long")
    reach = R.recursive(seed, lambda r: r.join(edges, r.n == edges.a).select(F.col("b").alias("n")))
    assert rows(reach) == [(1,), (2,), (3,)]


def test_overlap_join_reports_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 25.0), (2, 30.0, 31.0), (3, 5.0, 5.0), (4, -12.0, 3.0)], "a int, a0 double, a1 double")
    b = spark.createDataFrame([(1, 10.0, 40.0), (2, 25.0, 30.0), (3, -20.0, 0.5)], "b int, b0 double, b1 double")
    want = sorted((x.a, y.b) for x in a.collect() for y in b.collect() if x.a0 < y.b1 and y.b0 < x.a1 and x.a0 < x.a1 and y.b0 < y.b1)
    for width in (1.0, 7.0, 1000.0):
        assert rows(R.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), width), "a", "b") == want


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 10), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 5, 50), ("u", 9, None), ("v", 10, 7)], "k string, t int, x int")
    assert rows(R.asof_join(left, right, "t", ["k"], "x"), "id", "x") == [(1, 50), (2, 50), (3, None)]


def test_gap_fill_methods(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([("a", t(0), 0, 1.0), ("a", t(2, 30), 5, None), ("a", t(4), 9, 4.0), ("b", t(1, 10), 1, 1.0), (None, t(3), 2, 2.0), ("a", None, 7, 7.0)], "k string, t timestamp_ntz, i long, x double")
    out = S.gap_fill(df, "t", 1, "HOUR", partition_by=("k",), values={"i": "linear", "x": "locf"})
    got = {(r.k, r.t.hour): (r.i, r.x) for r in out.collect()}
    assert got == {("a", 0): (0, 1.0), ("a", 1): (2, 1.0), ("a", 2): (4, 1.0), ("a", 3): (6, 1.0), ("a", 4): (9, 4.0), (None, 3): (2, 2.0)}
    exact = {(r.k, r.t.hour): r.i for r in S.gap_fill(df, "t", 1, "HOUR", partition_by=("k",), values={"i": "null"}).collect()}
    assert exact == {("a", 0): 0, ("a", 1): None, ("a", 2): None, ("a", 3): None, ("a", 4): 9, (None, 3): 2}


def test_sessions_meet_or_overlap(spark):
    d = lambda n: None if n is None else dt.datetime(2024, 1, n)
    df = spark.createDataFrame([(i, d(a), d(b)) for i, (a, b) in enumerate([(1, 3), (3, 5), (6, 7), (None, 2), (20, None), (None, None), (25, 26)])], "i int, s timestamp_ntz, e timestamp_ntz").withColumn("k", F.lit(1))
    spans = lambda mode: {r.i: (r.session_start and r.session_start.day, r.session_end and r.session_end.day) for r in S.range_sessionize(df, "s", "e", ("k",), mode=mode).collect()}
    meets, over = spans("MEETS"), spans("OVERLAPS")
    assert meets[0] == meets[1] == meets[3] and meets[2] == (6, 7) and meets[5] == (None, None) and meets[4] == meets[6]
    assert over[0] == over[3] and over[1] == (3, 5) and over[0] != over[1]


def test_text_operators(spark):
    df = spark.createDataFrame([(1, "The cat, the DOG! a-b"), (2, None), (3, "")], "k int, t string")
    got = {r[0]: r[1] for r in df.select("k", X.bag_of_words(X.text_analyze("t"))).collect()}
    assert [tuple(x) for x in got[1]] == [("a", 1), ("b", 1), ("cat", 1), ("dog", 1), ("the", 2)] and got[2] is None and got[3] == []
    hit = lambda q: [r[0] for r in df.select(X.search("t", q)).collect()]
    assert hit('"the dog" cat') == [True, None, False] and hit("bird OR dog")[0] and not hit('"dog the"')[0]


def test_paths(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 1, 3, 5.0), (4, 3, 1, 1.0), (5, 2, 2, 1.0)], "id long, s long, d long, c double")
    g = G.Graph({}, {"E": (e, "id", "s", "d")})
    short = {(r.head, r.tail): r.edges for r in G.any_path(g.walk("E", 1, 3, mode="TRAIL", cost="c")).collect()}
    cheap = {(r.head, r.tail): r.edges for r in G.any_path(g.walk("E", 1, 3, mode="TRAIL", cost="c"), "ANY CHEAPEST").collect()}
    assert short[1, 3] == [3] and cheap[1, 3] == [1, 2]
    walks = g.walk("E", 0, 3)
    assert walks.where("size(edges) = 0").count() == 3
    counts = {m: g.walk("E", 3, 3, mode=m).count() for m in ("WALK", "TRAIL", "ACYCLIC")}
    assert counts["WALK"] > counts["TRAIL"] > counts["ACYCLIC"] == 0
    flags = walks.select(G.is_trail(F.col("edges")), G.is_acyclic(F.col("nodes")), G.is_simple(F.col("nodes")), "nodes", "edges").collect()
    for t, a, s, n, x in flags:
        assert t == (len(set(x)) == len(x)) and a == (len(set(n)) == len(n)) and (s or not a)


def test_privacy_bounds_and_threshold(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("u"), F.when(F.col("id") < 3, "rare").otherwise("common").alias("g"), F.lit(1.0).alias("x"))
    out = {r.g: r for r in privacy.dp_aggregate(df, ["g"], "u", epsilon=6.0, delta=1e-6, max_groups=2, count="n", total=("t", "x", 0.0, 2.0), seed=5).collect()}
    assert set(out) == {"common"} and abs(out["common"].n - 1000) < 20 and abs(out["common"].t - 2000) < 40


def test_csv_bad_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\nbad,y\n3,z\n4\n")
    path, schema = f"file://{tmp_path}/x.csv", "a long, b string"
    with pytest.raises(Exception):
        files.read_csv(spark, path, schema).collect()
    with pytest.raises(ValueError, match="2 bad records"):
        files.read_csv(spark, path, schema, max_bad_records=1)
    assert rows(files.read_csv(spark, path, schema, max_bad_records=1, jagged_rows=True)) == [(1, "x"), (3, "z"), (4, None)]
    assert files.read_csv(spark, path).columns == ["a", "b"]
    (tmp_path / "y.json").write_text('{"a": 1}\nnope\n{"a": 2}\n')
    assert rows(files.read_json(spark, f"file://{tmp_path}/y.json", "a long", max_bad_records=1)) == [(1,), (2,)]


def test_hive_keys(spark, tmp_path):
    spark.range(4).selectExpr("id", "concat('0', id % 2) as k").write.partitionBy("k").parquet(f"{tmp_path}/h")
    assert dict(files.read_hive(spark, f"{tmp_path}/h", types="STRINGS").dtypes)["k"] == "string"
    typed = files.read_hive(spark, f"{tmp_path}/h")
    assert dict(typed.dtypes)["k"] == "int" and typed.where("k = 1").count() == 2


def test_stream_appends_once(spark, tmp_path):
    from weir.sources.tables import Catalog

    spark.range(10).selectExpr("id", "id * 2 as v").coalesce(2).write.parquet(f"{tmp_path}/in")
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.create("t", spark.read.parquet(f"{tmp_path}/in").limit(0))
    stream = E.source(spark, f"{tmp_path}/in", per_trigger=1)
    E.append_stream(stream, c, "t", f"{tmp_path}/ck").awaitTermination()
    assert rows(c.read("t")) == [(i, 2 * i) for i in range(10)] or c.read("t").count() == 10
    E.append_stream(stream, c, "t", f"{tmp_path}/ck").awaitTermination()
    assert c.read("t").count() == 10
