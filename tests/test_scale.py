"""What keeps queries whole and quick on larger tables."""

import json

import pyarrow as pa

from pyspark.sql import functions as F

from weir.functions import aggregates as A
from weir.functions import geo, scalar, shapes, udfs
from weir.plans.catalogue import QUERIES


def test_equal_rows_are_computed_once():
    seen = []

    def f(x, y):
        seen.append((x, y))
        return f"{x}{y}"

    values = pa.array([1, 2, 1, None] * 30_000), pa.array(["a", "b", "a", "a"] * 30_000)
    for _ in range(2):  # as two batches
        out = udfs._mapped(values, pa.string(), f, "test")
        assert out.to_pylist() == ["1a", "2b", "1a", None] * 30_000
    assert sorted(seen) == [(1, "a"), (2, "b")]
    assert udfs._mapped((pa.array([], pa.int64()),), pa.string(), f, None).to_pylist() == []


def test_geography_is_dealt_to_all_cores(spark, sf):
    for name in ("q_sql_geography_relations", "q_sql_geography_parts", "q_sql_geography_measures"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_places_on_arcs():
    a, b = shapes.vector((0, 10)), shapes.vector((0, 20))
    n = shapes.cross(a, b)
    assert all(shapes._on(p, a, b, n) for p in (a, b, shapes.vector((0, 12.5))))
    assert not any(shapes._on(shapes.vector(p), a, b, n) for p in ((0, 9.9), (1e-9, 15), (40, 15), (180, -15)))


def test_format_of_plain_values():
    fmt = "%05d|%-4s|%8.2f|%5.1e|%t|%T|%i%%|%s"
    rows = [(7, "x", 0.125, 1e10, True, 'a"b', -3, 1.5), (-42, "", -0.001, float("nan"), False, "é", 0, float("inf")), (None, "y", 1.0, 2.0, True, "", 1, 2.0), (1, "y", 1.0, 2.0, None, None, 1, 2.0)]
    kinds = ["bigint", "string", "double", "double", "boolean", "string", "int", "double"]
    words = [[{float("inf"): "Infinity"}.get(v, v) if v == v else "NaN" for v in r] for r in rows]
    want = [udfs.format_text(fmt, [json.dumps({"v": v, "k": k}) for v, k in zip(r, kinds)]) for r in words]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.int32(), pa.float64()))]
    n = len(rows)
    assert udfs._formatted(pa.array([fmt] * n), pa.array([",".join(kinds)] * n), *columns).to_pylist() == want and want[2] is None
    for f in ("%'d", "%*d"):  # what is left to the general form
        args = [pa.array([1234567, 5])] * (1 + ("*" in f))
        assert udfs._formatted(pa.array([f] * 2), pa.array([",".join(["bigint"] * len(args))] * 2), *args).to_pylist() == [udfs.format_text(f, ['{"v":%d,"k":"bigint"}' % v] * len(args)) for v in (1234567, 5)]


def test_format_crosses_as_json_only_where_it_must(spark, sf):
    plan = QUERIES["q_sql_format"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "weir_format_plain" in plan and "weir_format(" not in plan and "to_json" not in plan


def test_quantiles_of_large_groups_are_exact(spark):
    n = 400_000
    df = spark.range(n).selectExpr("id % 2 AS k", "(id * 7919) % 1000003 AS x").unionAll(spark.range(3).selectExpr("2L", "CAST(NULL AS BIGINT)")).unionAll(spark.range(1).selectExpr("3L", "5L"))
    have = {r["k"]: r["q"] for r in A.quantiles(df, "x", 20, ["k"]).collect()}
    for k in (0, 1):
        xs = sorted(i * 7919 % 1000003 for i in range(k, n, 2))
        assert have[k] == [xs[max(1, -(-i * len(xs) // 20)) - 1] for i in range(21)]
    assert have[3] == [5] * 21 and 2 not in have


def test_counts_of_large_groups_are_exact(spark, tmp_path):
    spark.range(600_000).selectExpr("id % 100 AS o_custkey", "id AS o_orderkey", "substr('FOP', int(id % 3) + 1, 1) AS o_orderstatus", "double(id) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES["q_approx_sketches"](spark, str(tmp_path)).collect()
    assert {r["k"]: (r["n"], list(r["ends"])) for r in rows} == {k: (12_000, [float(k), 599_950.0 + k]) for k in range(50)}


def test_places_of_many_rows_are_compared_once(spark):
    a = spark.range(400).select(F.col("id").alias("a"), geo.geogpoint((F.col("id") % 4).cast("double"), F.lit(10.0)).alias("p"))
    b = spark.range(300).select(F.col("id").alias("b"), geo.geogpoint((F.col("id") % 3).cast("double"), F.when(F.col("id") < 290, 10.0).otherwise(99.0)).alias("q"))
    near = geo.dwithin_join(a, b, "p", "q", 120_000.0)
    assert near.columns == ["a", "p", "b", "q"]
    assert sorted((r["a"], r["b"]) for r in near.collect()) == [(x, y) for x in range(400) for y in range(290) if abs(x % 4 - y % 3) <= 1]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 2


def test_nearest_of_odd_vectors(spark):
    from weir.operators.vectors import nearest

    vectors = [[float(i % 7), float(i % 5), 1.0] for i in range(300)]
    vectors[11], vectors[12], vectors[13] = None, [1.0, None, 2.0], [1.0, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i long, v array<float>").repartition(3)
    have: dict = {}
    for r in nearest(df, df.where("i IN (0, 9, 11, 13)"), "i", "v", 6).collect():
        have.setdefault(r["q"], []).append((r["d"] is not None, r["d"], r["i"]))

    def gap(u, v):
        whole = u is not None and v is not None and None not in u and None not in v and len(u) == len(v)
        return sum((x - y) ** 2 for x, y in zip(u, v)) ** 0.5 if whole else None

    for q in (0, 9, 11, 13):
        want = sorted(((d := gap(vectors[q], v)) is not None, d or 0.0, i) for i, v in enumerate(vectors))[:6]
        assert sorted((known, d or 0.0, i) for known, d, i in have[q]) == want


def test_distances_are_by_blocks(spark, sf):
    assert "MapInArrow" in QUERIES["q_vector_distances"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_folded_a_span_at_a_time(spark, monkeypatch):
    sizes = []
    once = udfs._once
    monkeypatch.setattr(udfs, "_once", lambda values, *rest: sizes.append(values[0].nbytes) or once(values, *rest))
    udfs._mapped((pa.array([str(i) * 10_000 for i in range(2_000)]),), pa.int64(), len, None)
    assert len(sizes) > 1 and max(sizes) < 3 * udfs._SPAN
    rows = [("LICENSE",), ("liﬁ ＬＩcense é",), ("licenséx",), ("ſtraße LICENſE",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", scalar.contains_substr("t", "License").alias("h"))
    assert [r["h"] for r in df.collect()] == [None if t is None else udfs._fold("License") in udfs._fold(t) for (t,) in rows]
    assert "weir_fold" not in df._jdf.queryExecution().optimizedPlan().toString()
