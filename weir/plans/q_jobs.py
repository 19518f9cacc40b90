"""Queries of jobs: loads, extracts, ingestion, read sessions, write streams, scripts, routines, streams of events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import crypto, routines
from ..functions import temporal as T
from ..operators import graph as G
from ..session import checkpoint_dir, table, views
from ..sources import files
from ..sources.ingest import WriteStream, commit_streams, insert_all, list_rows, read_session
from ..sources.tables import Catalog
from .catalogue import query
from .dialect import Session
from .q_relational import _trade


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _catalog(spark) -> Catalog:
    return Catalog(spark, _folder(spark, "catalog"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS s FROM orders")
def q_load_json(spark, d):
    """Extracted as compressed NDJSON, loaded with a schema."""
    path = _folder(spark, "json")
    files.extract(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("s")), path, "json", compression="gzip")
    return files.read_json(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, s string")


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice, p_name, p_size > 20 AS big, DATE '2024-01-01' + p_size AS day FROM part")
def q_load_autodetect(spark, d):
    """CSV whose types are detected."""
    path = _folder(spark, "csv")
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", (F.col("p_size") > 20).alias("big"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("day"))
    files.extract(p, path, "csv")
    got = files.read_csv(spark, path)
    return got.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"), "p_retailprice", "p_name", "big", "day")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 3 = 1 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 3 = 2")
def q_load_parquet_merged(spark, d):
    """Parquet files of two schemas under one folder."""
    path, o = _folder(spark, "parquet"), table(spark, d, "orders")
    o.where("o_custkey % 3 = 1").select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/a")
    o.where("o_custkey % 3 = 2").select("o_orderkey").write.parquet(f"{path}/b")
    return files.read_parquet(spark, f"{path}/*", merge=True).select("o_orderkey", "o_orderstatus")


@query("SELECT n_regionkey, count(*) * 2 AS n FROM nation GROUP BY n_regionkey")
def q_destination_table(spark, d):
    """A query's destination: written, appended to, then read."""
    name = f"weir_{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_regionkey")
    files.write_table(n, name, "WRITE_EMPTY")
    files.write_table(n, name, "WRITE_APPEND", create=False)
    out = spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n")).collect()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(out, "n_regionkey long, n long")


@query("SELECT n_nationkey AS k, n_name AS s, n_nationkey % 2 = 0 AS b FROM nation")
def q_insert_all(spark, d):
    """Rows as a client sends them, those that don't fit left out, listed in pages."""
    c = _catalog(spark)
    c.create("t", spark.createDataFrame([], "k long, s string, b boolean").schema)
    rows = [{"k": str(r.n_nationkey), "s": r.n_name, "b": "true" if r.n_nationkey % 2 == 0 else "false"} for r in table(spark, d, "nation").collect()]
    errors = insert_all(c, "t", [*rows, {"k": 1.5}, {"zz": 1}], skip_invalid=True)
    if [e["index"] for e in errors] != [len(rows), len(rows) + 1]:
        raise AssertionError(errors)
    pages = [r for start in range(0, len(rows), 10) for r in list_rows(c, "t", start=start, most=10)]
    return spark.createDataFrame([(r["k"], r["s"], r["b"]) for r in pages], "k long, s string, b boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def q_read_session(spark, d):
    """The parts of a read session, while the table goes on changing."""
    c = _catalog(spark)
    c.create("o", table(spark, d, "orders"))
    parts = read_session(c, "o", columns=["o_orderkey", "o_totalprice"], restriction="o_orderstatus = 'F' AND o_totalprice > 100000", streams=4)
    c.truncate("o")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
def q_write_streams(spark, d):
    """Committed, buffered and pending streams; a retried append adds nothing."""
    c, o = _catalog(spark), table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    c.create("t", o.schema)
    a, b = WriteStream(c, "t"), WriteStream(c, "t", "BUFFERED")
    done = a.append(o.where("s = 'F'"), 0)
    try:
        a.append(o.where("s = 'F'"), 0)
    except ValueError:
        done += 0
    b.append(o.where("s = 'O' AND o_orderkey % 2 = 0"))
    b.flush()
    pending = [WriteStream(c, "t", "PENDING") for _ in range(2)]
    pending[0].append(o.where("s = 'O' AND o_orderkey % 2 = 1"))
    pending[1].append(o.where("s = 'P'"))
    for p in pending:
        p.finalize()
    commit_streams(pending)
    return c.read("t").groupBy("s").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS b, (SELECT count(*) FROM nation) AS c, (SELECT count(*) FROM region) AS d")
def q_transactions(spark, d):
    """A transaction that is rolled back, one that is committed, a table put back to an older version."""
    views(spark, d, ["nation", "region"])
    s = Session(spark, _catalog(spark))
    s.run("CREATE TABLE n AS SELECT * FROM nation; CREATE TABLE r AS SELECT * FROM region; BEGIN TRANSACTION; DELETE FROM n WHERE n_regionkey = 1; DELETE FROM r WHERE r_regionkey >= 0; ROLLBACK TRANSACTION")
    a, r = s.value("(SELECT COUNT(*) FROM n)"), s.value("(SELECT COUNT(*) FROM r)")
    s.run("BEGIN TRANSACTION; DELETE FROM n WHERE n_regionkey = 1; COMMIT TRANSACTION")
    b = s.value("(SELECT COUNT(*) FROM n)")
    s.catalog.restore("n", 1)
    return s.query("SELECT @a AS a, @b AS b, COUNT(*) AS c, @r AS d FROM n", a=a, b=b, r=r)


@query("SELECT CAST(sum(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -n_nationkey END) AS BIGINT) + 3 + 7 + 1000 + 42 AS total, 'caught: boom' AS said FROM nation")
def q_script_control(spark, d):
    """FOR, IF, CASE, LOOP, REPEAT, exceptions, EXECUTE IMMEDIATE and a procedure."""
    views(spark, d, ["nation"])
    return Session(spark).run("""DECLARE total INT64 DEFAULT 0; DECLARE i INT64 DEFAULT 0; DECLARE said STRING DEFAULT '';
        FOR r IN (SELECT n_nationkey AS k FROM nation) DO IF MOD(r.k, 2) = 0 THEN SET total = total + r.k; ELSE SET total = total - r.k; END IF; END FOR;
        LOOP SET i = i + 1; IF i = 3 THEN BREAK; END IF; END LOOP;
        SET total = total + i;
        REPEAT SET i = i + 2; UNTIL i >= 7 END REPEAT;
        SET total = total + i;
        BEGIN RAISE USING MESSAGE = 'boom'; EXCEPTION WHEN ERROR THEN SET total = total + 1000; SET said = CONCAT('caught: ', error_message); END;
        EXECUTE IMMEDIATE 'SELECT 1';
        CREATE PROCEDURE plus(a INT64) BEGIN SET total = total + a; END;
        CALL plus(42);
        SELECT total AS total, said AS said""")


@query("SELECT n_nationkey, upper(n_name) || '!' AS loud, n_nationkey * 2 AS twice, (SELECT count(*) FROM region WHERE r_regionkey < n_regionkey) AS below FROM nation")
def q_routines(spark, d):
    """A Python function from its source, a SQL function, a SQL table function."""
    views(spark, d, ["nation", "region"])
    routines.python_udf(spark, "weir_loud", "def f(x):\n    return None if x is None else x.upper() + '!'", "f", "string")
    routines.sql_function(spark, "weir_twice", "x BIGINT", "x * 2")
    routines.table_function(spark, "weir_below", "n BIGINT", "r BIGINT", "SELECT r_regionkey FROM region WHERE r_regionkey < n")
    return spark.sql("SELECT n_nationkey, weir_loud(n_name) AS loud, weir_twice(n_nationkey) AS twice, (SELECT count(*) FROM weir_below(n_regionkey)) AS below FROM nation")


@query("SELECT n_regionkey, count(*) AS n, 1::BIGINT AS v FROM nation GROUP BY n_regionkey UNION ALL SELECT n_regionkey, count(*) AS n, 2::BIGINT AS v FROM nation WHERE n_nationkey >= 5 GROUP BY n_regionkey")
def q_views(spark, d):
    """A view, and a materialised view that is never stale."""
    views(spark, d, ["nation"])
    s = Session(spark, _catalog(spark))
    s.run("CREATE TABLE n AS SELECT * FROM nation; CREATE VIEW weir_counts AS SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
    kept = routines.MaterializedView(lambda: s.query("SELECT n_regionkey, COUNT(*) AS n FROM n GROUP BY n_regionkey"))
    kept.read().count()
    s.execute("DELETE FROM n WHERE n_nationkey < 5")
    return s.query("SELECT n_regionkey, n, CAST(1 AS INT64) AS v FROM weir_counts").unionAll(kept.read().select("n_regionkey", "n", F.lit(2).cast("long").alias("v")))


@query(
    """SELECT event_type, h + INTERVAL (30 * k) MINUTE AS start, count(*) AS n, round(sum(value), 3) AS v FROM (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS h, unnest([0, 1]) AS k FROM events) GROUP BY ALL"""
)
def q_stream_sliding(spark, d):
    """Windows of an hour every half hour, from a stream of the file run to its end."""
    from ..streaming.events import sliding

    return sliding(spark, f"{d}/events.parquet", "1 hour", "30 minutes").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("v", 3).alias("v"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS once FROM events GROUP BY event_type")
def q_stream_append(spark, d):
    """A stream appended to a table twice from one checkpoint: every row is there once."""
    from ..streaming.events import append_stream, watched

    c, checkpoint = _catalog(spark), _folder(spark, "checkpoint")
    c.create("e", spark.read.parquet(f"{d}/events.parquet").schema)
    for _ in range(2):
        append_stream(watched(spark, f"{d}/events.parquet"), c, "e", checkpoint).awaitTermination()
    return c.read("e").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("once"))


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def q_stream_stateful(spark, d):
    """Running counts and maxima kept as each user's state."""
    from ..streaming.events import running

    return running(spark, f"{d}/events.parquet").select("user_id", "n", "top")


@query("SELECT o_orderkey, 1::BIGINT AS m1, 4 + (o_custkey % 50 * 5) // 24 AS d1, (o_custkey % 50 * 5) % 24 * 3600000000 AS u1, 1 + (28 + (o_custkey % 50 * 5) // 24) // 30 AS m2, (28 + (o_custkey % 50 * 5) // 24) % 30 AS d2, strftime(o_orderdate + INTERVAL 22 HOUR, '%H:%M:%S') AS ts FROM orders")
def q_justify(spark, d):
    """JUSTIFY_HOURS, JUSTIFY_INTERVAL and TIME_SUB."""
    hours = F.col("o_custkey") % 50 * 5
    a, b = T.justify_hours(T.make_interval(months=1, days=4, hours=hours)), T.justify_interval(T.make_interval(months=1, days=28, hours=hours))
    back = T.format_time(T.time_add(T.time_of("o_orderdate"), -2, "HOUR"))
    return table(spark, d, "orders").select("o_orderkey", a["months"].alias("m1"), a["days"].alias("d1"), a["micros"].alias("u1"), b["months"].alias("m2"), b["days"].alias("d2"), back.alias("ts"))


@query("SELECT p_brand, count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS ciphers, true AS back, 2::BIGINT AS keys FROM part GROUP BY p_brand")
def q_aead_deterministic(spark, d):
    """Equal texts have equal ciphers, different ones different ones; keysets go to JSON and back."""
    keys = crypto.keyset_from_json(crypto.keyset_to_json(crypto.rotate_keyset(crypto.add_key(crypto.new_keyset("DETERMINISTIC_AEAD_AES_SIV_CMAC_256"), bytes(range(32))))))
    p = table(spark, d, "part").withColumn("c", crypto.deterministic_encrypt(keys, F.col("p_name"), F.lit("x")))
    p = p.withColumn("b", crypto.deterministic_decrypt_string(keys, F.col("c"), F.lit("x")))
    return p.groupBy("p_brand").agg(F.countDistinct("p_name").alias("names"), F.countDistinct("c").alias("ciphers"), F.bool_and(F.col("b") == F.col("p_name")).alias("back"), F.lit(crypto.keyset_length(keys) - 1).cast("long").alias("keys"))


_FLOWS = "e AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query(f"WITH {_FLOWS}, p AS (SELECT a, b, w FROM e UNION ALL SELECT x.a, y.b, x.w + y.w FROM e x JOIN e y ON x.b = y.a) SELECT a AS head, b AS tail, min(w) AS cost FROM p GROUP BY ALL")
def q_graph_any_cheapest(spark, d):
    """The cheapest walk of one or two edges for each pair, with no more than one kept for a pair after each hop."""
    g = _trade(spark, d)
    return g.best("Sells", 1, 2, cost="n").select("head", "tail", "cost")


@query(f"WITH {_FLOWS} SELECT x.a AS first, y.b AS last, x.a <> x.b AND y.a <> y.b AND x.a <> y.b AS acyclic, x.a <> x.b OR y.a <> y.b AS trail, count(*) AS n, 2::BIGINT AS len FROM e x JOIN e y ON x.b = y.a GROUP BY ALL")
def q_graph_path_functions(spark, d):
    p = _trade(spark, d).walk("Sells", 2, 2)
    nodes, edges = F.col("nodes"), F.col("edges")
    return p.select(G.path_first(nodes).alias("first"), G.path_last(nodes).alias("last"), G.is_acyclic(nodes).alias("acyclic"), G.is_trail(edges).alias("trail"), G.path_length(edges).alias("len")).groupBy("first", "last", "acyclic", "trail", "len").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name < 'AS'")
def q_graph_optional_match(spark, d):
    return _trade(spark, d).match(("Nation", None), "In", ("Region", F.col("r_name") < "AS"), optional=True).select(F.col("a_n_name").alias("n_name"), F.col("b_r_name").alias("r_name"))
