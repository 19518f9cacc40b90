"""Queries of managed tables and files: each makes its table in the shared scratch folder, changes it, and reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import privacy
from ..session import checkpoint_dir, table, views
from ..sources import files
from ..sources.tables import Catalog, When
from .catalogue import query
from .dialect import Session


def _catalog(spark) -> Catalog:
    return Catalog(spark, f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT o_totalprice < 50000")
def q_update_delete_effect(spark, d):
    c = _catalog(spark)
    c.create("orders", table(spark, d, "orders"))
    c.delete("orders", F.col("o_totalprice") < 50000)
    c.update("orders", {"o_totalprice": F.col("o_totalprice") * 2}, F.col("o_orderstatus") == "F")
    return c.read("orders").select("o_orderkey", "o_totalprice")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 1 AND c_custkey % 3 <> 0
       UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 10 < 2 AND c_custkey % 3 = 0
       UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 > 1 AND c_custkey % 3 = 0"""
)
def q_merge_effect(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    cat = _catalog(spark)
    cat.create("t", cust)
    k = F.col("c_custkey")
    # of the source's rows those divisible by three but not matched are new ones
    src = cust.where("c_custkey % 10 < 2").select(F.when(k % 3 == 0, k + 1000000).otherwise(k).alias("k"), F.col("c_acctbal").alias("v"))
    cat.delete("t", (k % 3 == 0) & (k % 10 < 2))
    cat.merge("t", src, F.col("t_c_custkey") == F.col("s_k"), [
        When("matched", "delete", F.col("s_k") % 10 == 1),
        When("matched", "update", values={"c_acctbal": F.lit(0.0)}),
        When("not_matched", "insert", values={"c_custkey": F.col("s_k"), "c_acctbal": F.col("s_v")}),
        When("not_matched_by_source", "update", F.col("t_c_custkey") % 3 == 0, {"c_acctbal": F.col("t_c_acctbal") + 1}),
    ])
    return cat.read("t")


@query("SELECT (SELECT count(*) FROM nation) AS v1, (SELECT count(*) FROM nation) * 2 AS v2, 0 AS v3, (SELECT count(*) FROM nation) AS snap")
def q_time_travel(spark, d):
    c, n = _catalog(spark), table(spark, d, "nation")
    c.create("n", n, at=100.0)
    c.clone("snap", "n")
    c.insert("n", n, at=200.0)
    c.truncate("n")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(c.read("n", as_of=150.0), "v1").crossJoin(one(c.read("n", as_of=200.0), "v2"))
    return out.crossJoin(one(c.read("n"), "v3")).crossJoin(one(c.read("snap"), "snap"))


@query(
    """SELECT CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS BIGINT) AS deleted, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS BIGINT) AS updated, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS BIGINT) AS inserted,
       (SELECT round(sum(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN o_totalprice + 1 ELSE o_totalprice END), 2) FROM orders) AS total, (SELECT count(*) FROM orders) AS n, 'open' AS note"""
)
def q_sql_dml(spark, d):
    """DML from SQL text: rows touched by each statement, NOT NULL and DEFAULT columns, what is there in the end."""
    views(spark, d, ["orders"])
    s = Session(spark, _catalog(spark))
    counts = []
    for text in (
        "CREATE TABLE o (k INT64 NOT NULL, s STRING, p FLOAT64, note STRING DEFAULT 'open')",
        "INSERT INTO o (k, s, p) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
        "DELETE FROM o WHERE s = 'F'", "UPDATE o SET p = p + 1 WHERE s = 'O' AND p > 100000",
        "INSERT INTO o (k, s, p) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    ):
        s.execute(text)
        counts.append(s.row_count)
    return s.query("SELECT @deleted AS deleted, @updated AS updated, @inserted AS inserted, ROUND(SUM(p), 2) AS total, COUNT(*) AS n, MIN(note) AS note FROM o", deleted=counts[2], updated=counts[3], inserted=counts[4])


@query(
    """SELECT * FROM (VALUES ('COLUMN', 't.k', 'NO'), ('COLUMN', 't.d', 'YES'), ('COLUMN', 't.label', 'YES'), ('COLUMN', 'u.k', 'YES'), ('COLUMN', 'u.d', 'YES'), ('COLUMN', 'u.label', 'YES'), ('OPTION', 't.partition_by', NULL), ('OPTION', 't.partition_kind', NULL), ('OPTION', 't.read_as', NULL), ('PARTITION', 't', NULL),
       ('SCHEMA', 'mart', NULL), ('TABLE', 't', 'BASE TABLE'), ('TABLE', 'u', 'BASE TABLE')) AS v(kind, name, what)"""
)
def q_sql_information_schema(spark, d):
    s = Session(spark, _catalog(spark))
    for text in (
        "CREATE SCHEMA mart", "CREATE TABLE t (k INT64 NOT NULL, d DATE, name STRING) PARTITION BY d", "INSERT INTO t VALUES (1, DATE '2024-01-01', 'a'), (2, DATE '2024-01-02', 'b')",
        "ALTER TABLE t RENAME COLUMN name TO label", "CREATE TABLE v LIKE t", "ALTER TABLE v RENAME TO u",
    ):
        s.execute(text)
    return s.query("""SELECT 'TABLE' AS kind, table_name AS name, table_type AS what FROM INFORMATION_SCHEMA.TABLES UNION ALL SELECT 'COLUMN', CONCAT(table_name, '.', column_name), is_nullable FROM INFORMATION_SCHEMA.COLUMNS UNION ALL SELECT 'SCHEMA', schema_name, NULL FROM INFORMATION_SCHEMA.SCHEMATA
        UNION ALL SELECT DISTINCT 'PARTITION', table_name, NULL FROM INFORMATION_SCHEMA.PARTITIONS UNION ALL SELECT 'OPTION', CONCAT(table_name, '.', option_name), NULL FROM INFORMATION_SCHEMA.TABLE_OPTIONS""")


@query("SELECT 'n' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey', 'note']) AS column_name")
def q_information_schema(spark, d):
    c = _catalog(spark)
    c.create("n", table(spark, d, "nation"))
    c.add_column("n", "note", "string")
    return c.columns().select("table_name", "column_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_csv_round_trip(spark, d):
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.extract(table(spark, d, "nation"), path, "csv", compression="gzip")
    return files.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def q_hive_partitions(spark, d):
    path = f"{checkpoint_dir(spark)}/hive-{uuid.uuid4().hex}"
    table(spark, d, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return files.read_hive(spark, path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def q_differential_privacy(spark, d):
    """Counts of users by event, with so much privacy spent that the noise rounds away; what is left are the bounds on groups and the threshold."""
    return privacy.dp_aggregate(table(spark, d, "events"), ["event_type"], "user_id", epsilon=1e9, delta=0.01, max_groups=10, count="n", seed=1)
