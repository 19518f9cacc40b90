"""Queries of text analysis and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import udfs as U
from ..operators import text as X
from ..session import table
from .catalogue import query

_TERMS = "SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part"


@query(
    f"""WITH t AS ({_TERMS}), n AS (SELECT p_partkey, term, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM n GROUP BY ALL HAVING count(*) >= 5),
    i AS (SELECT term, ln(1 + (SELECT count(*) FROM part) / (1 + df)) AS idf FROM f), s AS (SELECT p_partkey, sum(n) AS total FROM n GROUP BY ALL)
    SELECT n.p_partkey, i.term, round(sum(n.n) / s.total * coalesce(i.idf, (SELECT avg(idf) FROM i), 0), 6) AS tf_idf FROM n JOIN s USING (p_partkey) LEFT JOIN i USING (term) GROUP BY n.p_partkey, i.term, s.total, i.idf"""
)
def q_tf_idf(spark, d):
    p = table(spark, d, "part").select("p_partkey", S.split(F.lower("p_name"), " ").alias("terms"))
    return X.tf_idf(p, "p_partkey", "terms").withColumn("tf_idf", F.round("tf_idf", 6))


@query(f"SELECT p_partkey, list({{'term': term, 'count': n}} ORDER BY term) AS bag FROM (SELECT p_partkey, term, count(*) AS n FROM ({_TERMS}) GROUP BY ALL) GROUP BY p_partkey")
def q_bag_of_words(spark, d):
    return table(spark, d, "part").select("p_partkey", X.bag_of_words(X.text_analyze("p_name")).alias("bag"))


@query("SELECT doc_id, contains(' ' || regexp_replace(lower(text), '[\\s\\[\\]<>(){}|!;,''\"*&?+/:=@.\\-$%\\\\_]+', ' ', 'g') || ' ', ' rights reserved ') OR contains(' ' || regexp_replace(lower(text), '[\\s\\[\\]<>(){}|!;,''\"*&?+/:=@.\\-$%\\\\_]+', ' ', 'g') || ' ', ' apache ') AS hit FROM documents")
def q_search(spark, d):
    return table(spark, d, "documents").select("doc_id", X.search("text", '"rights reserved" OR apache').alias("hit"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]{2,}')) AS BIGINT) AS n, contains(lower(text), 'license') AS has FROM documents")
def q_regexp_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", S.array_length(S.regexp_extract_all(F.lower("text"), "[a-z]{2,}")).alias("n"), S.contains_substr("text", "LICENSE").alias("has"))


@query("SELECT doc_id, CAST(length(nfc_normalize(text)) AS BIGINT) AS n FROM documents")
def q_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(U.normalize("NFC")("text")).cast("long").alias("n"))
