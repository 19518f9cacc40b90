"""Text analysis: TEXT_ANALYZE, BAG_OF_WORDS, TF_IDF, SEARCH."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Value, col

#: What separates terms in log text.
LOG_DELIMITERS = r"[\s\[\]<>(){}|!;,'\"*&?+/:=@.\-$%\\_]+"


def text_analyze(x: Value, analyzer: str = "LOG_ANALYZER", *, stop_words: tuple[str, ...] = (), pattern: str = r"\b\w{2,}\b") -> Column:
    """The text's terms, lower-cased but for NO_OP."""
    x = col(x)
    if analyzer == "NO_OP_ANALYZER":
        return F.array(x)
    terms = F.split(F.lower(x), LOG_DELIMITERS) if analyzer == "LOG_ANALYZER" else F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))
    return F.filter(terms, lambda t: (t != "") & ~t.isin(*stop_words) if stop_words else t != "")


def bag_of_words(terms: Value) -> Column:
    """Terms of one array with their counts, in term order, null first; for the terms of a table see ``tf_idf``."""
    terms = col(terms)
    return F.transform(F.array_sort(F.array_distinct(terms), lambda a, b: F.when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda u: u.eqNullSafe(t))).cast("long").alias("count")))


def tf_idf(df: DataFrame, key: str, terms: Value, *, max_tokens: int = 32000, threshold: int = 5) -> DataFrame:
    """(key, term, tf_idf) over a dictionary of the most frequent terms by documents; other terms share one row, term null.

    Terms are counted per document and per term by aggregations with map-side
    sums; the dictionary has at most ``max_tokens`` rows.
    """
    rows = df.select(F.col(key), F.explode(col(terms)).alias("term"))
    each = rows.groupBy(key, "term").agg(F.count("*").alias("n"))
    docs = df.agg(F.count("*").alias("docs"))
    df_ = each.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= threshold)
    kept = df_.orderBy(F.desc("df"), "term").limit(max_tokens)
    idf = kept.crossJoin(docs).select("term", F.ln(1 + F.col("docs") / (1 + F.col("df"))).alias("idf"))
    other = idf.agg(F.coalesce(F.avg("idf"), F.lit(0.0)).alias("other"))
    size = Window.partitionBy(key)
    sized = each.withColumn("total", F.sum("n").over(size))
    known = sized.join(idf, "term", "left").crossJoin(other)
    name = F.when(F.col("idf").isNotNull(), F.col("term"))
    return known.groupBy(key, name.alias("term"), F.coalesce("idf", "other").alias("w"), "total").agg(F.sum("n").alias("n")).select(key, "term", (F.col("n") / F.col("total") * F.col("w")).alias("tf_idf"))


def search(x: Value, query: str) -> Column:
    """SEARCH with the log analyzer: words and quoted phrases must all be there, unless OR stands between them."""
    padded = F.concat(F.lit(" "), F.array_join(text_analyze(x), " "), F.lit(" "))

    def term(q: str) -> Column:
        words = [w for w in re.split(LOG_DELIMITERS, q.strip('"').lower()) if w]
        return F.contains(padded, F.lit(" " + " ".join(words) + " "))

    either = None
    for part in re.split(r"\s+OR\s+", query):
        all_ = None
        for q in re.findall(r'"[^"]*"|\S+', part):
            all_ = term(q) if all_ is None else all_ & term(q)
        either = all_ if either is None else either | all_
    return either
