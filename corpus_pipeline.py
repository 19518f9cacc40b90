"""From raw documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage is (spark, docs, sf_dir) to a DataFrame and works on all rows that
the stage before it kept; all but the last return the columns of ``documents``.
SQL cannot express the stages' models, so the pipeline has no oracle and is
tested stage by stage against the operators' brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import read_if_there, scratch, stage
from weir.llm.compaction import shard
from weir.llm.mixing import mix
from weir.llm.quality import filter_quality
from weir.llm.shingles import firsts
from weir.llm.tiling import decontaminate

#: The near-duplicate stage's shingles: five words, as against the three of the query's contract. What is this similar is a near copy.
SHINGLE, SIMILAR = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the weak-supervision posterior calls good.

    Null and wordless texts go, as too short; an empty table stays empty;
    columns named ``_q`` or ``_q_*`` are not taken for measures.
    """
    return filter_quality(docs, read_if_there(spark, f"{sf_dir}/labels.parquet"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that of the smallest id, null ids last; of rows with one id, the one with the smallest hash.

    Null and wordless texts are one group; distinct texts with null or equal
    ids stay apart; an empty table stays empty.
    """
    rank = [F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("all")]
    return firsts(docs, rank, width=SHINGLE, least=SIMILAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what covers a benchmark item. Null and empty texts cover none; no items or no rows: all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A null source is one of its own; texts without words are taken no times;
    rows with one id are taken alike; an empty table stays empty.
    """
    return mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write compacted shards; one row for each document written, with its shard and the manifest's version.

    All columns and rows pass, nulls and repeated rows included; an empty table
    gives no shards and no rows.
    """
    return shard(docs, f"{scratch(spark)}/corpus-{uuid.uuid4().hex}").shards("doc_id", "source", "n_chars")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", benchmark_decontamination),
    ("mixture", source_mixture),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
