"""Load and extract jobs: CSV, newline-delimited JSON, Parquet, Hive partitions, federated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, *, delimiter: str = ",", quote: str = '"', skip_header: bool = True, null_marker: str = "", quoted_newlines: bool = False, jagged_rows: bool = False, max_bad_records: int = 0, encoding: str = "UTF-8", date_format: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """CSV with a bad-record policy; without a schema, types are detected.

    Up to ``max_bad_records`` lines that don't fit are left out; more are an
    error. The lines are only counted if some are allowed.
    """
    reader = spark.read.options(sep=delimiter, quote=quote, header=skip_header, nullValue=null_marker, multiLine=quoted_newlines, encoding=encoding, enforceSchema=True)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not max_bad_records and not jagged_rows:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    full = StructType([*schema.fields]).add(BAD, "string")
    # every field is parsed whichever are asked for, so a bad line is one in every query
    reader = reader.option("columnPruning", False)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(full).csv(path)
    # a row that lacks last columns only is jagged, not bad
    short = F.size(F.split(F.col(BAD), "\\Q" + delimiter + "\\E")) < len(schema.fields)
    bad = F.col(BAD).isNotNull() & (~short if jagged_rows else F.lit(True))
    return _policy(df, bad, max_bad_records).select(*schema.names)


def _policy(df: DataFrame, bad, most: int) -> DataFrame:
    # Spark answers no query of the bad lines' column alone, so another is counted with it
    found = df.agg(F.sum(F.when(bad, 1).otherwise(0)), F.count(df.columns[0])).first()[0] or 0
    if found > most:
        raise ValueError(f"{found} bad records; {most} are allowed")
    return df.where(~bad)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, *, max_bad_records: int = 0) -> DataFrame:
    """Newline-delimited JSON."""
    if schema is None:
        return spark.read.json(path)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not max_bad_records:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    df = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(StructType([*schema.fields]).add(BAD, "string")).json(path)
    return _policy(df, F.col(BAD).isNotNull(), max_bad_records).select(*schema.names)


def read_parquet(spark: SparkSession, path: str, *, merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(path)


def read_hive(spark: SparkSession, path: str, fmt: str = "parquet", *, types: str = "AUTO") -> DataFrame:
    """Keys from folder names; filters on them prune folders. STRINGS leaves them text."""
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", types == "AUTO")
    try:
        return spark.read.format(fmt).load(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)


def external_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """EXTERNAL_QUERY over JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def extract(df: DataFrame, path: str, fmt: str = "parquet", *, compression: str | None = None, single_file: bool = False, header: bool = True) -> None:
    """An extract job; a single file is one task's work, so only for results that are small."""
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if compression:
        out = out.option("compression", compression)
    if fmt == "csv":
        out = out.option("header", header)
    out.format(fmt).save(path)


#: Write dispositions with Spark's modes.
DISPOSITIONS = {"WRITE_EMPTY": "errorifexists", "WRITE_APPEND": "append", "WRITE_TRUNCATE": "overwrite"}


def write_table(df: DataFrame, name: str, disposition: str = "WRITE_EMPTY", *, create: bool = True) -> None:
    """A query's destination table; ``create`` False is CREATE_NEVER."""
    if not create and not df.sparkSession.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    df.write.mode(DISPOSITIONS[disposition]).saveAsTable(name)
