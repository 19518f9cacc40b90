"""User-defined functions from source text, and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


def python_udf(spark: SparkSession, name: str, source: str, entry_point: str, returns: str) -> Callable:
    """A scalar Python function from its source, registered by name; arguments come in Arrow batches."""
    kind: DataType = _parse_datatype_string(returns)
    arrow = to_arrow_type(kind)
    held: list[Callable] = []

    @F.arrow_udf(returns)
    def run(*columns: pa.Array) -> pa.Array:
        if not held:
            scope: dict = {}
            exec(compile(source, name, "exec"), scope)  # the user's own code, once for each worker
            held.append(scope[entry_point])
        f = held[0]
        return pa.array([f(*r) for r in zip(*(c.to_pylist() for c in columns))], arrow)

    spark.udf.register(name, run)
    return run


def sql_function(spark: SparkSession, name: str, arguments: str, body: str, returns: str | None = None) -> None:
    """A SQL function that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) {f'RETURNS {returns} ' if returns else ''}RETURN {body}")


def table_function(spark: SparkSession, name: str, arguments: str, columns: str, query: str) -> None:
    """A SQL table function that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {query}")


class MaterializedView:
    """An aggregate over one table, computed anew for every read, so it is never stale."""

    def __init__(self, build: Callable[[], DataFrame]) -> None:
        self.build = build

    def read(self) -> DataFrame:
        return self.build()
