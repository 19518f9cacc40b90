"""Relational operators of the dialect that Spark has under another form, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_except(df: DataFrame, *names: str) -> DataFrame:
    """SELECT * EXCEPT."""
    return df.drop(*names)


def select_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """SELECT * REPLACE: places are kept."""
    return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def as_struct(df: DataFrame, name: str = "value") -> DataFrame:
    """SELECT AS STRUCT: one struct column."""
    return df.select(F.struct(*df.columns).alias(name))


def as_value(df: DataFrame, name: str) -> DataFrame:
    """A value table read as a table: a struct's fields become columns."""
    return df.select(f"{name}.*")


def qualify(df: DataFrame, **windows: Column) -> "Qualified":
    """QUALIFY: window columns by name, then a filter on them."""
    return Qualified(df, windows)


class Qualified:
    def __init__(self, df: DataFrame, windows: dict[str, Column]) -> None:
        self.df, self.windows = df, windows

    def where(self, cond: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
        out = self.df.withColumns(self.windows).where(cond)
        return out.drop(*[n for n in self.windows if n not in keep])


def unnest(df: DataFrame, array: str, name: str, *, offset: str | None = None, left: bool = False) -> DataFrame:
    """Correlated UNNEST; null and empty arrays are alike, kept with nulls if ``left``."""
    if offset is None:
        return df.select("*", (F.explode_outer if left else F.explode)(array).alias(name))
    out = df.select("*", (F.posexplode_outer if left else F.posexplode)(array).alias(offset, name))
    return out.withColumn(offset, F.col(offset).cast("long"))


def unnest_zip(df: DataFrame, arrays: dict[str, str], *, mode: str = "PAD", offset: str | None = None) -> DataFrame:
    """UNNEST of several arrays side by side; PAD with nulls, TRUNCATE to the shortest, or STRICT: equal lengths."""
    sizes = [F.coalesce(F.size(a), F.lit(0)) for a in arrays]
    zipped = F.arrays_zip(*[F.coalesce(F.col(a), F.array()).alias(n) for a, n in arrays.items()])
    if mode == "TRUNCATE":
        zipped = F.slice(zipped, F.lit(1), F.least(*sizes) if len(sizes) > 1 else sizes[0])
    elif mode == "STRICT":
        same = reduce(lambda p, q: p & q, (s == sizes[0] for s in sizes))
        zipped = F.when(same, zipped).otherwise(F.raise_error(F.lit("UNNEST: arrays of different lengths")))
    at, row = offset or "_at", f"_z{uuid.uuid4().hex[:6]}"
    out = df.select("*", F.posexplode(zipped).alias(at, row))
    out = out.select(*df.columns, *([F.col(at).cast("long").alias(at)] if offset else []), *[F.col(row)[n].alias(n) for n in arrays.values()])
    return out


def pivot(df: DataFrame, keys: list[str], on: str, values: dict, aggregates: dict[str, Callable[[Column], Column]], source: str) -> DataFrame:
    """PIVOT: for each value and aggregate a column; an absent value gives the aggregate of no rows, so a count is 0.

    The values are known, so this is one aggregation with conditional
    arguments: no second pass to find them, and partial sums before the shuffle.
    """
    cols = [agg(F.when(F.col(on).eqNullSafe(F.lit(v)), F.col(source))).alias(f"{a}_{n}" if len(aggregates) > 1 else n) for n, v in values.items() for a, agg in aggregates.items()]
    return df.groupBy(*keys).agg(*cols)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str, *, include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(ids, values, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def union_by_name(a: DataFrame, b: DataFrame, *, mode: str = "STRICT", distinct: bool = False) -> DataFrame:
    """BY NAME: STRICT needs the same columns, FULL pads with nulls, LEFT keeps a's, INNER the common ones."""
    if mode == "STRICT" and set(a.columns) != set(b.columns):
        raise ValueError("UNION BY NAME: different columns")
    if mode == "LEFT":
        b = b.select(*[c for c in b.columns if c in a.columns])
    if mode == "INNER":
        common = [c for c in a.columns if c in b.columns]
        a, b = a.select(*common), b.select(*common)
    out = a.unionByName(b, allowMissingColumns=mode in ("FULL", "LEFT"))
    return out.distinct() if distinct else out


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], *, distinct: bool = True, most: int = 100) -> DataFrame:
    """WITH RECURSIVE: rows of the seed and of steps from the newest rows, until a step adds none.

    Each round's new rows are checkpointed, so plans stay flat and a lost
    executor costs no more than a round.
    """
    spark = seed.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from ..session import checkpoint_dir

        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    all_ = (seed.distinct() if distinct else seed).checkpoint()
    new = all_
    for _ in range(most):
        new = step(new)
        if distinct:
            new = new.subtract(all_)
        new = new.checkpoint()
        if new.isEmpty():
            return all_
        all_ = all_.unionAll(new)
    raise RuntimeError("recursion did not end")


def sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE SYSTEM (p PERCENT)."""
    return df.sample(fraction=percent / 100, seed=seed)


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose ranges [start, end) overlap, as an equi-join on buckets.

    A range is dealt to each bucket of ``width`` that it touches; a pair that
    meets in several is reported in the bucket where the later start lies, so
    no distinct is needed. Column names of the two sides must differ but for ``keys``.
    """
    def dealt(df: DataFrame, r: tuple[str, str]) -> DataFrame:
        first, last = (F.floor(F.col(x).cast("double") / width).cast("long") for x in r)
        return df.where(F.col(r[0]) < F.col(r[1])).withColumn("_bucket", F.explode(F.sequence(first, last)))

    both = dealt(a, a_range).join(dealt(b, b_range), [*keys, "_bucket"])
    (a0, a1), (b0, b1) = a_range, b_range
    later = F.floor(F.greatest(F.col(a0).cast("double"), F.col(b0).cast("double")) / width).cast("long")
    return both.where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("_bucket") == later)).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str) -> DataFrame:
    """For each left row the latest ``value`` of the right at or before its time: one sort of both sides together."""
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def count_distinct_over(df: DataFrame, x: str, name: str, *partition: str) -> DataFrame:
    """COUNT(DISTINCT x) OVER (PARTITION BY …): the greatest dense rank of non-null values, in constant memory for a partition."""
    w = Window.partitionBy(*partition)
    rank = F.when(F.col(x).isNotNull(), F.dense_rank().over(w.orderBy(F.col(x).asc_nulls_last())))
    return df.withColumn("_rank", rank).withColumn(name, F.coalesce(F.max("_rank").over(w), F.lit(0)).cast("long")).drop("_rank")
