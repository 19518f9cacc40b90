"""Table functions over time: GAP_FILL and RANGE_SESSIONIZE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import MICROS, ORIGIN


def gap_fill(df: DataFrame, ts: str, width: int, part: str, *, partition_by: tuple[str, ...] = (), values: dict[str, str] | None = None, origin: str = ORIGIN, ignore_nulls: bool = True) -> DataFrame:
    """Values at every bucket point between a partition's first and last row.

    Methods: ``null`` (only what stands on the point), ``locf`` (the last at or
    before it), ``linear`` (between the neighbours by time). The grid of points
    is made from each partition's first and last time, united with the rows,
    and filled by windows over the partition: two exchanges on its keys,
    whatever the number of value columns.
    """
    values = values or {c: "null" for c in df.columns if c not in (ts, *partition_by)}
    kind = dict(df.dtypes)
    step, zero = MICROS[part] * width, F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).select(*partition_by, *values, at.alias("_at"))
    ends = rows.groupBy(*partition_by).agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    first, last = F.ceil((F.col("lo") - zero) / step), F.floor((F.col("hi") - zero) / step)
    points = ends.where(first <= last).select(*partition_by, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_k"))
    grid = points.select(*partition_by, (F.col("_k") * step + zero).alias("_at"), F.lit(True).alias("_grid"))
    both = rows.withColumn("_grid", F.lit(False)).unionByName(grid, allowMissingColumns=True)
    w = Window.partitionBy(*partition_by)
    # rows at a point come before the point itself
    upto = w.orderBy("_at", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    since = w.orderBy("_at", F.col("_grid").desc()).rowsBetween(0, Window.unboundedFollowing)
    out: dict[str, Column] = {}
    for c, method in values.items():
        seen = ~F.col("_grid") & (F.col(c).isNotNull() if ignore_nulls else F.lit(True))
        row = F.when(seen, F.struct(F.col("_at").alias("at"), F.col(c).alias("v")))
        prev = F.last(row, ignorenulls=True).over(upto)
        if method == "locf":
            out[c] = prev["v"]
        elif method == "null":
            out[c] = F.when(prev["at"] == F.col("_at"), prev["v"])
        else:
            next_ = F.first(row, ignorenulls=True).over(since)
            share = (F.col("_at") - prev["at"]) / (next_["at"] - prev["at"])
            line = F.when(prev["at"] == F.col("_at"), prev["v"].cast("double")).when(next_["at"].isNotNull(), prev["v"] + (next_["v"] - prev["v"]) * share)
            out[c] = F.floor(line + 0.5).cast("long") if kind[c] in ("bigint", "int") else line
    filled = both.select(*partition_by, "_at", "_grid", *[v.alias(c) for c, v in out.items()]).where("_grid")
    time = F.timestamp_micros("_at").cast(df.schema[ts].dataType)
    return filled.select(time.alias(ts), *partition_by, *values)


def range_sessionize(df: DataFrame, start: str, end: str, keys: tuple[str, ...], *, mode: str = "MEETS") -> DataFrame:
    """Adds session_start and session_end: the hull of ranges [start, end) of equal keys that meet (or, OVERLAPS, share a point).

    Null bounds are unbounded; a row whose bounds are both null has no session.
    """
    lo = F.coalesce(F.col(start).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    hi = F.coalesce(F.col(end).cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp"))
    w = Window.partitionBy(*keys)
    order = w.orderBy("_lo", "_hi")
    known = df.withColumns({"_lo": lo, "_hi": hi, "_none": F.col(start).isNull() & F.col(end).isNull()})
    before = F.max(F.when(~F.col("_none"), F.col("_hi"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | ((F.col("_lo") > before) if mode == "MEETS" else (F.col("_lo") >= before))
    marked = known.withColumn("_new", (new & ~F.col("_none")).cast("int")).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*keys, "_s")
    kind = df.schema[start].dataType
    own = lambda f, c: F.when(~F.col("_none"), f(F.when(~F.col("_none"), F.col(c))).over(group)).cast(kind)
    out = marked.withColumns({"session_start": own(F.min, "_lo"), "session_end": own(F.max, "_hi")})
    return out.drop("_lo", "_hi", "_none", "_new", "_s")
