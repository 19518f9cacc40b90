"""BIGNUMERIC as decimal text: 38 digits before the point and 38 after, by Arrow UDFs in a context of 80 digits."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import functions as F

_CONTEXT = Context(prec=80, rounding=ROUND_HALF_UP)
_UNIT = Decimal(1).scaleb(-38)
_MOST = Decimal(2**255).scaleb(-38)


def text(x: Decimal) -> str:
    """In the type's scale, without trailing zeros."""
    if abs(x) >= _MOST:
        raise OverflowError("BIGNUMERIC overflow")
    x = _CONTEXT.quantize(x, _UNIT)
    out = format(x.normalize(_CONTEXT), "f")
    return "0" if out in ("-0", "0") else out


def _binary(f):
    def call(a, b):
        @F.arrow_udf("string")
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            pairs = zip(x.to_pylist(), y.to_pylist())
            return pa.array([None if p is None or q is None else text(f(Decimal(p), Decimal(q))) for p, q in pairs], pa.string())

        return run(a.cast("string"), b.cast("string"))

    return call


add = _binary(_CONTEXT.add)
subtract = _binary(_CONTEXT.subtract)
multiply = _binary(_CONTEXT.multiply)
divide = _binary(_CONTEXT.divide)


def parse(x):
    """PARSE_BIGNUMERIC."""
    return add(x, F.lit("0"))


def sum_(df, keys: list[str], x: str, name: str):
    """SUM of BIGNUMERIC text by group.

    Values are split into three runs of digits that fit DECIMAL(38,0), which
    Spark adds up with partial sums; only the groups' totals meet the UDF.
    """
    big = Decimal(10) ** 19

    @F.arrow_udf("array<decimal(38,0)>")
    def limbs(v: pa.Array) -> pa.Array:
        out = []
        for t in v.to_pylist():
            if t is None:
                out.append(None)
                continue
            n = int(_CONTEXT.quantize(Decimal(t), _UNIT).scaleb(38, _CONTEXT))
            sign, n, parts = (-1 if n < 0 else 1), abs(n), []
            for _ in range(5):
                n, low = divmod(n, int(big))
                parts.append(Decimal(sign * low))
            out.append(parts)
        return pa.array(out, pa.list_(pa.decimal128(38, 0)))

    @F.arrow_udf("string")
    def join(*sums: pa.Array) -> pa.Array:
        rows = zip(*(s.to_pylist() for s in sums))
        return pa.array([None if None in r else text(Decimal(sum(int(p) * 10 ** (19 * i) for i, p in enumerate(r))).scaleb(-38, _CONTEXT)) for r in rows], pa.string())

    parts = df.select(*keys, limbs(x).alias("_l"))
    sums = parts.groupBy(*keys).agg(*[F.sum(F.get("_l", F.lit(i))).alias(f"_s{i}") for i in range(5)])
    return sums.select(*keys, join(*[f"_s{i}" for i in range(5)]).alias(name))
