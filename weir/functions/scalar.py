"""Scalar functions of the dialect as Column builders over Spark's own expressions.

Where the dialect raises and Spark returns a value (or the other way about),
the builder closes the gap inside the expression, so plans stay in the JVM.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# comparison and conditionals


def eq(a: Value, b: Value) -> Column:
    """Equality in which NaN equals nothing."""
    a, b = col(a), col(b)
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def less(a: Value, b: Value) -> Column:
    """Less-than that is false next to NaN."""
    a, b = col(a), col(b)
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def order_keys(x: Value, *, descending: bool = False, is_float: bool = False) -> list[Column]:
    """Sort keys: nulls first ascending and last descending, NaN below all numbers."""
    x = col(x)
    keys = [F.isnan(x).desc()] if is_float and not descending else [F.isnan(x).asc()] if is_float else []
    first = x.isNull().asc() if descending else x.isNull().desc()
    return [first, *keys, x.desc_nulls_last() if descending else x.asc_nulls_first()]


def if_(cond: Column, a, b) -> Column:
    return F.when(cond, lit(a)).otherwise(lit(b))


def ifnull(a: Value, b) -> Column:
    return F.coalesce(col(a), lit(b))


def nullif(a: Value, b) -> Column:
    return F.nullif(col(a), lit(b))


def _any_null(xs: tuple[Column, ...]) -> Column:
    return reduce(lambda p, q: p | q, (x.isNull() for x in xs))


def greatest(*xs: Value) -> Column:
    """Null if any argument is null."""
    xs = tuple(map(col, xs))
    return F.when(~_any_null(xs), F.greatest(*xs))


def least(*xs: Value) -> Column:
    """Null if any argument is null."""
    xs = tuple(map(col, xs))
    return F.when(~_any_null(xs), F.least(*xs))


# arithmetic


def safe_add(a, b) -> Column:
    return F.try_add(col(a), lit(b))


def safe_subtract(a, b) -> Column:
    return F.try_subtract(col(a), lit(b))


def safe_multiply(a, b) -> Column:
    return F.try_multiply(col(a), lit(b))


def safe_negate(a) -> Column:
    return F.try_subtract(F.lit(0).cast("long"), col(a))


def safe_divide(a, b) -> Column:
    """Null for a zero divisor, and where finite numbers overflow."""
    a, b = col(a).cast("double"), lit(b).cast("double")
    q = F.try_divide(a, b)
    return F.when(is_inf(q) & ~is_inf(a), None).otherwise(q)


def ieee_divide(a, b) -> Column:
    a, b = col(a).cast("double"), lit(b).cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def div(a, b) -> Column:
    """Whole division toward zero."""
    return _div(col(a), lit(b))


def _div(a: Column, b: Column) -> Column:
    # exact for all longs and for NUMERIC
    return F.call_function("div", a.cast("decimal(38,9)"), b.cast("decimal(38,9)"))


def mod(a, b) -> Column:
    """Remainder with the dividend's sign."""
    return col(a) % lit(b)


def is_inf(x: Value) -> Column:
    return F.abs(col(x)) == F.lit(float("inf"))


def is_nan(x: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.isnan(x))


def _domain(ok: Column, value: Column, name: str) -> Column:
    return F.when(ok, value).when(~ok, F.raise_error(F.lit(f"{name}: argument out of its domain")).cast("double"))


def sqrt(x) -> Column:
    x = col(x).cast("double")
    return _domain((x >= 0) | F.isnan(x), F.sqrt(x), "SQRT")


def ln(x) -> Column:
    x = col(x).cast("double")
    return _domain(x > 0, F.ln(x), "LN")


def log(x, base=None) -> Column:
    return ln(x) if base is None else ln(x) / ln(lit(base))


def log10(x) -> Column:
    x = col(x).cast("double")
    return _domain(x > 0, F.log10(x), "LOG10")


def _inverse(name: str, f, ok):
    def build(x) -> Column:
        x = col(x).cast("double")
        return _domain(ok(x) | F.isnan(x), f(x), name)

    build.__name__ = name.lower()
    build.__doc__ = f"{name}, an error outside its domain."
    return build


acos = _inverse("ACOS", F.acos, lambda x: F.abs(x) <= 1)
asin = _inverse("ASIN", F.asin, lambda x: F.abs(x) <= 1)
acosh = _inverse("ACOSH", F.acosh, lambda x: x >= 1)
atanh = _inverse("ATANH", F.atanh, lambda x: F.abs(x) < 1)
cot = _inverse("COT", F.cot, lambda x: x != 0)
csc = _inverse("CSC", F.csc, lambda x: x != 0)
coth = _inverse("COTH", lambda x: F.cosh(x) / F.sinh(x), lambda x: x != 0)
csch = _inverse("CSCH", lambda x: F.lit(1.0) / F.sinh(x), lambda x: x != 0)


def sech(x) -> Column:
    return F.lit(1.0) / F.cosh(col(x))


def sec(x) -> Column:
    return F.sec(col(x))


def ceil(x) -> Column:
    """A float stays a float and a decimal a decimal, whatever their size."""
    x = col(x)
    return F.when(is_inf(x), x).otherwise(x + F.pmod(-x, F.lit(1)))


def floor(x) -> Column:
    """A float stays a float and a decimal a decimal, whatever their size."""
    x = col(x)
    return F.when(is_inf(x), x).otherwise(x - F.pmod(x, F.lit(1)))


def round_(x, digits: int = 0, mode: str = "ROUND_HALF_AWAY_FROM_ZERO") -> Column:
    return F.bround(col(x), digits) if mode == "ROUND_HALF_EVEN" else F.round(col(x), digits)


def trunc(x, digits: int = 0) -> Column:
    """Toward zero; a float stays a float and a decimal a decimal, cut exactly."""
    x = col(x)
    if not digits:
        return x - x % 1
    near, step = F.round(x, digits), F.lit(Decimal(1).scaleb(-digits))
    return F.round(F.when(F.abs(near) > F.abs(x), near - F.when(x < 0, -step).otherwise(step)).otherwise(near), digits)


def to_int64(x) -> Column:
    """Casts a float by rounding half away from zero."""
    return F.round(col(x)).cast("long")


def range_bucket(point, bounds: Column) -> Column:
    """How many of the ascending bounds are at most the point."""
    point = col(point)
    return F.when(point.isNotNull(), F.size(F.filter(bounds, lambda e: e <= point)).cast("long"))


def shift_left(x, n: int) -> Column:
    """Bits shifted out are lost: 64 and more give 0."""
    return F.shiftleft(col(x).cast("long"), n) if n < 64 else F.when(col(x).isNotNull(), F.lit(0).cast("long"))


def shift_right(x, n: int) -> Column:
    return F.shiftrightunsigned(col(x).cast("long"), n) if n < 64 else F.when(col(x).isNotNull(), F.lit(0).cast("long"))


def cosine_distance(a: Value, b: Value) -> Column:
    a, b = col(a), col(b)
    dot = _dot(a, b)
    return F.lit(1.0) - dot / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def euclidean_distance(a: Value, b: Value) -> Column:
    gap = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# strings


def strpos(x, sub) -> Column:
    return F.instr(col(x), lit(sub)).cast("long")


def instr(x, sub, position: int = 1, occurrence: int = 1) -> Column:
    """Place of an occurrence at or after a position, or at or before one counted from the end; 0 if none."""
    x = col(x)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(len(sub))) == sub)
    if position > 0:
        at = F.try_element_at(F.filter(places, lambda i: i >= position), F.lit(occurrence))
    else:
        at = F.try_element_at(F.filter(places, lambda i: i <= F.length(x) + position + 1), F.lit(-occurrence))
    return F.when(x.isNotNull(), F.coalesce(at, F.lit(0)).cast("long"))


def substr(x, position: int, length: int | None = None) -> Column:
    """From a place counted from 1 or, if negative, from the end; places before the text are its start."""
    x = col(x)
    start = F.lit(max(position, 1)) if position >= 0 else F.greatest(F.length(x) + position + 1, F.lit(1))
    return F.substring(x, start, F.length(x) if length is None else F.lit(length))


def left(x, n: int) -> Column:
    return F.left(col(x), F.lit(n))


def right(x, n: int) -> Column:
    return F.right(col(x), F.lit(n))


def lpad(x, n: int, pad: str = " ") -> Column:
    return F.lpad(col(x), n, pad)


def rpad(x, n: int, pad: str = " ") -> Column:
    return F.rpad(col(x), n, pad)


def trim(x, chars: str | None = None) -> Column:
    return F.btrim(col(x), F.lit(chars)) if chars else F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def ltrim(x, chars: str | None = None) -> Column:
    return F.ltrim(col(x), F.lit(chars)) if chars else F.regexp_replace(col(x), r"(?U)^\s+", "")


def rtrim(x, chars: str | None = None) -> Column:
    return F.rtrim(col(x), F.lit(chars)) if chars else F.regexp_replace(col(x), r"(?U)\s+$", "")


def split(x, delimiter: str = ",") -> Column:
    """By a plain delimiter; an empty one gives the characters."""
    if delimiter == "":
        return F.filter(F.split(col(x), ""), lambda c: c != "")
    return F.split(col(x), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def starts_with(x, prefix) -> Column:
    return F.startswith(col(x), lit(prefix))


def ends_with(x, suffix) -> Column:
    return F.endswith(col(x), lit(suffix))


def regexp_contains(x, pattern: str) -> Column:
    return col(x).rlike(pattern)


def regexp_extract(x, pattern: str, occurrence: int = 1) -> Column:
    """The capture, or the match without one; null if there is none."""
    found = regexp_extract_all(x, pattern)
    return F.get(found, F.lit(occurrence - 1))


def regexp_extract_all(x, pattern: str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(_groups(pattern)))


def _groups(pattern: str) -> int:
    import re

    return min(re.compile(pattern).groups, 1)


def regexp_replace(x, pattern: str, replacement: str) -> Column:
    """The replacement names captures as \\1."""
    import re

    return F.regexp_replace(col(x), pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", "\\$")))


def regexp_instr(x, pattern: str) -> Column:
    return F.regexp_instr(col(x), F.lit(pattern)).cast("long")


def edit_distance(a, b, most: int | None = None) -> Column:
    """Levenshtein; with ``most`` no more than that."""
    d = F.levenshtein(col(a), lit(b))
    return (d if most is None else F.least(d, F.lit(most))).cast("long")


def replace(x, a: str, b: str) -> Column:
    return F.replace(col(x), F.lit(a), F.lit(b)) if a else col(x)


def initcap(x, delimiters: str = r" \t\n\r\f\v\[\](){}/|<>!?@\"^#$&~_,.:;*%+=-") -> Column:
    """Upper case after each delimiter, lower case elsewhere."""
    parts = F.regexp_extract_all(F.lower(col(x)), F.lit(f"[^{delimiters}]+|[{delimiters}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def to_code_points(x) -> Column:
    return F.transform(split(x, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))


def code_points_to_string(xs: Column) -> Column:
    return F.array_join(F.transform(xs, chr_), "")


def chr_(x) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(col(x).cast("long")), 8, "0")), "UTF-32")


def unicode_(x) -> Column:
    return F.coalesce(F.get(to_code_points(x), F.lit(0)), F.lit(0).cast("long"))


def code_points_to_bytes(xs: Column) -> Column:
    return F.unhex(F.array_join(F.transform(xs, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def soundex(x) -> Column:
    """Empty for text without letters."""
    letters = F.regexp_replace(col(x), "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def to_hex(x) -> Column:
    return F.lower(F.hex(col(x)))


def from_hex(x) -> Column:
    x = col(x)
    return F.unhex(F.when(F.length(x) % 2 == 1, F.concat(F.lit("0"), x)).otherwise(x))


def md5(x) -> Column:
    return F.unhex(F.md5(col(x).cast("binary")))


def sha1(x) -> Column:
    return F.unhex(F.sha1(col(x).cast("binary")))


def sha256(x) -> Column:
    return F.unhex(F.sha2(col(x).cast("binary"), 256))


def sha512(x) -> Column:
    return F.unhex(F.sha2(col(x).cast("binary"), 512))


def contains_substr(x, sub: str) -> Column:
    """Without regard to case and to forms that Unicode holds equal (NFKC, folded); ASCII texts don't leave the JVM, and only the answer comes back of others."""
    from .udfs import NAMED, _fold

    x, part = col(x), _fold(sub)
    other = x.rlike(r"[^\x00-\x7F]")
    return F.when(other, NAMED["weir_holds"](F.when(other, x), F.lit(part))).otherwise(F.contains(F.lower(x), F.lit(part)))


# arrays


def array_first(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.raise_error(F.lit("ARRAY_FIRST of an empty array"))).otherwise(F.get(a, F.lit(0)))


def array_last(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.raise_error(F.lit("ARRAY_LAST of an empty array"))).otherwise(F.element_at(a, -1))


def array_length(a: Value) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)).cast("long"))


def array_slice(a: Value, start: int, end: int) -> Column:
    """From start to end, both included and counted from 0 or, negative, from the end; clamped."""
    a = col(a)
    n = F.size(a)
    lo = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    hi = F.least(n - 1, F.lit(end) if end >= 0 else n + end)
    return F.when(hi >= lo, F.slice(a, lo + 1, hi - lo + 1)).otherwise(F.slice(a, F.lit(1), F.lit(0)))


def array_to_string(a: Value, delimiter: str, null_text: str | None = None) -> Column:
    return F.array_join(col(a), delimiter, null_text)


def generate_array(start, end, step=1) -> Column:
    """Empty where the step leads away from the end."""
    start, end = lit(start), lit(end)
    ok = (start <= end) if step > 0 else (start >= end)
    return F.when(ok, F.sequence(start, end, lit(step))).otherwise(F.slice(F.array(start), F.lit(1), F.lit(0)))


def safe_offset(a: Value, i: int) -> Column:
    return F.get(col(a), F.lit(i))


def offset(a: Value, i: int) -> Column:
    return F.element_at(col(a), i + 1)


# JSON kept as text


def json_query(x, path: str = "$") -> Column:
    return F.get_json_object(col(x), path)


def json_value(x, path: str = "$") -> Column:
    """Scalars only."""
    found = F.try_variant_get(F.try_parse_json(col(x)), path, "variant")
    return F.when(~F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(found, "$", "string"))


def json_value_array(x, path: str = "$") -> Column:
    return F.from_json(F.get_json_object(col(x), path), "array<string>")


def json_type(x, path: str = "$") -> Column:
    kind = F.schema_of_variant(F.variant_get(F.parse_json(col(x)), path, "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_number(x, path: str = "$", kind: str = "bigint") -> Column:
    """INT64, FLOAT64, BOOL or STRING of a JSON value; an error for another type."""
    return F.variant_get(F.parse_json(col(x)), path, kind)


def lax(x, path: str = "$", kind: str = "bigint") -> Column:
    """LAX_INT64 and its kin: null where the value has another type."""
    v = F.parse_json(col(x))
    if kind == "bigint":
        return F.round(F.try_variant_get(v, path, "double")).cast("long")
    return F.try_variant_get(v, path, kind)


def json_object(*pairs) -> Column:
    return F.to_json(F.struct(*[lit(v).alias(k) for k, v in pairs]), {"ignoreNullFields": "false"})


def to_json_string(x: Value) -> Column:
    """Also of scalars."""
    return F.regexp_extract(F.to_json(F.struct(col(x).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


# ranges: struct<start, end>, null for unbounded


def range_(start, end) -> Column:
    """[start, end); null where it would be empty."""
    start, end = lit(start), lit(end)
    return F.when(start.isNull() | end.isNull() | (start < end), F.struct(start.alias("start"), end.alias("end")))


def range_contains(r: Column, x: Column) -> Column:
    lo, hi = r["start"], r["end"]
    return (lo.isNull() | (lo <= x)) & (hi.isNull() | (x < hi))


def range_overlaps(a: Column, b: Column) -> Column:
    return (a["start"].isNull() | b["end"].isNull() | (a["start"] < b["end"])) & (b["start"].isNull() | a["end"].isNull() | (b["start"] < a["end"]))


def range_intersect(a: Column, b: Column) -> Column:
    """The common part; null where there is none."""
    return F.when(range_overlaps(a, b), F.struct(F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end")))


def generate_range_array(r: Column, days: int, include_last_partial: bool = True) -> Column:
    """Ranges of so many days; the last one may be cut."""
    starts = F.sequence(r["start"], F.date_sub(r["end"], 1), F.make_dt_interval(F.lit(days)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days), r["end"]).alias("end")))
    return parts if include_last_partial else F.filter(parts, lambda p: F.datediff(p["end"], p["start"]) == days)
