"""Dates, datetimes, timestamps, times and intervals of the dialect.

Parts are written as in the dialect (``WEEK(MONDAY)``, ``ISOWEEK``, ``QUARTER``).
A difference of dates or datetimes counts the part's boundaries between them;
a difference of timestamps counts whole units.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import Value, col, lit

#: Weekdays in the dialect's order, whose weeks begin with Sunday.
WEEKDAYS = ["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}
ORIGIN = "1950-01-01"


def _week_start(part: str) -> int | None:
    """The weekday, from Sunday 0, that a WEEK part begins with."""
    if part in ("WEEK", "ISOWEEK"):
        return int(part == "ISOWEEK")
    m = re.fullmatch(r"WEEK\((\w+)\)", part)
    return WEEKDAYS.index(m[1]) if m else None


def date_trunc(x: Value, part: str) -> Column:
    """A date cut to its part's beginning."""
    d = col(x).cast("date")
    week = _week_start(part)
    if week is not None:
        return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - week, F.lit(7)))
    if part == "ISOYEAR":
        fourth = F.make_date(F.extract(F.lit("YEAROFWEEK"), d), F.lit(1), F.lit(4))
        return F.trunc(fourth, "WEEK")
    return d if part == "DAY" else F.trunc(d, part)


def datetime_trunc(x: Value, part: str) -> Column:
    """A datetime (without zone) cut to its part's beginning."""
    x = col(x)
    if part in ("DAY", "MONTH", "QUARTER", "YEAR", "ISOYEAR") or _week_start(part) is not None:
        return date_trunc(x, part).cast("timestamp_ntz")
    return F.date_trunc(part, x).cast("timestamp_ntz")


def timestamp_trunc(x: Value, part: str, zone: str = "UTC") -> Column:
    local = F.from_utc_timestamp(col(x), zone)
    cut = date_trunc(local, part).cast("timestamp") if part in ("DAY", "ISOYEAR") or _week_start(part) is not None else F.date_trunc(part, local)
    return F.to_utc_timestamp(cut, zone)


def _month_no(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d)).cast("long")


def date_diff(a: Value, b: Value, part: str = "DAY") -> Column:
    """How many boundaries of the part lie between b and a."""
    a, b = col(a).cast("date"), col(b).cast("date")
    if part == "DAY":
        return F.datediff(a, b).cast("long")
    if _week_start(part) is not None:
        return (F.datediff(date_trunc(a, part), date_trunc(b, part)) / 7).cast("long")
    if part == "ISOYEAR":
        return (F.extract(F.lit("YEAROFWEEK"), a) - F.extract(F.lit("YEAROFWEEK"), b)).cast("long")
    months = {"MONTH": lambda d: _month_no(d), "QUARTER": lambda d: (F.year(d) * 4 + F.quarter(d)).cast("long"), "YEAR": lambda d: F.year(d).cast("long")}[part]
    return months(a) - months(b)


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def datetime_diff(a: Value, b: Value, part: str) -> Column:
    """Boundaries, down to microseconds."""
    if part not in MICROS or part == "DAY":
        return date_diff(a, b, part)
    unit = F.lit(MICROS[part])
    floor = lambda x: F.call_function("div", _micros(col(x)) - F.pmod(_micros(col(x)), unit), unit)
    return floor(a) - floor(b)


def timestamp_diff(a: Value, b: Value, part: str) -> Column:
    """Whole units, toward zero."""
    gap = _micros(col(a)) - _micros(col(b))
    return F.call_function("div", gap, F.lit(MICROS[part]))


def date_add(x: Value, n, part: str = "DAY") -> Column:
    x, n = col(x).cast("date"), lit(n)
    if part in ("DAY", "WEEK"):
        return F.date_add(x, (n * (7 if part == "WEEK" else 1)).cast("int"))
    return F.add_months(x, (n * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]).cast("int"))


def datetime_add(x: Value, n, part: str) -> Column:
    x, n = col(x), lit(n)
    if part in MICROS:
        return x + F.make_dt_interval(secs=(n.cast("long") * F.lit(MICROS[part]) / F.lit(1e6)).cast("decimal(18,6)"))
    if part == "WEEK":
        return x + F.make_dt_interval(days=(n * 7).cast("int"))
    return x + F.make_ym_interval(months=(n * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]).cast("int"))


def last_day(x: Value, part: str = "MONTH") -> Column:
    """The last day of the part that holds the date."""
    d = col(x).cast("date")
    start = date_trunc(d, part)
    if _week_start(part) is not None:
        return F.date_add(start, 6)
    if part == "ISOYEAR":
        return F.date_sub(date_trunc(F.date_add(start, 380), "ISOYEAR"), 1)
    return F.date_sub(F.add_months(start, {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]), 1)


def extract(x: Value, part: str) -> Column:
    x = col(x)
    if part == "DAYOFWEEK":
        return F.dayofweek(x).cast("long")
    week = None if part == "ISOWEEK" else _week_start(part)
    if week is not None:
        # days before the first such weekday of the year are in week 0
        d = x.cast("date")
        return F.floor((F.dayofyear(d) - 1 + 7 - F.pmod(F.dayofweek(d) - 1 - week, F.lit(7))) / 7).cast("long")
    if part in ("MICROSECOND", "MILLISECOND"):
        return F.pmod(_micros(x), F.lit(10**6)).cast("long") if part == "MICROSECOND" else F.floor(F.pmod(_micros(x), F.lit(10**6)) / 1000).cast("long")
    names = {"ISOWEEK": "WEEK", "ISOYEAR": "YEAROFWEEK", "DAYOFYEAR": "DOY"}
    return F.extract(F.lit(names.get(part, part)), x).cast("long")


def date_bucket(x: Value, n: int, part: str = "DAY", origin: str = ORIGIN) -> Column:
    """The beginning of the bucket of n parts, counted from the origin, that holds the date."""
    x, o = col(x).cast("date"), F.lit(origin).cast("date")
    if part in ("DAY", "WEEK"):
        n *= 7 if part == "WEEK" else 1
        return F.date_add(o, (F.floor(F.datediff(x, o) / n) * n).cast("int"))
    n *= {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]
    whole = F.floor(F.months_between(F.trunc(x, "MONTH"), F.trunc(o, "MONTH")) / n)
    start = F.add_months(o, (whole * n).cast("int"))
    return F.when(start > x, F.add_months(o, ((whole - 1) * n).cast("int"))).otherwise(start)


def timestamp_bucket(x: Value, n: int, part: str, origin: str = ORIGIN) -> Column:
    """As DATE_BUCKET, for timestamps and datetimes of any zone, in fixed units."""
    x = col(x)
    width, o = F.lit(n * MICROS[part]), _micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros((F.floor((_micros(x) - o) / width) * width + o).cast("long"))


def datetime_bucket(x: Value, n: int, part: str, origin: str = ORIGIN) -> Column:
    return timestamp_bucket(x, n, part, origin).cast("timestamp_ntz")


def generate_date_array(start, end, n: int = 1, part: str = "DAY") -> Column:
    step = F.make_dt_interval(F.lit(n * (7 if part == "WEEK" else 1))) if part in ("DAY", "WEEK") else F.make_ym_interval(F.lit(0), F.lit(n * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]))
    start, end = lit(start).cast("date"), lit(end).cast("date")
    return F.when((start <= end) == F.lit(n > 0), F.sequence(start, end, step)).otherwise(F.array().cast("array<date>"))


def generate_timestamp_array(start, end, n: int, part: str) -> Column:
    start, end = lit(start), lit(end)
    step = F.make_dt_interval(secs=F.lit(n * MICROS[part] // 10**6))
    return F.when(start <= end, F.sequence(start, end, step))


#: Format elements with the patterns that give the same text.
ELEMENTS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM",
    "%h": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a", "%I": "hh", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%R": "HH:mm",
    "%E6S": "ss.SSSSSS", "%E3S": "ss.SSS", "%E4Y": "yyyy", "%%": "%",
}


def pattern(fmt: str) -> str:
    """The pattern of a format's elements; other text is quoted."""
    out = []
    for m in re.finditer(r"%E\dS|%E4Y|%.|[^%]+", fmt):
        part = m[0]
        if part.startswith("%"):
            if part not in ELEMENTS:
                raise ValueError(f"format element {part} is not supported")
            out.append(ELEMENTS[part])
        else:
            out.append("'" + part.replace("'", "''") + "'")
    return "".join(out)


def format_(fmt: str, x: Value) -> Column:
    """FORMAT_DATE, FORMAT_DATETIME, FORMAT_TIMESTAMP."""
    return F.date_format(col(x), pattern(fmt))


def parse_date(fmt: str, x: Value) -> Column:
    return F.to_date(col(x), pattern(fmt))


def parse_datetime(fmt: str, x: Value) -> Column:
    return F.to_timestamp_ntz(col(x), F.lit(pattern(fmt)))


def parse_timestamp(fmt: str, x: Value, zone: str = "UTC") -> Column:
    return F.to_utc_timestamp(F.to_timestamp(col(x), pattern(fmt)), zone)


# intervals: struct<months, days, micros>, ordered by their length with months of 30 days


def make_interval(years=0, months=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    n = lambda x: lit(x).cast("long")
    micros = ((n(hours) * 60 + n(minutes)) * 60 + n(seconds)) * 1_000_000
    return F.struct((n(years) * 12 + n(months)).alias("months"), n(days).alias("days"), micros.alias("micros"))


def interval_key(i: Column) -> Column:
    return (i["months"] * 30 + i["days"]).cast("decimal(38,0)") * F.lit(MICROS["DAY"]) + i["micros"]


def _carry(value: Column, unit: int) -> tuple[Column, Column]:
    """Whole units toward zero, and the rest."""
    rest = value % unit
    return ((value - rest) / unit).cast("long"), rest


def justify_hours(i: Column) -> Column:
    days, rest = _carry(i["micros"], MICROS["DAY"])
    return F.struct(i["months"].alias("months"), (i["days"] + days).alias("days"), rest.alias("micros"))


def justify_days(i: Column) -> Column:
    months, rest = _carry(i["days"], 30)
    return F.struct((i["months"] + months).alias("months"), rest.alias("days"), i["micros"].alias("micros"))


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


# times of day as microseconds after midnight


def time_of(x: Value) -> Column:
    return F.pmod(_micros(col(x)), F.lit(MICROS["DAY"]))


def time_add(t: Column, n, part: str) -> Column:
    """Wraps at midnight."""
    return F.pmod(t + lit(n).cast("long") * F.lit(MICROS[part]), F.lit(MICROS["DAY"]))


def time_trunc(t: Column, part: str) -> Column:
    return t - t % F.lit(MICROS[part])


def time_diff(a: Column, b: Column, part: str) -> Column:
    unit = F.lit(MICROS[part])
    return ((time_trunc(a, part) - time_trunc(b, part)) / unit).cast("long")


def format_time(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(t), "HH:mm:ss")
