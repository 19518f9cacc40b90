"""Edge cases of scalar functions, on literals."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weir.functions import aggregates as A
from weir.functions import crypto, geo, wide
from weir.functions import scalar as S
from weir.functions import temporal as T
from weir.functions import udfs as U

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def one(spark):
    return lambda *cols: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def L(x):
    return F.lit(x)


def D(x):
    return F.lit(x).cast("date")


def test_division(one):
    assert one(S.safe_divide(L(1.0), 0), S.safe_divide(L(1e308), 1e-10), S.div(L(-7), 2), S.mod(L(-7), 2)) == (None, None, -3, -1)
    got = one(S.ieee_divide(L(1.0), 0.0), S.ieee_divide(L(-1.0), 0.0), S.ieee_divide(L(0.0), 0.0), S.ieee_divide(L(6.0), 4.0))
    assert got[0] == INF and got[1] == -INF and math.isnan(got[2]) and got[3] == 1.5


def test_nan_and_null(one):
    assert one(S.eq(L(NAN), L(NAN)), S.less(L(1.0), L(NAN)), S.is_nan(L(None).cast("double")), S.is_inf(L(-INF))) == (False, False, None, True)
    assert one(S.greatest(L(1), L(None).cast("int")), S.least(L(3), L(2)), S.to_int64(L(2.5)), S.to_int64(L(-2.5))) == (None, 2, 3, -3)


def test_order_puts_nan_below_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, NAN, None, -INF, 5.0)], "x double")
    got = [r[0] for r in df.orderBy(*S.order_keys("x", is_float=True)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [-INF, 1.0, 5.0]
    assert math.isnan(spark.createDataFrame([(1.0,), (NAN,)], "x double").agg(A.min_("x")).first()[0])


def test_domains(one):
    for expression in (lambda: S.sqrt(L(-1.0)), lambda: S.ln(L(0.0)), lambda: S.acos(L(2.0)), lambda: S.atanh(L(1.0)), lambda: S.cot(L(0.0))):
        with pytest.raises(Exception, match="domain"):
            one(expression())
    assert one(S.sqrt(L(None).cast("double")), S.log(L(8.0), 2.0)) == (None, pytest.approx(3.0))


def test_rounding(one):
    assert one(S.round_(L(2.5)), S.round_(L(2.5), 0, "ROUND_HALF_EVEN"), S.trunc(L(-2.79), 1), S.ceil(L(1.2)), S.floor(L(-1.2))) == (3.0, 2.0, -2.7, 2.0, -2.0)


def test_bits(one):
    assert one(S.shift_left(L(1), 63), S.shift_left(L(1), 64), S.shift_right(L(-1), 63)) == (-(2**63), 0, 1)


def test_strings(one):
    assert one(S.substr(L("abc"), -5, 3), S.substr(L("abcdef"), -2), S.substr(L("abc"), 0, 2), S.instr(L("banana"), "an", 1, 2)) == ("abc", "ef", "ab", 4)
    assert one(S.split(L("a.b..c"), "."), S.split(L("añb"), "")) == (["a", "b", "", "c"], ["a", "ñ", "b"])
    assert one(S.regexp_extract(L("x12y3"), r"(\d+)", 2), S.regexp_extract(L("abc"), r"\d"), S.regexp_replace(L("ab"), "(a)(b)", r"\2$\1")) == ("3", None, "b$a")
    assert one(S.initcap(L("hello wORLD-foo_bar")), S.chr_(L(0x1F600)), S.unicode_(L("é")), S.code_points_to_string(F.array(L(72), L(233)))) == ("Hello World-Foo_Bar", "😀", 233, "Hé")
    assert one(S.edit_distance(L("kitten"), "sitting"), S.edit_distance(L("kitten"), "sitting", 2), S.trim(L("  a \t")), S.soundex(L(""))) == (3, 2, "a", "")
    assert one(S.from_hex(L("abc")), S.to_hex(S.from_hex(L("0aff")))) == (bytearray(b"\x0a\xbc"), "0aff")


def test_arrays(one):
    a = F.array(L(1), L(2), L(3))
    assert one(S.array_slice(a, -2, -1), S.array_slice(a, 1, 9), S.array_slice(a, 2, 1), S.safe_offset(a, 7)) == ([2, 3], [2, 3], [], None)
    assert one(S.generate_array(1, 7, 3), S.generate_array(5, 1), S.generate_array(5, 1, -2), S.range_bucket(L(20), F.array(L(0), L(10), L(20)))) == ([1, 4, 7], [], [5, 3, 1], 3)
    with pytest.raises(Exception, match="ARRAY_FIRST"):
        one(S.array_first(F.slice(a, 1, 0)))


def test_array_agg_modifiers(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    got = {r[0]: tuple(r[1:]) for r in df.groupBy("k").agg(A.array_agg("v", order_by=[F.col("v")]), A.array_agg("v", distinct=True, ignore_nulls=True), A.array_agg("v", ignore_nulls=True, order_by=[F.col("v")], limit=1), A.string_agg("v", "-", order_by=[F.col("v")])).collect()}
    assert got == {1: ([None, "a", "b", "b"], ["a", "b"], ["a"], "a-b-b"), 2: ([None], None, None, None)}
    assert df.where("k = 9").agg(A.array_agg("v")).first()[0] is None


def test_json(one):
    j = L('{"a":{"b":[1,2,{"c":null}]},"s":"x","t":true}')
    assert one(S.json_value(j, "$.a"), S.json_value(j, "$.s"), S.json_type(j, "$.a.b"), S.json_type(j, "$.t"), S.json_query(j, "$.a.b[0]")) == (None, "x", "array", "boolean", "1")
    assert one(U.json_set("$.a.n[1]")(L('{"a":{}}'), L("5")), U.json_remove("$.a[0]")(L('{"a":[1,2]}')), U.json_array_insert("$[1]")(L("[1,3]"), L("2"))) == ('{"a":{"n":[null,5]}}', '{"a":[2]}', "[1,2,3]")
    assert one(U.json_strip_nulls(remove_empty=True)(L('{"a":null,"b":[null,{}],"c":1}')), U.json_keys()(j), U.json_flatten()(L("[1,[2,[3]]]"))) == ('{"c":1}', ["a", "a.b", "s", "t"], ["1", "2", "3"])
    assert one(S.lax(L("2.5")), S.lax(L('"x"')), S.to_json_string(L(1.5)), S.to_json_string(L("q"))) == (3, None, "1.5", '"q"')


def test_dates(one):
    assert one(T.date_trunc(D("2024-02-14"), "WEEK"), T.date_trunc(D("2024-02-14"), "ISOWEEK"), T.date_trunc(D("2024-02-14"), "WEEK(FRIDAY)"), T.date_trunc(D("2021-01-02"), "ISOYEAR")) == (dt.date(2024, 2, 11), dt.date(2024, 2, 12), dt.date(2024, 2, 9), dt.date(2019, 12, 30))
    assert one(T.date_diff(D("2024-01-07"), D("2024-01-06"), "WEEK"), T.date_diff(D("2024-01-08"), D("2024-01-07"), "ISOWEEK"), T.date_diff(D("2024-01-01"), D("2023-12-31"), "YEAR"), T.date_diff(D("2024-04-01"), D("2024-03-31"), "QUARTER")) == (1, 1, 1, 1)
    assert one(T.last_day(D("2024-02-03")), T.last_day(D("2024-02-03"), "QUARTER"), T.last_day(D("2024-02-03"), "WEEK"), T.last_day(D("2021-01-02"), "ISOYEAR")) == (dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 2, 3), dt.date(2021, 1, 3))
    assert one(T.date_add(D("2024-01-31"), 1, "MONTH"), T.date_bucket(D("1949-12-31"), 2), T.date_bucket(D("2024-05-20"), 3, "MONTH"), T.extract(D("2024-01-06"), "WEEK"), T.extract(D("2024-01-07"), "WEEK")) == (dt.date(2024, 2, 29), dt.date(1949, 12, 30), dt.date(2024, 4, 1), 0, 1)


def test_timestamps(one):
    ts = lambda s: L(s).cast("timestamp_ntz")
    assert one(T.datetime_diff(ts("2024-01-01 01:00:00"), ts("2024-01-01 00:59:59"), "HOUR"), T.timestamp_diff(L("2024-01-01 01:00:00").cast("timestamp"), L("2024-01-01 00:59:59").cast("timestamp"), "HOUR")) == (1, 0)
    assert one(T.datetime_bucket(ts("2024-01-01 07:30:00"), 6, "HOUR"), T.datetime_add(ts("2024-01-31 00:00:00"), 1, "MONTH"), T.datetime_trunc(ts("2024-01-01 07:31:15"), "MINUTE")) == (dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 2, 29), dt.datetime(2024, 1, 1, 7, 31))
    assert one(T.format_("%A %d %b %Y at %H:%M", ts("2024-01-01 07:30:00")), T.parse_date("%d/%m/%Y", L("03/02/2024"))) == ("Monday 01 Jan 2024 at 07:30", dt.date(2024, 2, 3))
    assert one(T.format_time(T.time_add(T.time_of(ts("2024-01-01 23:30:00")), 45, "MINUTE")), T.time_diff(T.time_of(ts("2024-01-01 02:00:00")), T.time_of(ts("2024-01-01 01:59:00")), "HOUR")) == ("00:15:00", 1)


def test_intervals(one):
    i = T.justify_interval(T.make_interval(days=35, hours=-26))
    assert one(i["months"], i["days"], i["micros"]) == (1, 4, -2 * 3600 * 10**6)
    assert one(T.interval_key(T.make_interval(months=1)) == T.interval_key(T.make_interval(days=30)))[0]


def test_ranges(one):
    r, q = S.range_(D("2024-01-01"), D("2024-02-01")), S.range_(D("2024-01-20"), L(None).cast("date"))
    assert one(S.range_overlaps(r, q), S.range_contains(r, D("2024-02-01")), S.range_contains(q, D("9999-01-01")), S.range_intersect(r, q)["end"]) == (True, False, True, dt.date(2024, 2, 1))
    assert one(F.size(S.generate_range_array(r, 10)), F.size(S.generate_range_array(r, 10, False))) == (4, 3)


def test_net(one):
    assert one(U.host(L("HTTP://user@WWW.Example.CO.UK:80/p?q")), U.reg_domain(L("http://a.b.example.co.uk/x")), U.public_suffix(L("x.org")), U.safe_ip_from_string(L("1.2.3"))) == ("www.example.co.uk", "example.co.uk", "org", None)
    assert one(U.ip_to_string(U.ip_net_mask(L(4), L(20))), U.ipv4_to_int64(U.ipv4_from_int64(L(3232235777))), U.ip_to_string(U.ip_trunc(U.ip_from_string(L("2001:db8::1")), L(32)))) == ("255.255.240.0", 3232235777, "2001:db8::")


def test_wide_decimals(one):
    assert one(wide.add(L("0.1"), L("0.2")), wide.multiply(L("9999999999"), L("9999999999")), wide.divide(L("1"), L("3"))) == ("0.3", "99999999980000000001", "0." + "3" * 38)
    with pytest.raises(Exception, match="overflow"):
        one(wide.multiply(L("9" * 30), L("9" * 30)))


def test_aead(one):
    keys = crypto.new_keyset()
    assert crypto.keyset_length(crypto.rotate_keyset(keys)) == 2
    c = crypto.encrypt(keys, L("héllo"), L("ctx"))
    assert one(crypto.decrypt_string(crypto.rotate_keyset(keys), c, L("ctx")))[0] == "héllo"
    with pytest.raises(Exception):
        one(crypto.decrypt_string(keys, c, L("other")))


def test_geography(one):
    p = lambda x, y: geo.geogpoint(L(float(x)), L(float(y)))
    d, az = one(geo.st_distance(p(0, 0), p(0, 1)), geo.st_azimuth(p(0, 0), p(1, 0)))
    assert d == pytest.approx(math.radians(1) * geo.RADIUS) and az == pytest.approx(math.pi / 2)
    line = F.array(p(0, 0), p(0, 1), p(0, 2))
    assert one(geo.st_length(line) / geo.st_distance(p(0, 0), p(0, 2)), geo.st_numpoints(line), geo.st_dwithin(p(179.9, 0), p(-179.9, 0), 30000.0))[1:] == (3, True)
    assert one(geo.st_geohash(p(-5.6, 42.6), 5), geo.st_asgeojson(p(1, 2)), geo.st_y(p(1, 2))) == ("ezs42", '{"type":"Point","coordinates":[1.0,2.0]}', 2.0)
