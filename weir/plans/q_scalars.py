"""Queries of scalar functions, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar as S, temporal as T, udfs as U
from ..session import table
from .catalogue import query


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round(o_totalprice / (o_custkey % 7), 4) END AS d, o_totalprice - o_totalprice % 7 >= 0 AS p, CAST(trunc(o_totalprice) AS BIGINT) // 7 AS q, o_custkey % 13 AS m, CAST(sign(o_custkey - 700) AS DOUBLE) AS s FROM orders")
def q_safe_divide_mod(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    return o.select("o_orderkey", F.round(S.safe_divide("o_totalprice", k % 7), 4).alias("d"), (F.col("o_totalprice") - S.mod("o_totalprice", 7) >= 0).alias("p"), S.div(S.trunc("o_totalprice"), 7).alias("q"), S.mod("o_custkey", 13).alias("m"), F.signum(k - 700).alias("s"))


@query("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10, round(cbrt(c_acctbal), 6) AS cb, round(sin(c_acctbal), 6) AS si, round(atan2(c_acctbal, 3), 6) AS a2, round(exp(c_acctbal / 10000), 6) AS ex, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, trunc(c_acctbal) AS tr FROM customer")
def q_math(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(S.sqrt(F.abs(x)), 6).alias("sq"), F.round(S.ln(F.abs(x) + 1), 6).alias("l"), F.round(S.log10(F.abs(x) + 1), 6).alias("l10"), F.round(F.cbrt(x), 6).alias("cb"), F.round(F.sin(x), 6).alias("si"), F.round(F.atan2(x, F.lit(3.0)), 6).alias("a2"), F.round(F.exp(x / 10000), 6).alias("ex"), S.ceil(x).alias("ce"), S.floor(x).alias("fl"), S.trunc(x).alias("tr"))


@query("SELECT c_custkey, round(asinh(x), 6) AS ash, round(acosh(x + 1), 6) AS ach, round(atanh(x / 11), 6) AS ath, round(sinh(x), 5) AS sh, round(cosh(x), 5) AS ch, round(tanh(x), 6) AS th, round(1 / tan(x + 0.5), 4) AS ct, round(1 / cosh(x), 6) AS sc FROM (SELECT c_custkey, (c_custkey % 10)::DOUBLE AS x FROM customer)")
def q_trigonometry(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10).cast("double").alias("x"))
    x = F.col("x")
    return c.select("c_custkey", F.round(F.asinh(x), 6).alias("ash"), F.round(S.acosh(x + 1), 6).alias("ach"), F.round(S.atanh(x / 11), 6).alias("ath"), F.round(F.sinh(x), 5).alias("sh"), F.round(F.cosh(x), 5).alias("ch"), F.round(F.tanh(x), 6).alias("th"), F.round(S.cot(x + 0.5), 4).alias("ct"), F.round(S.sech(x), 6).alias("sc"))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN NULL ELSE greatest(c_nationkey, 7) END AS g, CASE WHEN c_nationkey > 20 THEN NULL ELSE least(c_nationkey, 7) END AS l, nullif(c_nationkey, 3) AS n, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS i, CAST(round(c_acctbal) AS BIGINT) AS r FROM customer")
def q_conditionals(spark, d):
    k = F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", S.greatest(k, F.lit(7).cast("long")).alias("g"), S.least(k, F.lit(7).cast("long")).alias("l"), S.nullif("c_nationkey", 3).alias("n"), S.if_(F.col("c_acctbal") > 0, "pos", "neg").alias("i"), S.to_int64("c_acctbal").alias("r"))


@query("SELECT o_orderkey, o_custkey & 255 AS a, o_custkey | 7 AS o, xor(o_custkey, 21) AS x, CAST(bit_count(o_custkey) AS BIGINT) AS c, o_custkey << 3 AS l, o_custkey >> 2 AS r FROM orders")
def q_bits(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", k.bitwiseAND(F.lit(255)).alias("a"), k.bitwiseOR(F.lit(7)).alias("o"), k.bitwiseXOR(F.lit(21)).alias("x"), F.bit_count(k).cast("long").alias("c"), S.shift_left(k, 3).alias("l"), S.shift_right(k, 2).alias("r"))


@query("SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, strpos(p_name, 'e') AS s, substr(p_name, 3, 4) AS sub, left(p_type, 5) AS le, right(p_type, 4) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, reverse(p_brand) AS rev, replace(p_type, 'E', 'e') AS rep, repeat(p_brand, 2) AS two, translate(p_brand, '#B', '-b') AS tr, starts_with(p_type, 'S') AS sw, ends_with(p_type, 'L') AS ew, split(p_name, ' ')[1] AS w1, ascii(p_name) AS a FROM part")
def q_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.length("p_name").cast("long").alias("n"), S.strpos("p_name", "e").alias("s"), S.substr("p_name", 3, 4).alias("sub"), S.left("p_type", 5).alias("le"), S.right("p_type", 4).alias("ri"), S.lpad("p_brand", 12, "*").alias("lp"), S.rpad("p_brand", 12, "-").alias("rp"), F.reverse("p_brand").alias("rev"), S.replace("p_type", "E", "e").alias("rep"), F.repeat("p_brand", 2).alias("two"), F.translate("p_brand", "#B", "-b").alias("tr"), S.starts_with("p_type", "S").alias("sw"), S.ends_with("p_type", "L").alias("ew"), F.get(S.split("p_name", " "), F.lit(0)).alias("w1"), F.ascii("p_name").alias("a"))


@query("SELECT p_partkey, levenshtein(p_brand, p_type) AS ed, regexp_matches(p_name, '^[a-m]') AS rc, nullif(regexp_extract(p_name, '([aeiou])[^ ]* ', 1), '') AS re, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS rr, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS ra, trim(p_name, 'aeiou') AS t, p_name LIKE '%e%' AS lk FROM part")
def q_regexp_edit(spark, d):
    return table(spark, d, "part").select("p_partkey", S.edit_distance("p_brand", F.col("p_type")).alias("ed"), S.regexp_contains("p_name", "^[a-m]").alias("rc"), S.regexp_extract("p_name", "([aeiou])[^ ]* ").alias("re"), S.regexp_replace("p_name", "([aeiou])", r"<\1>").alias("rr"), S.array_length(S.regexp_extract_all("p_name", "[aeiou]")).alias("ra"), S.trim("p_name", "aeiou").alias("t"), F.col("p_name").like("%e%").alias("lk"))


@query("SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2, lower(hex(p_brand)) AS h, base64(encode(p_brand)) AS b, CAST(unicode(p_name) AS BIGINT) AS u, list_transform(string_split(p_brand, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS cp, p_name AS back FROM part")
def q_hashes_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_hex(S.md5("p_name")).alias("m"), S.to_hex(S.sha1("p_name")).alias("s1"), S.to_hex(S.sha256("p_name")).alias("s2"), S.to_hex(F.encode("p_brand", "UTF-8")).alias("h"), F.base64(F.encode("p_brand", "UTF-8")).alias("b"), S.unicode_("p_name").alias("u"), S.to_code_points("p_brand").alias("cp"), S.code_points_to_string(S.to_code_points("p_name")).alias("back"))


@query("SELECT p_partkey, CAST(len(a) AS BIGINT) AS n, list_reverse(a) AS rev, a[1] AS f, a[-1] AS l, a[2:3] AS sl, array_to_string(a, '/') AS j, a || ['z'] AS cat, CAST(list_sum(list_transform(range(1, p_size + 1), lambda x: x)) AS BIGINT) AS g FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS a FROM part)")
def q_arrays(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", S.split("p_name", " ").alias("a"))
    a = F.col("a")
    return p.select("p_partkey", S.array_length(a).alias("n"), F.reverse(a).alias("rev"), S.array_first(a).alias("f"), S.array_last(a).alias("l"), S.array_slice(a, 1, 2).alias("sl"), S.array_to_string(a, "/").alias("j"), F.concat(a, F.array(F.lit("z"))).alias("cat"), F.aggregate(S.generate_array(F.lit(1).cast("long"), F.col("p_size")), F.lit(0).cast("long"), lambda s, x: s + x).alias("g"))


@query("SELECT p_partkey, CAST(len(list_filter([10.0, 20.0, 30.0, 40.0], lambda x: x <= p_size)) AS BIGINT) AS b FROM part")
def q_range_bucket(spark, d):
    bounds = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)])
    return table(spark, d, "part").select("p_partkey", S.range_bucket("p_size", bounds).alias("b"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS s, 'number' AS t, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS o FROM events")
def q_json_value_props(spark, d):
    return table(spark, d, "events").select("event_id", S.json_number("props", "$.k").alias("k"), S.json_value("props", "$.k").alias("s"), S.json_type("props", "$.k").alias("t"), S.json_object(("id", F.col("event_id")), ("kind", F.col("event_type"))).alias("o"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"new\":[1]}' AS s, '{}' AS r, ['k'] AS ks FROM events")
def q_json_mutators(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", U.json_set("$.new")("props", F.lit("[1]")).alias("s"), U.json_remove("$.k")("props").alias("r"), U.json_keys()("props").alias("ks"))


@query(
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, date_trunc('quarter', o_orderdate)::DATE AS q, date_trunc('week', o_orderdate)::DATE AS iw,
       (date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY)::DATE AS w, last_day(o_orderdate::DATE) AS ld, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS dow, dayofyear(o_orderdate) AS doy,
       CAST(isoyear(o_orderdate) AS BIGINT) AS iy, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk, (o_orderdate::DATE + INTERVAL 40 DAY)::DATE AS plus, (o_orderdate::DATE - INTERVAL 2 MONTH)::DATE AS less FROM orders"""
)
def q_date_trunc_parts(spark, d):
    x = "o_orderdate"
    return table(spark, d, "orders").select("o_orderkey", T.date_trunc(x, "MONTH").alias("m"), T.date_trunc(x, "QUARTER").alias("q"), T.date_trunc(x, "ISOWEEK").alias("iw"), T.date_trunc(x, "WEEK").alias("w"), T.last_day(x).alias("ld"), T.extract(x, "DAYOFWEEK").alias("dow"), T.extract(x, "DAYOFYEAR").alias("doy"), T.extract(x, "ISOYEAR").alias("iy"), T.extract(x, "ISOWEEK").alias("wk"), T.date_add(x, 40).alias("plus"), T.date_add(x, -2, "MONTH").alias("less"))


@query(
    """SELECT o_orderkey, date_diff('day', DATE '1995-06-17', o_orderdate::DATE) AS dd, date_diff('month', DATE '1995-06-17', o_orderdate::DATE) AS dm, date_diff('year', DATE '1995-06-17', o_orderdate::DATE) AS dy,
       CAST((date_trunc('week', o_orderdate)::DATE - DATE '1995-06-12') // 7 AS BIGINT) AS dw, date_diff('quarter', DATE '1995-06-17', o_orderdate::DATE) AS dq, date_sub('hour', TIMESTAMP '1995-06-17 10:30:00', o_orderdate) AS th FROM orders"""
)
def q_date_diff_parts(spark, d):
    x, o = "o_orderdate", F.lit("1995-06-17")
    return table(spark, d, "orders").select("o_orderkey", T.date_diff(x, o, "DAY").alias("dd"), T.date_diff(x, o, "MONTH").alias("dm"), T.date_diff(x, o, "YEAR").alias("dy"), T.date_diff(x, o, "ISOWEEK").alias("dw"), T.date_diff(x, o, "QUARTER").alias("dq"), T.timestamp_diff(x, F.lit("1995-06-17 10:30:00").cast("timestamp"), "HOUR").alias("th"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS f, strftime(ts, '%j %B %a') AS g, date_trunc('hour', ts) AS h, ts + INTERVAL 90 MINUTE AS p, epoch_us(ts) AS u, CAST(epoch_us(ts) // 1000000 % 86400 // 60 AS BIGINT) AS mins, date_trunc('second', ts) AS back FROM events")
def q_format_parse(spark, d):
    ts = F.col("ts")
    text = T.format_("%Y-%m-%d %H:%M:%S", ts)
    return table(spark, d, "events").select("event_id", T.format_("%Y/%m/%d %H-%M-%S", ts).alias("f"), T.format_("%j %B %a", ts).alias("g"), T.datetime_trunc(ts, "HOUR").alias("h"), T.datetime_add(ts, 90, "MINUTE").alias("p"), F.unix_micros(ts.cast("timestamp")).alias("u"), T.time_diff(T.time_of(ts), F.lit(0).cast("long"), "MINUTE").alias("mins"), T.parse_datetime("%Y-%m-%d %H:%M:%S", text).alias("back"))


@query("SELECT o_orderkey, CAST(4 * ((epoch_us(o_orderdate) // 86400000000 + 7305) // 4) - 7305 AS BIGINT) AS b, CAST(len(generate_series(o_orderdate::DATE, o_orderdate::DATE + 9, INTERVAL 3 DAY)) AS BIGINT) AS n FROM orders")
def q_date_bucket_array(spark, d):
    x = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.unix_date(T.date_bucket(x, 4)).cast("long").alias("b"), S.array_length(T.generate_date_array(x, F.date_add(x, 9), 3)).alias("n"))


@query("SELECT o_orderkey, (o_custkey % 50) // 30 + 2 AS months, (o_custkey % 50) % 30 AS days, 36000000000 AS micros FROM orders")
def q_intervals(spark, d):
    i = T.justify_days(T.make_interval(months=2, days=F.col("o_custkey") % 50, hours=10))
    return table(spark, d, "orders").select("o_orderkey", i["months"].alias("months"), i["days"].alias("days"), i["micros"].alias("micros"))


@query("SELECT o_orderkey, o_orderdate::DATE <= DATE '1996-03-01' AND DATE '1996-03-01' < o_orderdate::DATE + 100 AS c, o_orderdate::DATE < DATE '1997-01-01' AND DATE '1996-01-01' < o_orderdate::DATE + 100 AS o, CAST(ceil(100 / 30.0) AS BIGINT) AS n FROM orders")
def q_ranges(spark, d):
    x = F.col("o_orderdate").cast("date")
    r, year = S.range_(x, F.date_add(x, 100)), S.range_(F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", S.range_contains(r, F.lit("1996-03-01").cast("date")).alias("c"), S.range_overlaps(r, year).alias("o"), S.array_length(S.generate_range_array(r, 30)).alias("n"))


@query("SELECT page_id, nullif(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '') AS h FROM pages")
def q_net_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("h"))


@query("SELECT c_custkey, (c_custkey % 256) || '.0.2.' || (c_custkey % 7) AS ip, (c_custkey % 256) * 16777216 + 512 + c_custkey % 7 AS n, (c_custkey % 256) || '.0.0.0' AS net FROM customer")
def q_net_ip(spark, d):
    k = F.col("c_custkey")
    text = F.concat((k % 256).cast("string"), F.lit(".0.2."), (k % 7).cast("string"))
    ip = U.ip_from_string(text)
    return table(spark, d, "customer").select("c_custkey", U.ip_to_string(ip).alias("ip"), U.ipv4_to_int64(ip).alias("n"), U.ip_to_string(U.ip_trunc(ip, F.lit(8))).alias("net"))


@query("SELECT q.vec_id AS q, e.vec_id, round(1 - list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS c, round(list_distance(e.v, q.v), 5) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.v, q.v), e.vec_id) <= 10")
def q_vector_distances(spark, d):
    """The ten nearest of all rows to each row whose id is divisible by 50."""
    from ..operators.vectors import nearest

    e = table(spark, d, "embeddings")
    near = nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return near.select("q", "vec_id", F.round(1 - F.col("dot") / (F.sqrt("ee") * F.sqrt("qq")), 6).alias("c"), F.round("d", 5).alias("e"))


@query("SELECT c_custkey, round(2 * 6371010 * asin(sqrt(sin(radians(lat - 10) / 2) ^ 2 + cos(radians(lat)) * cos(radians(10)) * sin(radians(lng - 20) / 2) ^ 2)), 3) AS m FROM (SELECT c_custkey, (c_custkey % 360 - 180)::DOUBLE AS lng, (c_custkey % 170 - 85)::DOUBLE AS lat FROM customer)")
def q_st_distance(spark, d):
    p = geo.geogpoint((F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_custkey") % 170 - 85).cast("double"))
    return table(spark, d, "customer").select("c_custkey", F.round(geo.st_distance(p, geo.geogpoint(F.lit(20.0), F.lit(10.0))), 3).alias("m"))


@query("SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey, radians(c_custkey % 360 - 180) AS g, radians(c_custkey % 170 - 85) AS t FROM customer) a, (SELECT s_suppkey, radians((s_suppkey * 7) % 360 - 180) AS g, radians((s_suppkey * 3) % 170 - 85) AS t FROM supplier) b WHERE 2 * 6371010 * asin(sqrt(least(1, sin((b.t - a.t) / 2) ^ 2 + cos(a.t) * cos(b.t) * sin((b.g - a.g) / 2) ^ 2))) <= 500000.5")
def q_st_dwithin_join(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, d, "customer").select(c.alias("a"), geo.geogpoint((c % 360 - 180).cast("double"), (c % 170 - 85).cast("double")).alias("p"))
    b = table(spark, d, "supplier").select(s.alias("b"), geo.geogpoint((s * 7 % 360 - 180).cast("double"), (s * 3 % 170 - 85).cast("double")).alias("q"))
    return geo.dwithin_join(a, b, "p", "q", 500000.5).select("a", "b")
