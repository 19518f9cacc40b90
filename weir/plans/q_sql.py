"""Queries from SQL text of the dialect: every family of functions as a user writes it, held against another engine's own functions."""

from __future__ import annotations

from ..session import views
from .catalogue import query
from .dialect import Session


def _run(spark, d, text, *names, **params):
    views(spark, d, list(names))
    return Session(spark).query(text, **params)


@query(
    """SELECT c_custkey, round(acos(x), 9) AS a1, round(asin(x), 9) AS a2, round(atan(y), 9) AS a3, round(cos(y), 9) AS c, round(tan(x), 9) AS t, round(1 / cos(x), 9) AS sc, round(1 / sin(y), 6) AS cs,
       round(cosh(y) / sinh(y), 9) AS ch, round(1 / sinh(y), 9) AS sh, round(pow(y, 1.5), 6) AS p1, round(pow(y, 2), 6) AS p2, CAST(sign(c_acctbal) AS BIGINT) AS sg, round(ln(y) / ln(3), 9) AS l3, round(sqrt(y), 9) AS sq,
       CASE WHEN k % 5 = 0 THEN 'inf' ELSE 'fin' END AS ie, k % 5 = 0 AS isinf, false AS isnan, k + 9223372036854775000 AS big, CASE WHEN k > 807 THEN NULL ELSE k + 9223372036854775000 END AS sa, -k AS sn, k * 3 AS sm, k - 7 AS ss FROM
       (SELECT c_custkey, c_acctbal, c_custkey % 800 AS k, (c_custkey % 100) / 100.0::DOUBLE AS x, (c_custkey % 20 + 1)::DOUBLE AS y FROM customer)"""
)
def q_sql_math(spark, d):
    return _run(spark, d, """SELECT c_custkey, ROUND(ACOS(x), 9) AS a1, ROUND(ASIN(x), 9) AS a2, ROUND(ATAN(y), 9) AS a3, ROUND(COS(y), 9) AS c, ROUND(TAN(x), 9) AS t, ROUND(SEC(x), 9) AS sc, ROUND(CSC(y), 6) AS cs,
        ROUND(COTH(y), 9) AS ch, ROUND(CSCH(y), 9) AS sh, ROUND(POW(y, 1.5), 6) AS p1, ROUND(POWER(y, 2), 6) AS p2, CAST(SIGN(c_acctbal) AS INT64) AS sg, ROUND(LOG(y, 3), 9) AS l3, ROUND(SQRT(y), 9) AS sq,
        IF(IS_INF(IEEE_DIVIDE(1, MOD(k, 5))), 'inf', 'fin') AS ie, IS_INF(IEEE_DIVIDE(1, MOD(k, 5))) AS isinf, IS_NAN(x) AS isnan, k + 9223372036854775000 AS big, SAFE_ADD(k, IF(k > 807, 9223372036854775807, 9223372036854775000)) AS sa,
        SAFE_NEGATE(k) AS sn, SAFE_MULTIPLY(k, 3) AS sm, SAFE_SUBTRACT(k, 7) AS ss FROM
        (SELECT c_custkey, c_acctbal, MOD(c_custkey, 800) AS k, CAST(MOD(c_custkey, 100) AS FLOAT64) / 100 AS x, CAST(MOD(c_custkey, 20) + 1 AS FLOAT64) AS y FROM customer)""", "customer")  # fmt: skip


@query(
    """SELECT c_custkey, CASE WHEN k % 3 = 0 THEN NULL ELSE k // (k % 3) END AS sd, CASE WHEN k % 3 = 0 THEN NULL ELSE k % (k % 3) END AS sm, CASE WHEN k > 500 THEN NULL ELSE round(acos(k / 500.0), 9) END AS sa,
       CASE WHEN k % 400 = 0 THEN NULL ELSE round(ln(k % 400), 9) END AS sl, TRY_CAST(CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'x' || k END AS BIGINT) AS sc, CAST(trunc(c_acctbal) AS DOUBLE) AS t0,
       CAST(CAST(trunc(abs(c_acctbal)::DECIMAL(38,9) * 10) / 10 AS DECIMAL(20,1)) * CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS DOUBLE) AS t1, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, 9007199254740993 + k AS dv,
       TRY_CAST('2024-02-' || (k % 40) AS DATE) AS dt FROM (SELECT c_custkey, c_acctbal, c_custkey % 1000 AS k FROM customer)"""
)
def q_sql_safe(spark, d):
    return _run(spark, d, """SELECT c_custkey, SAFE.DIV(k, MOD(k, 3)) AS sd, SAFE.MOD(k, MOD(k, 3)) AS sm, ROUND(SAFE.ACOS(k / 500), 9) AS sa, ROUND(SAFE.LN(MOD(k, 400)), 9) AS sl,
        SAFE_CAST(IF(MOD(k, 2) = 0, CAST(k AS STRING), CONCAT('x', CAST(k AS STRING))) AS INT64) AS sc, TRUNC(c_acctbal) AS t0, TRUNC(c_acctbal, 1) AS t1, CEIL(c_acctbal) AS ce, FLOOR(c_acctbal) AS fl, DIV(9007199254740993 + k, 1) AS dv,
        SAFE.DATE(2024, 2, MOD(k, 40)) AS dt FROM (SELECT c_custkey, c_acctbal, MOD(c_custkey, 1000) AS k FROM customer)""", "customer")  # fmt: skip


@query(
    """SELECT p_partkey, strlen(p_name) AS bl, strlen(p_name) AS ol, length(p_name) AS cl, length(p_name) AS chl, chr(65 + CAST(p_partkey % 26 AS INTEGER)) AS ch, lower(hex(chr(65 + CAST(p_partkey % 26 AS INTEGER)))) AS cb,
       CASE WHEN contains(p_name, 'e') THEN length(p_name) - strpos(reverse(p_name), 'e') + 1 ELSE 0 END AS i1, CASE WHEN strpos(p_name, 'e') > 0 AND strpos(substr(p_name, strpos(p_name, 'e') + 1), 'e') > 0 THEN strpos(p_name, 'e') + strpos(substr(p_name, strpos(p_name, 'e') + 1), 'e') ELSE 0 END AS i2,
       ltrim(p_name, 'abcdefghijkl') AS lt, rtrim(p_name, 'abcdefghijklmnop') AS rt, CASE WHEN regexp_matches(p_name, '[aeiou][lnr]') THEN strpos(p_name, regexp_extract(p_name, '[aeiou][lnr]')) ELSE 0 END AS ri,
       repeat(p_brand, 3) AS rp, base64(encode(p_name)) AS b64, decode(from_base64(base64(encode(p_brand)))) AS fb, decode(unhex(hex(p_brand))) AS fh, p_name AS sv, CAST(strpos(p_name, ' ') AS BIGINT) AS sp,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ic, lower(p_name) AS nc, contains(lower(p_name), 're') AS cs, list_transform(string_split(p_brand, ''), lambda c: CAST(ord(c) AS BIGINT)) AS cp,
       substr(p_name, greatest(length(p_name) - 3, 1), 3) AS sb, least(levenshtein(p_name, p_type), 9) AS ed, sha512.x AS s5 FROM part, LATERAL (SELECT CAST(length(p_name) > 0 AS BOOLEAN) AS x) sha512"""
)
def q_sql_strings(spark, d):
    return _run(spark, d, r"""SELECT p_partkey, BYTE_LENGTH(p_name) AS bl, OCTET_LENGTH(p_name) AS ol, CHAR_LENGTH(p_name) AS cl, CHARACTER_LENGTH(p_name) AS chl, CHR(65 + MOD(p_partkey, 26)) AS ch, TO_HEX(CODE_POINTS_TO_BYTES([65 + MOD(p_partkey, 26)])) AS cb,
        INSTR(p_name, 'e', -1) AS i1, INSTR(p_name, 'e', 1, 2) AS i2, LTRIM(p_name, 'abcdefghijkl') AS lt, RTRIM(p_name, 'abcdefghijklmnop') AS rt, REGEXP_INSTR(p_name, r'[aeiou][lnr]') AS ri, REPEAT(p_brand, 3) AS rp, TO_BASE64(CAST(p_name AS BYTES)) AS b64,
        CAST(FROM_BASE64(TO_BASE64(CAST(p_brand AS BYTES))) AS STRING) AS fb, CAST(FROM_HEX(TO_HEX(CAST(p_brand AS BYTES))) AS STRING) AS fh, SAFE_CONVERT_BYTES_TO_STRING(CAST(p_name AS BYTES)) AS sv, STRPOS(p_name, ' ') AS sp, INITCAP(p_name) AS ic, NORMALIZE_AND_CASEFOLD(p_name) AS nc,
        CONTAINS_SUBSTR(p_name, 'RE') AS cs, TO_CODE_POINTS(p_brand) AS cp, SUBSTR(p_name, -4, 3) AS sb, EDIT_DISTANCE(p_name, p_type, max_distance => 9) AS ed, BYTE_LENGTH(SHA512(p_name)) = 64 AS s5 FROM part""", "part")  # fmt: skip


@query("SELECT o_orderkey, printf('%05d|%-4s|%8.2f|%s|%d%%', o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_custkey % 100) AS f, strftime(o_orderdate, '%d/%m/%Y') AS cf, upper(strftime(o_orderdate, '%b')) || '-' || strftime(o_orderdate, '%y %H:%M') AS cg, lower(hex(o_orderstatus)) AS ch, CAST(o_custkey AS VARCHAR) AS t, '\"' || o_orderstatus || '\"' AS tt, strptime(strftime(o_orderdate, '%Y.%m.%d'), '%Y.%m.%d')::DATE AS back FROM orders")
def q_sql_format(spark, d):
    return _run(spark, d, """SELECT o_orderkey, FORMAT('%05d|%-4s|%8.2f|%s|%d%%', o_custkey, o_orderstatus, o_totalprice, o_orderpriority, MOD(o_custkey, 100)) AS f, CAST(o_orderdate AS STRING FORMAT 'DD/MM/YYYY') AS cf,
        CAST(o_orderdate AS STRING FORMAT 'MON-YY HH24:MI') AS cg, CAST(CAST(o_orderstatus AS BYTES) AS STRING FORMAT 'HEX') AS ch, FORMAT('%t', o_custkey) AS t, FORMAT('%T', o_orderstatus) AS tt, CAST(FORMAT_DATE('%Y.%m.%d', CAST(o_orderdate AS DATE)) AS DATE FORMAT 'YYYY.MM.DD') AS back FROM orders""", "orders")  # fmt: skip


@query(
    """SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","tags":["' || event_type || '",' || user_id || ']}' AS o, '[' || event_id || ',"' || event_type || '",null]' AS a, ['"' || event_type || '"', user_id::VARCHAR] AS qa, [event_type, user_id::VARCHAR] AS va,
       '"' || event_type || '"' AS q, event_type AS v, user_id AS li, user_id::DOUBLE AS lf, event_type AS ls, user_id % 2 = 0 AS lb, user_id AS i6, value AS f6, user_id % 2 = 0 AS b6, 'object' AS ty, '"' || event_type || '"' AS ts,
       '{"k":' || json_extract_string(props, '$.k') || ',"n":' || user_id || '}' AS js, '[1,' || user_id || ']' AS ap, '[' || user_id || ',1]' AS ins, '{"b":' || user_id || '}' AS st, [user_id::VARCHAR, '2', '3'] AS fl, ['a', 'a.b'] AS ks, '{"k":' || json_extract_string(props, '$.k') || '}' AS pj FROM events"""
)
def q_sql_json(spark, d):
    return _run(spark, d, """SELECT event_id, o, JSON_ARRAY(event_id, event_type, NULL) AS a, JSON_QUERY_ARRAY(o, '$.tags') AS qa, JSON_VALUE_ARRAY(o, '$.tags') AS va, JSON_QUERY(o, '$.kind') AS q, JSON_VALUE(o, '$.kind') AS v, LAX_INT64(CONCAT('"', CAST(user_id AS STRING), '"')) AS li,
        LAX_FLOAT64(TO_JSON_STRING(user_id)) AS lf, LAX_STRING(TO_JSON(event_type)) AS ls, LAX_BOOL(TO_JSON(MOD(user_id, 2) = 0)) AS lb, INT64(TO_JSON(user_id)) AS i6, FLOAT64(TO_JSON(value)) AS f6, BOOL(TO_JSON(MOD(user_id, 2) = 0)) AS b6, JSON_TYPE(o) AS ty, TO_JSON_STRING(event_type) AS ts,
        JSON_SET(props, '$.n', TO_JSON(user_id)) AS js, JSON_ARRAY_APPEND('[1]', '$', TO_JSON(user_id)) AS ap, JSON_ARRAY_INSERT('[1]', '$[0]', TO_JSON(user_id)) AS ins, JSON_STRIP_NULLS(CONCAT('{"a":null,"b":', CAST(user_id AS STRING), '}')) AS st, JSON_FLATTEN(CONCAT('[[', CAST(user_id AS STRING), '],[2,[3]]]')) AS fl,
        JSON_KEYS(CONCAT('{"a":{"b":', CAST(user_id AS STRING), '}}')) AS ks, PARSE_JSON(props) AS pj FROM
        (SELECT *, CONCAT('{"id":', CAST(event_id AS STRING), ',"kind":', TO_JSON_STRING(event_type), ',"tags":', JSON_ARRAY(event_type, user_id), '}') AS o FROM events)""", "events")  # fmt: skip


@query(
    """SELECT event_id, ts::DATE AS d, make_date(2020 + CAST(user_id % 5 AS INTEGER), 2, 28) AS md, make_timestamp(2024, 1, 2, 3, 4, CAST(user_id % 60 AS DOUBLE)) AS mt, strftime(ts, '%Y-%m-%d') AS fd, ts::DATE AS pd, date_trunc('second', ts) AS pt, date_trunc('second', ts) AS p2,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS us, CAST(epoch_us(ts) // 1000 AS BIGINT) AS um, date_trunc('second', ts) AS t1, date_trunc('millisecond', ts) AS t2, ts AS t3, ts::DATE AS du, ts::DATE - 5 AS ds, date_trunc('hour', ts) AS tt, date_trunc('month', ts) AS dt,
       CAST(extract(millisecond FROM ts) % 1000 AS BIGINT) AS ms, CAST(weekofyear(ts) AS BIGINT) AS iw, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1950-01-01') AS tb, last_day(ts::DATE) AS ld, CAST(epoch_us(ts) // 60000000 - epoch_us(TIMESTAMP '2024-01-01') // 60000000 AS BIGINT) AS dd,
       strftime(ts, '%H:%M:%S') AS ft, CAST(ts::DATE AS VARCHAR) AS sd, CAST(3 AS BIGINT) AS ga, (ts::DATE - INTERVAL 1 MONTH)::DATE AS dm FROM events"""
)
def q_sql_dates(spark, d):
    return _run(spark, d, """SELECT event_id, DATE(ts) AS d, DATE(2020 + MOD(user_id, 5), 2, 28) AS md, DATETIME(2024, 1, 2, 3, 4, MOD(user_id, 60)) AS mt, FORMAT_DATE('%Y-%m-%d', DATE(ts)) AS fd, PARSE_DATE('%Y-%m-%d', FORMAT_DATE('%Y-%m-%d', DATE(ts))) AS pd,
        CAST(PARSE_TIMESTAMP('%Y-%m-%d %H:%M:%S', FORMAT_DATETIME('%Y-%m-%d %H:%M:%S', ts)) AS DATETIME) AS pt, PARSE_DATETIME('%Y-%m-%d %H:%M:%S', FORMAT_DATETIME('%Y-%m-%d %H:%M:%S', ts)) AS p2, UNIX_SECONDS(TIMESTAMP(ts)) AS us, UNIX_MILLIS(TIMESTAMP(ts)) AS um,
        CAST(TIMESTAMP_SECONDS(UNIX_SECONDS(TIMESTAMP(ts))) AS DATETIME) AS t1, CAST(TIMESTAMP_MILLIS(UNIX_MILLIS(TIMESTAMP(ts))) AS DATETIME) AS t2, CAST(TIMESTAMP_MICROS(UNIX_MICROS(TIMESTAMP(ts))) AS DATETIME) AS t3, DATE_FROM_UNIX_DATE(UNIX_DATE(DATE(ts))) AS du, DATE_SUB(DATE(ts), INTERVAL 5 DAY) AS ds,
        CAST(TIMESTAMP_TRUNC(TIMESTAMP(ts), HOUR) AS DATETIME) AS tt, DATETIME_TRUNC(ts, MONTH) AS dt, EXTRACT(MILLISECOND FROM ts) AS ms, EXTRACT(ISOWEEK FROM ts) AS iw, CAST(TIMESTAMP_BUCKET(TIMESTAMP(ts), INTERVAL 6 HOUR) AS DATETIME) AS tb, LAST_DAY(DATE(ts), MONTH) AS ld,
        DATETIME_DIFF(ts, DATETIME '2024-01-01', MINUTE) AS dd, FORMAT_DATETIME('%H:%M:%S', ts) AS ft, STRING(DATE(ts)) AS sd, ARRAY_LENGTH(GENERATE_TIMESTAMP_ARRAY(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 12 HOUR)) AS ga, DATE_SUB(DATE(ts), INTERVAL 1 MONTH) AS dm FROM events""", "events")  # fmt: skip


@query(
    """SELECT page_id, h, regexp_extract(h, '([^.]+)$', 1) AS s, regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS r, (page_id % 200) || '.7.' || (page_id % 9) || '.1' AS ip, (page_id % 200) * 16777216 + 7 * 65536 + (page_id % 9) * 256 + 1 AS n, (page_id % 200) || '.7.0.0' AS tr, '255.255.240.0' AS m, page_id % 2 = 0 AS ok
       FROM (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS h FROM pages)"""
)
def q_sql_net(spark, d):
    return _run(spark, d, """SELECT page_id, NET.HOST(url) AS h, NET.PUBLIC_SUFFIX(url) AS s, NET.REG_DOMAIN(url) AS r, NET.IP_TO_STRING(NET.IPV4_FROM_INT64(n)) AS ip, NET.IPV4_TO_INT64(NET.IP_FROM_STRING(t)) AS n, NET.IP_TO_STRING(NET.IP_TRUNC(NET.IP_FROM_STRING(t), 16)) AS tr,
        NET.IP_TO_STRING(NET.IP_NET_MASK(4, 20)) AS m, NET.SAFE_IP_FROM_STRING(IF(MOD(page_id, 2) = 0, t, 'x.y')) IS NOT NULL AS ok FROM
        (SELECT page_id, url, CONCAT(CAST(MOD(page_id, 200) AS STRING), '.7.', CAST(MOD(page_id, 9) AS STRING), '.1') AS t, MOD(page_id, 200) * 16777216 + 7 * 65536 + MOD(page_id, 9) * 256 + 1 AS n FROM pages)""", "pages")  # fmt: skip


@query(
    """SELECT o_orderstatus, min(o_totalprice) AS mi, max(o_totalprice) AS ma, any_value(o_orderstatus) AS av, round(var_samp(o_totalprice) / 1e6, 3) AS v, round(var_samp(o_totalprice) / 1e6, 3) AS vs, round(var_pop(o_totalprice) / 1e6, 3) AS vp, round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_pop(o_totalprice), 3) AS sp, round(stddev_samp(o_totalprice), 3) AS ss,
       count(DISTINCT o_orderpriority) AS ac, CAST(count(*) AS BIGINT) * 2 AS ca, count(*) FILTER (o_custkey % 2 = 0) AS ci, count(DISTINCT o_orderpriority) AS hl FROM orders GROUP BY o_orderstatus"""
)
def q_sql_aggregates(spark, d):
    return _run(spark, d, """SELECT o_orderstatus, MIN(o_totalprice) AS mi, MAX(o_totalprice) AS ma, ANY_VALUE(o_orderstatus) AS av, ROUND(VARIANCE(o_totalprice) / 1e6, 3) AS v, ROUND(VAR_SAMP(o_totalprice) / 1e6, 3) AS vs, ROUND(VAR_POP(o_totalprice) / 1e6, 3) AS vp, ROUND(STDDEV(o_totalprice), 3) AS sd,
        ROUND(STDDEV_POP(o_totalprice), 3) AS sp, ROUND(STDDEV_SAMP(o_totalprice), 3) AS ss, APPROX_COUNT_DISTINCT(o_orderpriority) AS ac, ARRAY_LENGTH(ARRAY_CONCAT_AGG([o_custkey, 1])) AS ca, COUNTIF(MOD(o_custkey, 2) = 0) AS ci, HLL_COUNT.EXTRACT(HLL_COUNT.INIT(o_orderpriority)) AS hl FROM orders GROUP BY o_orderstatus""", "orders")  # fmt: skip


@query(
    """WITH c AS (SELECT o_custkey % 40 AS k, o_orderkey % 100 AS x, o_orderstatus AS s FROM orders), n AS (SELECT k, count(DISTINCT x) AS hm, quantile_disc(x, [0.25, 0.5, 0.75, 1.0]) AS q FROM c GROUP BY k)
       SELECT k, hm, hm AS hp, true AS near FROM n"""
)
def q_sql_sketches(spark, d):
    """Sketches of parts of a group, merged. Distinct counts this small are exact; quantiles are within a hundredth of a rank."""
    return _run(spark, d, """WITH c AS (SELECT MOD(o_custkey, 40) AS k, MOD(o_orderkey, 100) AS x, o_orderstatus AS s FROM orders),
        p AS (SELECT k, s, HLL_COUNT.INIT(x) AS h, KLL_QUANTILES.INIT_INT64(x) AS q, KLL_QUANTILES.INIT_FLOAT64(CAST(x AS FLOAT64)) AS f FROM c GROUP BY k, s),
        m AS (SELECT k, HLL_COUNT.MERGE(h) AS hm, HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(h)) AS hp, KLL_QUANTILES.MERGE_POINT_INT64(q, 0.5) AS m1, KLL_QUANTILES.MERGE_POINT_FLOAT64(f, 0.5) AS m2, KLL_QUANTILES.MERGE_INT64(q, 2) AS qs, KLL_QUANTILES.MERGE_FLOAT64(f, 2) AS fs, KLL_QUANTILES.EXTRACT_POINT_FLOAT64(KLL_QUANTILES.MERGE_PARTIAL(f), 0.5) AS mp FROM p GROUP BY k),
        e AS (SELECT k, COUNT(*) AS n, PERCENTILE(x, 0.48) AS lo, PERCENTILE(x, 0.52) AS hi FROM c GROUP BY k)
        SELECT m.k, hm, hp, m1 BETWEEN lo - 1 AND hi + 1 AND m2 BETWEEN lo - 1 AND hi + 1 AND mp BETWEEN lo - 1 AND hi + 1 AND qs[OFFSET(1)] = m1 AND fs[OFFSET(1)] = m2 AS near FROM m JOIN e ON m.k = e.k""", "orders")  # fmt: skip


@query("SELECT n_regionkey, round(quantile_cont(n_nationkey, 0.5), 6) AS c, quantile_disc(n_nationkey, 0.5) AS m, [min(n_nationkey), quantile_disc(n_nationkey, 0.5), max(n_nationkey)] AS q, [min(n_nationkey)::DOUBLE, max(n_nationkey)::DOUBLE] AS f, quantile_disc(n_nationkey, 0.5)::DOUBLE AS p FROM nation GROUP BY n_regionkey")
def q_sql_kll_exact(spark, d):
    """Groups that a sketch holds whole: its quantiles are exact."""
    return _run(spark, d, """SELECT n_regionkey, CAST(PERCENTILE(n_nationkey, 0.5) AS FLOAT64) AS c, KLL_QUANTILES.EXTRACT_POINT_INT64(KLL_QUANTILES.INIT_INT64(n_nationkey), 0.5) AS m, KLL_QUANTILES.EXTRACT_INT64(KLL_QUANTILES.INIT_INT64(n_nationkey), 2) AS q,
        KLL_QUANTILES.EXTRACT_FLOAT64(KLL_QUANTILES.INIT_FLOAT64(CAST(n_nationkey AS FLOAT64)), 1) AS f, KLL_QUANTILES.EXTRACT_POINT_FLOAT64(KLL_QUANTILES.INIT_FLOAT64(CAST(n_nationkey AS FLOAT64)), 0.5) AS p FROM nation GROUP BY n_regionkey""", "nation")  # fmt: skip


@query(
    """SELECT o_orderkey, x::DATE AS s, (x + INTERVAL 100 DAY)::DATE AS e, CASE WHEN x::DATE < DATE '1997-01-01' AND DATE '1996-01-01' < (x + INTERVAL 100 DAY)::DATE THEN greatest(x::DATE, DATE '1996-01-01') END AS i,
       CASE WHEN x::DATE < DATE '1997-01-01' AND DATE '1996-01-01' < (x + INTERVAL 100 DAY)::DATE THEN least((x + INTERVAL 100 DAY)::DATE, DATE '1997-01-01') END AS j, x::DATE <= DATE '1996-03-01' AND DATE '1996-03-01' < (x + INTERVAL 100 DAY)::DATE AS c FROM (SELECT o_orderkey, o_orderdate AS x FROM orders)"""
)
def q_sql_ranges(spark, d):
    return _run(spark, d, """SELECT o_orderkey, RANGE_START(r) AS s, RANGE_END(r) AS e, RANGE_START(RANGE_INTERSECT(r, y)) AS i, RANGE_END(RANGE_INTERSECT(r, y)) AS j, RANGE_CONTAINS(r, DATE '1996-03-01') AS c FROM
        (SELECT o_orderkey, RANGE(CAST(o_orderdate AS DATE), DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 100 DAY)) AS r, RANGE(DATE '1996-01-01', DATE '1997-01-01') AS y FROM orders)""", "orders")  # fmt: skip


@query(
    """SELECT p_partkey, a || ['z'] AS ac, list_reverse(a) AS ar, a[1] AS o0, a[2] AS o1, a[9] AS so, a[1] AS so1, list_reverse_sort(a) AS srt, list_sort(a) AS sra, len(a) AS n, [x for x in [1, 2, 3, 4, 5] if x >= 2 and x <= 4] AS sl, p_size IN (1, 5, 11) AS iu, 'n' || len(a) AS ws FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS a FROM part)"""
)
def q_sql_arrays(spark, d):
    return _run(spark, d, """SELECT p_partkey, ARRAY_CONCAT(a, ['z']) AS ac, ARRAY_REVERSE(a) AS ar, a[OFFSET(0)] AS o0, a[ORDINAL(2)] AS o1, a[SAFE_OFFSET(8)] AS so, a[SAFE_ORDINAL(1)] AS so1, ARRAY(SELECT w FROM UNNEST(a) AS w ORDER BY w DESC) AS srt, ARRAY(SELECT w FROM UNNEST(a) AS w ORDER BY w) AS sra,
        ARRAY_LENGTH(a) AS n, ARRAY_SLICE([1, 2, 3, 4, 5], 1, -2) AS sl, p_size IN UNNEST([1, 5, 11]) AS iu, CONCAT('n', CAST(ARRAY_LENGTH(a) AS STRING)) AS ws FROM (SELECT p_partkey, p_size, SPLIT(p_name, ' ') AS a FROM part)""", "part")  # fmt: skip


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def q_sql_not_in_null(spark, d):
    """A null among the values: no row passes."""
    return _run(spark, d, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT IF(MOD(o_custkey, 50) = 0, NULL, o_custkey) FROM orders)", "customer", "orders")


@query("SELECT c_custkey, c_custkey % 7 NOT IN (SELECT n_regionkey FROM nation) AS out, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS big FROM customer")
def q_sql_in_subquery(spark, d):
    return _run(spark, d, "SELECT c_custkey, MOD(c_custkey, 7) NOT IN (SELECT n_regionkey FROM nation) AS out, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS big FROM customer", "customer", "orders", "nation")


@query("WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), u AS (SELECT n, count(*) AS m FROM t GROUP BY n) SELECT n, m, (SELECT max(m) FROM u) AS most, (SELECT count(*) FROM t WHERE t.n > u.n) AS above, EXISTS (SELECT 1 FROM t WHERE t.n = u.n + 1) AS next FROM u")
def q_sql_with_correlated(spark, d):
    return _run(spark, d, "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), u AS (SELECT n, COUNT(*) AS m FROM t GROUP BY n), g AS (SELECT n AS k, COUNT(*) AS c FROM t GROUP BY n) SELECT n, m, (SELECT MAX(m) FROM u) AS most, COALESCE((SELECT SUM(c) FROM g WHERE g.k > u.n), 0) AS above, EXISTS (SELECT 1 FROM t WHERE t.n = u.n + 1) AS next FROM u", "orders")


@query("SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def q_sql_intersect_all(spark, d):
    return _run(spark, d, "SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'", "lineitem")


@query("SELECT p_partkey, p_name LIKE '%e%' OR p_name LIKE 'r%' AS a, p_name LIKE '%e%' AND p_name LIKE 'r%' AS b, p_type LIKE 'S_A%' AS c, NOT p_name LIKE '%ring' AS e FROM part")
def q_sql_like(spark, d):
    return _run(spark, d, "SELECT p_partkey, p_name LIKE ANY ('%e%', 'r%') AS a, p_name LIKE ALL ('%e%', 'r%') AS b, p_type LIKE 'S_A%' AS c, p_name NOT LIKE '%ring' AS e FROM part", "part")


@query(
    """SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_totalprice, 2) OVER w AS n2, lag(o_totalprice) OVER w AS lg, lead(o_totalprice, 1, 0.0) OVER w AS ld,
       round(quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_custkey), 6) AS pc, min(o_totalprice) OVER (PARTITION BY o_custkey) AS mi, rank() OVER w AS r, CAST(ntile(3) OVER w AS BIGINT) AS nt, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def q_sql_windows(spark, d):
    return _run(spark, d, """SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w AS f, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(o_totalprice, 2) OVER w AS n2, LAG(o_totalprice) OVER w AS lg, LEAD(o_totalprice, 1, CAST(0 AS FLOAT64)) OVER w AS ld,
        ROUND(PERCENTILE_CONT(o_totalprice, 0.5) OVER (PARTITION BY o_custkey), 6) AS pc, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS mi, CAST(RANK() OVER w AS INT64) AS r, CAST(NTILE(3) OVER w AS INT64) AS nt, ROUND(CUME_DIST() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", "orders")  # fmt: skip


@query("SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS s, CASE WHEN n_nationkey > 10 THEN 'big' ELSE 'small' END AS w FROM nation")
def q_sql_function(spark, d):
    views(spark, d, ["nation"])
    return Session(spark).run("CREATE TEMP FUNCTION weir_squared(x INT64) RETURNS INT64 AS (x * x + 1); CREATE TEMP FUNCTION weir_sized(x INT64) AS (IF(x > 10, 'big', 'small')); SELECT n_nationkey, weir_squared(n_nationkey) AS s, weir_sized(n_nationkey) AS w FROM nation")


@query("SELECT CAST(1 AS BIGINT) AS i, 1.5::DOUBLE AS f, 'a\"b' AS s, '6162' AS b, DATE '2024-02-29' AS d, true AS t, NULL::BIGINT AS n, [1::BIGINT, 2::BIGINT] AS a, 12.340000000::DECIMAL(38,9) AS m, 255::BIGINT AS x, TIMESTAMP '2024-01-02 03:04:05' AS dt")
def q_sql_literals(spark, d):
    """A single row, and a literal of each type."""
    return Session(spark).query("""SELECT CAST(1 AS INT64) AS i, CAST(1.5 AS FLOAT64) AS f, 'a"b' AS s, TO_HEX(b'ab') AS b, DATE '2024-02-29' AS d, TRUE AS t, CAST(NULL AS INT64) AS n, [CAST(1 AS INT64), CAST(2 AS INT64)] AS a, NUMERIC '12.34' AS m, 0xFF AS x, DATETIME '2024-01-02 03:04:05' AS dt""")


@query(
    """SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS top, list(x ORDER BY o_orderkey) FILTER (x IS NOT NULL) AS known, list(x ORDER BY o_orderkey) AS every, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS st, list_sort(list(DISTINCT o_orderstatus)) AS ds, max_by(o_orderkey, o_totalprice) AS hm,
       min_by(o_orderkey, o_totalprice) AS hn, list_sort(list(o_orderkey) || list(o_custkey)) AS cc FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS x FROM orders) GROUP BY o_custkey"""
)
def q_sql_aggregate_modifiers(spark, d):
    return _run(spark, d, """SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) AS top, ARRAY_AGG(x IGNORE NULLS ORDER BY o_orderkey) AS known, ARRAY_AGG(x ORDER BY o_orderkey) AS every, STRING_AGG(o_orderstatus, '|' ORDER BY o_orderkey) AS st,
        ARRAY_AGG(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS ds, ANY_VALUE(o_orderkey HAVING MAX o_totalprice) AS hm, ANY_VALUE(o_orderkey HAVING MIN o_totalprice) AS hn, SORT_ARRAY(ARRAY_CONCAT_AGG([o_orderkey, o_custkey])) AS cc
        FROM (SELECT *, IF(MOD(o_orderkey, 3) = 0, NULL, o_orderkey) AS x FROM orders) GROUP BY o_custkey""", "orders")  # fmt: skip


@query("SELECT upper(n_name) AS name, count(*) * 2 AS n, (SELECT count(*) FROM nation) AS distinct_names FROM nation GROUP BY 1")
def q_sql_collated(spark, d):
    """Names in two cases: grouped, and united without repeats, by a collation that holds them equal."""
    return _run(spark, d, """SELECT UPPER(CAST(MIN(name) AS STRING)) AS name, COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT COLLATE(LOWER(n_name), 'und:ci') AS c FROM nation UNION DISTINCT SELECT COLLATE(UPPER(n_name), 'und:ci') FROM nation)) AS distinct_names
        FROM (SELECT COLLATE(LOWER(n_name), 'und:ci') AS name FROM nation UNION ALL SELECT COLLATE(UPPER(n_name), 'und:ci') FROM nation) GROUP BY name""", "nation")  # fmt: skip


@query("SELECT count(*) AS rows, count(*) AS uuids, date_diff('day', DATE '2020-01-01', current_date) AS today, date_diff('day', DATE '2020-01-01', current_date) AS ts, date_diff('day', DATE '2020-01-01', current_date) AS dt, count(*) AS rands, 'bigint' AS ty FROM customer")
def q_sql_utility(spark, d):
    """What differs from row to row or from day to day, by what must hold of it."""
    return _run(spark, d, """SELECT COUNT(*) AS rows, COUNT(DISTINCT u) AS uuids, MAX(DATE_DIFF(CURRENT_DATE(), DATE '2020-01-01', DAY)) AS today, MAX(DATE_DIFF(DATE(CURRENT_TIMESTAMP()), DATE '2020-01-01', DAY)) AS ts, MAX(DATE_DIFF(DATE(CURRENT_DATETIME()), DATE '2020-01-01', DAY)) AS dt,
        COUNTIF(r >= 0 AND r < 1) AS rands, MAX(ty) AS ty FROM (SELECT GENERATE_UUID() AS u, RAND() AS r, TYPEOF(c_custkey) AS ty FROM customer)""", "customer")  # fmt: skip
