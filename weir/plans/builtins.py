"""The dialect's functions as text of Spark SQL: for each name a template of its arguments.

A template is inlined where the function is called, so Catalyst sees plain
expressions. The few functions that no expression can say are Arrow UDFs of
``functions.udfs`` and ``functions.shapes``, registered once a session under a
name of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import SparkSession

from ..functions import shapes, temporal, udfs

Template = Callable[[list[str]], str | None]

MICROS = temporal.MICROS


def _form(text: str) -> Template:
    """A template with {0}, {1}… for arguments; it applies to calls with just that many."""
    count = len(set(re.findall(r"\{(\d)\}", text)))
    return lambda a: text.format(*a) if len(a) == count else None


def _by_count(*texts: str) -> Template:
    forms = [_form(t) for t in texts]
    return lambda a: next((x for f in forms if (x := f(a)) is not None), None)


def _domain(name: str, value: str, ok: str) -> Template:
    """A value where ``ok`` holds, an error elsewhere."""
    return _form(f"CASE WHEN {ok} OR isnan({{0}}) THEN {value} WHEN {{0}} IS NOT NULL THEN CAST(raise_error('{name}: argument out of its domain') AS DOUBLE) END")


def _constant(text: str) -> str:
    """The value of a string literal of Spark SQL."""
    m = re.fullmatch(r"\s*'((?:[^'\\]|\\.)*)'\s*", text, re.S)
    if not m:
        raise ValueError(f"a constant string is expected, not {text}")
    return re.sub(r"\\(.)", r"\1", m[1])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _instr(a: list[str]) -> str:
    x, s = a[:2]
    pos, nth = (a[2] if len(a) > 2 else "1"), (a[3] if len(a) > 3 else "1")
    at = f"filter(sequence(1, greatest(length({x}), 1)), _i -> substring({x}, _i, length({s})) = {s})"
    after = f"try_element_at(filter({at}, _i -> _i >= ({pos})), {nth})"
    before = f"try_element_at(filter({at}, _i -> _i <= length({x}) + ({pos}) + 1), -({nth}))"
    return f"CASE WHEN {x} IS NULL OR {s} IS NULL THEN NULL ELSE CAST(coalesce(CASE WHEN ({pos}) > 0 THEN {after} ELSE {before} END, 0) AS BIGINT) END"


def _trunc(a: list[str]) -> str:
    """Toward zero, in the argument's type."""
    x = a[0]
    if len(a) == 1:
        return f"({x} - {x} % 1)"
    n = int(a[1].replace(" ", ""))
    step, near = f"{Decimal(1).scaleb(-n):f}BD", f"round({x}, {n})"
    return f"round(CASE WHEN abs({near}) > abs({x}) THEN {near} - CASE WHEN {x} < 0 THEN -{step} ELSE {step} END ELSE {near} END, {n})"


def _substr(a: list[str]) -> str:
    x, pos = a[:2]
    start = f"CASE WHEN ({pos}) >= 0 THEN greatest({pos}, 1) ELSE greatest(length({x}) + ({pos}) + 1, 1) END"
    return f"substring({x}, CAST({start} AS INT), CAST({a[2] if len(a) > 2 else f'length({x})'} AS INT))"


def _format_of(a: list[str]) -> str | None:
    """FORMAT_DATE and its kin: the format is a constant."""
    return f"date_format({a[1]}, {_quoted(temporal.pattern(_constant(a[0])))})" if len(a) == 2 else None


def _parse(kind: str) -> Template:
    call = {"DATE": "to_date({1}, {0})", "DATETIME": "to_timestamp_ntz({1}, {0})", "TIMESTAMP": "to_timestamp({1}, {0})"}[kind]
    return lambda a: call.format(_quoted(temporal.pattern(_constant(a[0]))), a[1])


def _bucket(kind: str) -> Template:
    """DATETIME_BUCKET and TIMESTAMP_BUCKET over an interval of a fixed length, INTERVAL n PART."""

    def build(a: list[str]) -> str:
        m = re.fullmatch(r"INTERVAL\s+(\d+)\s+(\w+)", a[1].strip(), re.I)
        width = int(m[1]) * MICROS[m[2].upper()]
        micros = f"unix_micros(CAST({a[0]} AS TIMESTAMP))"
        origin = f"unix_micros(CAST({a[2]} AS TIMESTAMP))" if len(a) > 2 else f"unix_micros(TIMESTAMP '{temporal.ORIGIN}')"
        cut = f"timestamp_micros({micros} - pmod({micros} - {origin}, {width}))"
        return f"CAST({cut} AS {'TIMESTAMP_NTZ' if kind == 'DATETIME' else 'TIMESTAMP'})"

    return build


def _date_bucket(a: list[str]) -> str:
    m = re.fullmatch(r"INTERVAL\s+(\d+)\s+(\w+)", a[1].strip(), re.I)
    n, part = int(m[1]), m[2].upper()
    origin = a[2] if len(a) > 2 else f"DATE '{temporal.ORIGIN}'"
    if part in ("DAY", "WEEK"):
        return f"date_sub({a[0]}, CAST(pmod(datediff({a[0]}, {origin}), {n * (7 if part == 'WEEK' else 1)}) AS INT))"
    n *= {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[part]
    months = f"(year({{0}}) * 12 + month({{0}}) - year({origin}) * 12 - month({origin}) - IF(day({{0}}) < day({origin}), 1, 0))".replace("{0}", a[0])
    return f"add_months({origin}, CAST({months} - pmod({months}, {n}) AS INT))"


def _json_scalar(value: str) -> str:
    """Any value as JSON text."""
    return f"regexp_extract(to_json(named_struct('v', {value}), map('ignoreNullFields', 'false')), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1)"


def _json_at(a: list[str], kind: str = "variant") -> str:
    return f"try_variant_get(try_parse_json({a[0]}), {a[1] if len(a) > 1 else _quoted('$')}, '{kind}')"


def _json_value(a: list[str]) -> str:
    return f"CASE WHEN schema_of_variant({_json_at(a)}) RLIKE '^(OBJECT|ARRAY)' THEN NULL ELSE {_json_at(a, 'string')} END"


def _json_query(a: list[str]) -> str:
    return f"to_json({_json_at(a)})"


def _json_array_of(a: list[str]) -> str:
    return f"transform({_json_at(a, 'array<variant>')}, _e -> to_json(_e))"


def _json_values(a: list[str]) -> str:
    """Null where an element is no scalar."""
    some = f"exists({_json_at(a, 'array<variant>')}, _e -> schema_of_variant(_e) RLIKE '^(OBJECT|ARRAY)')"
    return f"CASE WHEN NOT coalesce({some}, false) THEN {_json_at(a, 'array<string>')} END"


def _json_list(a: list[str]) -> str:
    return "concat('[', " + ", ',', ".join(_json_scalar(x) for x in a) + ", ']')" if a else "'[]'"


def _json_object(a: list[str]) -> str:
    pairs = ", ',', ".join(f"{_json_scalar(k)}, ':', {_json_scalar(v)}" for k, v in zip(a[::2], a[1::2]))
    return f"concat('{{', {pairs}, '}}')" if a else "'{}'"


def _json_type(a: list[str]) -> str:
    kind = f"schema_of_variant(try_parse_json({a[0]}))"
    return f"CASE WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} = 'STRING' THEN 'string' WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} IS NOT NULL THEN 'number' END"


def _lax_int(a: list[str]) -> str:
    text = _json_at(a[:1], "string")
    real = f"try_cast({text} AS DOUBLE)"
    truth = f"CASE WHEN schema_of_variant(try_parse_json({a[0]})) = 'BOOLEAN' THEN IF({text} = 'true', 1, 0) END"
    return f"coalesce(try_cast({text} AS BIGINT), {truth}, try_cast(round({real}) AS BIGINT))"


def _lax_bool(a: list[str]) -> str:
    text = _json_at(a[:1], "string")
    return f"CASE WHEN lower({text}) IN ('true', 'false') THEN lower({text}) = 'true' WHEN schema_of_variant(try_parse_json({a[0]})) RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN CAST({text} AS DOUBLE) <> 0 END"


def _format(a: list[str]) -> str:
    """FORMAT: numbers and texts cross to the UDF as they are, other values as JSON with their types."""
    typed = (f"to_json(named_struct('v', {x}, 'k', typeof({x})), map('ignoreNullFields', 'false'))" for x in a[1:])
    rest = f"weir_format({a[0]}, array({', '.join(typed)}))"
    if len(a) == 1:
        return rest
    kinds, known = [f"typeof({x})" for x in a[1:]], ", ".join(map(_quoted, udfs.PLAIN))
    # types are constants, so one branch is left before any row is read
    return f"CASE WHEN {' AND '.join(f'{k} IN ({known})' for k in kinds)} THEN weir_format_plain({a[0]}, concat_ws(',', {', '.join(kinds)}), {', '.join(a[1:])}) ELSE {rest} END"


def _host(x: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//', '')"
    return f"nullif(lower(regexp_replace(regexp_replace(regexp_extract({rest}, '^[^/?#]*', 0), '^.*@', ''), ':\\\\d*$', '')), '')"


_SPACE = r"(?U)\\s"
_WORDS = r" \\t\\n\\r\\f\\v\\[\\](){}/|<>!?@\"^#$&~_,.:;*%+=-"

FUNCTIONS: dict[str, Template] = {
    # mathematics
    "ACOS": _domain("ACOS", "acos({0})", "abs({0}) <= 1"), "ASIN": _domain("ASIN", "asin({0})", "abs({0}) <= 1"),
    "ACOSH": _domain("ACOSH", "acosh({0})", "{0} >= 1"), "ATANH": _domain("ATANH", "atanh({0})", "abs({0}) < 1"),
    "COT": _domain("COT", "cot({0})", "{0} <> 0"), "CSC": _domain("CSC", "csc({0})", "{0} <> 0"),
    "COTH": _domain("COTH", "cosh({0}) / sinh({0})", "{0} <> 0"), "CSCH": _domain("CSCH", "1 / sinh({0})", "{0} <> 0"),
    "SECH": _form("(1 / cosh({0}))"), "SQRT": _domain("SQRT", "sqrt({0})", "{0} >= 0"), "LN": _domain("LN", "ln({0})", "{0} > 0"),
    "LOG": lambda a: _domain("LOG", "ln({0})", "{0} > 0")(a) if len(a) == 1 else f"(ln({a[0]}) / ln({a[1]}))", "LOG10": _domain("LOG10", "log10({0})", "{0} > 0"),
    "SIGN": _form("CASE WHEN isnan({0}) THEN {0} WHEN {0} > 0 THEN 1 WHEN {0} < 0 THEN -1 WHEN {0} = 0 THEN 0 END"),
    "CEIL": _form("CASE WHEN abs({0}) = double('Infinity') THEN {0} ELSE {0} + pmod(-({0}), 1) END"), "CEILING": _form("CASE WHEN abs({0}) = double('Infinity') THEN {0} ELSE {0} + pmod(-({0}), 1) END"),
    "FLOOR": _form("CASE WHEN abs({0}) = double('Infinity') THEN {0} ELSE {0} - pmod({0}, 1) END"),
    "TRUNC": _trunc,
    "DIV": _form("({0} div {1})"), "SAFE_NEGATE": _form("try_subtract(CAST(0 AS BIGINT), {0})"),
    "IS_INF": _form("(abs({0}) = double('Infinity'))"), "IS_NAN": _form("CASE WHEN {0} IS NOT NULL THEN isnan({0}) END"), "RAND": lambda a: "rand()",
    "ROUND": lambda a: f"bround({a[0]}, {a[1]})" if len(a) == 3 and "EVEN" in a[2].upper() else f"round({', '.join(a[:2])})",
    "COSINE_DISTANCE": _form("(1 - aggregate(zip_with({0}, {1}, (_x, _y) -> _x * _y), double(0), (_s, _x) -> _s + _x) / (sqrt(aggregate({0}, double(0), (_s, _x) -> _s + _x * _x)) * sqrt(aggregate({1}, double(0), (_s, _x) -> _s + _x * _x))))"),
    "EUCLIDEAN_DISTANCE": _form("sqrt(aggregate(zip_with({0}, {1}, (_x, _y) -> (_x - _y) * (_x - _y)), double(0), (_s, _x) -> _s + _x))"),
    # text
    "INSTR": _instr, "SUBSTR": _substr, "SUBSTRING": _substr, "STRPOS": _form("CAST(instr({0}, {1}) AS BIGINT)"),
    "TRIM": _by_count(f"regexp_replace({{0}}, '{_SPACE.replace('(?U)', '(?U)^')}+|{_SPACE.replace('(?U)', '')}+$', '')", "btrim({0}, {1})"),
    "LTRIM": _by_count("regexp_replace({0}, '(?U)^\\\\s+', '')", "trim(LEADING {1} FROM {0})"), "RTRIM": _by_count("regexp_replace({0}, '(?U)\\\\s+$', '')", "trim(TRAILING {1} FROM {0})"),
    "CHR": _form("decode(unhex(lpad(hex(CAST({0} AS BIGINT)), 8, '0')), 'UTF-32')"),
    "TO_CODE_POINTS": _form("CASE WHEN typeof({0}) = 'binary' THEN transform(sequence(1, octet_length({0})), _i -> CAST(conv(hex(substring(CAST({0} AS BINARY), _i, 1)), 16, 10) AS BIGINT)) ELSE transform(filter(split(CAST({0} AS STRING), ''), _c -> _c <> ''), _c -> CAST(conv(hex(encode(_c, 'UTF-32')), 16, 10) AS BIGINT)) END"),
    "CODE_POINTS_TO_STRING": _form("array_join(transform({0}, _c -> decode(unhex(lpad(hex(CAST(_c AS BIGINT)), 8, '0')), 'UTF-32')), '')"),
    "CODE_POINTS_TO_BYTES": _form("unhex(array_join(transform({0}, _c -> lpad(hex(CAST(_c AS BIGINT)), 2, '0')), ''))"),
    "UNICODE": _form("CASE WHEN {0} = '' THEN 0 ELSE CAST(conv(hex(encode(left({0}, 1), 'UTF-32')), 16, 10) AS BIGINT) END"), "ASCII": _form("CAST(ascii({0}) AS BIGINT)"),
    "SOUNDEX": _form("CASE WHEN regexp_replace({0}, '[^A-Za-z]', '') = '' THEN '' ELSE soundex(regexp_replace({0}, '[^A-Za-z]', '')) END"),
    "INITCAP": _form(f"array_join(transform(regexp_extract_all(lower({{0}}), '[^{_WORDS}]+|[{_WORDS}]+', 0), _p -> concat(upper(substring(_p, 1, 1)), substring(_p, 2))), '')".replace("{}", "{{}}")),
    "REGEXP_INSTR": _form("CAST(regexp_instr({0}, {1}) AS BIGINT)"), "FROM_HEX": _form("unhex(CASE WHEN length({0}) % 2 = 1 THEN concat('0', {0}) ELSE {0} END)"),
    "LENGTH": _form("CAST(length({0}) AS BIGINT)"), "CHAR_LENGTH": _form("CAST(char_length({0}) AS BIGINT)"), "CHARACTER_LENGTH": _form("CAST(char_length({0}) AS BIGINT)"),
    "BYTE_LENGTH": _form("CAST(octet_length({0}) AS BIGINT)"), "OCTET_LENGTH": _form("CAST(octet_length({0}) AS BIGINT)"),
    "CONTAINS_SUBSTR": _form("weir_holds(CAST({0} AS STRING), weir_fold({1}))"), "TO_BASE64": _form("base64(CAST({0} AS BINARY))"),
    "NORMALIZE": lambda a: f"weir_normalize({a[0]}, {_quoted(a[1].strip(chr(39))) if len(a) > 1 else _quoted('NFC')})",
    "NORMALIZE_AND_CASEFOLD": lambda a: f"weir_casefold({a[0]}, {_quoted(a[1].strip(chr(39))) if len(a) > 1 else _quoted('NFC')})",
    "TO_BASE32": _form("weir_to_base32(CAST({0} AS BINARY))"), "FROM_BASE32": _form("weir_from_base32({0})"), "FARM_FINGERPRINT": _form("weir_farm(CAST({0} AS BINARY))"),
    "EDIT_DISTANCE": lambda a: f"CAST(levenshtein({a[0]}, {a[1]}) AS BIGINT)" if len(a) == 2 else f"CAST(least(levenshtein({a[0]}, {a[1]}), {a[2].split('=>')[-1]}) AS BIGINT)",
    "FORMAT": _format,
    # arrays
    "ARRAY_LENGTH": _form("CAST(size({0}) AS BIGINT)"),
    "ARRAY_FIRST": _form("CASE WHEN size({0}) = 0 THEN raise_error('ARRAY_FIRST of an empty array') ELSE get({0}, 0) END"), "ARRAY_LAST": _form("CASE WHEN size({0}) = 0 THEN raise_error('ARRAY_LAST of an empty array') ELSE element_at({0}, -1) END"),
    "ARRAY_SLICE": _form("filter({0}, (_e, _i) -> _i BETWEEN (CASE WHEN ({1}) < 0 THEN size({0}) + ({1}) ELSE {1} END) AND (CASE WHEN ({2}) < 0 THEN size({0}) + ({2}) ELSE {2} END))"),
    # JSON, kept as text
    "PARSE_JSON": lambda a: f"to_json(parse_json({a[0]}))", "TO_JSON": lambda a: _json_scalar(a[0]), "TO_JSON_STRING": lambda a: _json_scalar(a[0]),
    "JSON_VALUE": _json_value, "JSON_EXTRACT_SCALAR": _json_value, "JSON_QUERY": _json_query, "JSON_EXTRACT": _json_query,
    "JSON_QUERY_ARRAY": _json_array_of, "JSON_EXTRACT_ARRAY": _json_array_of, "JSON_VALUE_ARRAY": _json_values, "JSON_EXTRACT_STRING_ARRAY": _json_values,
    "JSON_ARRAY": _json_list, "JSON_OBJECT": _json_object, "JSON_TYPE": _json_type,
    "LAX_INT64": _lax_int, "LAX_FLOAT64": lambda a: f"try_cast({_json_at(a[:1], 'string')} AS DOUBLE)", "LAX_BOOL": _lax_bool, "LAX_STRING": lambda a: _json_value(a[:1]),
    "INT64": lambda a: f"variant_get(parse_json({a[0]}), '$', 'bigint')", "FLOAT64": lambda a: f"variant_get(parse_json({a[0]}), '$', 'double')", "BOOL": lambda a: f"variant_get(parse_json({a[0]}), '$', 'boolean')",
    "JSON_SET": _form("weir_json_set({0}, {1}, {2})"), "JSON_REMOVE": _form("weir_json_remove({0}, {1})"), "JSON_ARRAY_APPEND": _form("weir_json_append({0}, {1}, {2})"),
    "JSON_ARRAY_INSERT": _form("weir_json_insert({0}, {1}, {2})"), "JSON_STRIP_NULLS": _form("weir_json_strip({0})"), "JSON_KEYS": _form("weir_json_keys({0})"), "JSON_FLATTEN": _form("weir_json_flatten({0})"),
    # dates and times
    "CURRENT_DATETIME": lambda a: "localtimestamp()", "CURRENT_TIMESTAMP": lambda a: "current_timestamp()", "CURRENT_DATE": lambda a: "current_date()", "CURRENT_TIME": lambda a: "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')",
    "DATE": lambda a: f"make_date({', '.join(a)})" if len(a) == 3 else f"CAST({a[0]} AS DATE)" if len(a) == 1 else f"CAST(from_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]}) AS DATE)",
    "DATETIME": lambda a: f"make_timestamp_ntz({', '.join(a)})" if len(a) == 6 else f"CAST({a[0]} AS TIMESTAMP_NTZ)" if len(a) == 1 else f"CAST(from_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]}) AS TIMESTAMP_NTZ)",
    "TIMESTAMP": lambda a: f"CAST({a[0]} AS TIMESTAMP)" if len(a) == 1 else f"to_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]})",
    "STRING": lambda a: f"CAST({a[0]} AS STRING)",
    "FORMAT_DATE": _format_of, "FORMAT_DATETIME": _format_of, "FORMAT_TIMESTAMP": _format_of, "PARSE_DATE": _parse("DATE"), "PARSE_DATETIME": _parse("DATETIME"), "PARSE_TIMESTAMP": _parse("TIMESTAMP"),
    "UNIX_DATE": _form("CAST(unix_date({0}) AS BIGINT)"), "DATE_BUCKET": _date_bucket, "DATETIME_BUCKET": _bucket("DATETIME"), "TIMESTAMP_BUCKET": _bucket("TIMESTAMP"),
    "GENERATE_TIMESTAMP_ARRAY": _form("CASE WHEN {0} <= {1} THEN sequence({0}, {1}, {2}) ELSE slice(array({0}), 1, 0) END"),
    # ranges
    "RANGE": _form("CASE WHEN {0} IS NULL OR {1} IS NULL OR {0} < {1} THEN named_struct('start', {0}, 'end', {1}) END"), "RANGE_START": _form("({0}).start"), "RANGE_END": _form("({0}).end"),
    "RANGE_CONTAINS": _form("((({0}).start IS NULL OR ({0}).start <= {1}) AND (({0}).end IS NULL OR {1} < ({0}).end))"),
    "RANGE_OVERLAPS": _form("((({0}).start IS NULL OR ({1}).end IS NULL OR ({0}).start < ({1}).end) AND (({1}).start IS NULL OR ({0}).end IS NULL OR ({1}).start < ({0}).end))"),
    "RANGE_INTERSECT": _form("CASE WHEN (({0}).start IS NULL OR ({1}).end IS NULL OR ({0}).start < ({1}).end) AND (({1}).start IS NULL OR ({0}).end IS NULL OR ({1}).start < ({0}).end) THEN named_struct('start', greatest(({0}).start, ({1}).start), 'end', least(({0}).end, ({1}).end)) END"),
    # net
    "NET.HOST": lambda a: _host(a[0]), "NET.IP_FROM_STRING": _form("weir_ip({0})"), "NET.SAFE_IP_FROM_STRING": _form("weir_safe_ip({0})"), "NET.IP_TO_STRING": _form("weir_ip_text({0})"),
    "NET.IP_NET_MASK": _form("weir_mask(CAST({0} AS BIGINT), CAST({1} AS BIGINT))"), "NET.IP_TRUNC": _form("weir_ip_trunc({0}, CAST({1} AS BIGINT))"),
    "NET.IPV4_FROM_INT64": _form("unhex(lpad(hex(CAST({0} AS BIGINT)), 8, '0'))"), "NET.IPV4_TO_INT64": _form("CAST(conv(hex({0}), 16, 10) AS BIGINT)"),
    "NET.PUBLIC_SUFFIX": lambda a: f"weir_suffix({_host(a[0])})", "NET.REG_DOMAIN": lambda a: f"weir_domain({_host(a[0])})",
    # aggregates and the rest
    "PERCENTILE_CONT": _form("percentile({0}, {1})"), "PERCENTILE_DISC": _form("percentile_disc({1}) WITHIN GROUP (ORDER BY {0})"),
    "VARIANCE": _form("var_samp({0})"), "STDDEV": _form("stddev_samp({0})"), "APPROX_COUNT_DISTINCT": _form("approx_count_distinct({0}, 0.0057)"),
    "ARRAY_CONCAT_AGG": _form("flatten(array_agg({0}))"), "STRING_AGG": lambda a: f"array_join(collect_list({a[0]}), {a[1] if len(a) > 1 else _quoted(',')})",
    # where an error would be raised, null
    "SAFE.DIV": _form("CASE WHEN {1} <> 0 THEN {0} div {1} END"), "SAFE.MOD": _form("try_mod({0}, {1})"), "SAFE.DATE": lambda a: f"try_to_date(concat_ws('-', {', '.join(a)}), 'y-M-d')" if len(a) == 3 else f"try_cast({a[0]} AS DATE)",
    "SAFE.SUBSTR": lambda a: f"CASE WHEN {a[2]} >= 0 THEN {_substr(a)} END" if len(a) > 2 else _substr(a), "SAFE.ARRAY_FIRST": _form("get({0}, 0)"), "SAFE.ARRAY_LAST": _form("try_element_at({0}, -1)"),
    "COLLATE": lambda a: f"collate({a[0]}, '{'UNICODE_CI' if _constant(a[1]).endswith(':ci') else 'UTF8_BINARY'}')",
    "ERROR": _form("raise_error({0})"), "PARSE_NUMERIC": _form("CAST(replace(trim({0}), ',', '') AS DECIMAL(38,9))"), "TYPEOF": _form("typeof({0})"),
    "HLL_COUNT.INIT": lambda a: f"hll_sketch_agg({a[0]}, {a[1] if len(a) > 1 else 15})", "HLL_COUNT.MERGE": _form("hll_sketch_estimate(hll_union_agg({0}))"),
    "HLL_COUNT.MERGE_PARTIAL": _form("hll_union_agg({0})"), "HLL_COUNT.EXTRACT": _form("hll_sketch_estimate({0})"),
}


def _kll() -> None:
    """KLL_QUANTILES for both types, over Spark's own sketches; n quantiles are n + 1 values."""
    for kind, name in (("INT64", "bigint"), ("FLOAT64", "double")):
        merged = f"kll_merge_agg_{name}({{}})"

        def values(a: list[str], name: str = name, form: str = "{}") -> str:
            """n quantiles are n + 1 values; n is a constant."""
            n = int(a[1])
            return f"array({', '.join(f'kll_sketch_get_quantile_{name}({form.format(a[0])}, {i / n}D)' for i in range(n + 1))})"

        FUNCTIONS[f"KLL_QUANTILES.INIT_{kind}"] = lambda a, name=name: f"kll_sketch_agg_{name}({a[0]})"
        FUNCTIONS[f"KLL_QUANTILES.EXTRACT_{kind}"] = values
        FUNCTIONS[f"KLL_QUANTILES.EXTRACT_POINT_{kind}"] = _form(f"kll_sketch_get_quantile_{name}({{0}}, double({{1}}))")
        FUNCTIONS[f"KLL_QUANTILES.MERGE_{kind}"] = lambda a, values=values, merged=merged: values(a, form=merged)
        FUNCTIONS[f"KLL_QUANTILES.MERGE_POINT_{kind}"] = _form(f"kll_sketch_get_quantile_{name}({merged.format('{0}')}, double({{1}}))")
    FUNCTIONS["KLL_QUANTILES.MERGE_PARTIAL"] = _form("kll_merge_agg_double({0})")


_kll()


def _geography(name: str) -> Template:
    def build(a: list[str]) -> str:
        if len(a) < len(shapes.FUNCTIONS[name][1]) and name in shapes.DEFAULTS:
            a = [*a, shapes.DEFAULTS[name]]
        forms = {("ST_MAKELINE", 1): "ST_MAKELINE_ALL", ("ST_MAKEPOLYGON", 2): "ST_MAKEPOLYGON_WITH", ("ST_UNION", 1): "ST_UNION_ALL"}
        return f"weir_{forms.get((name, len(a)), name).lower()}({', '.join(a)})"

    return build


FUNCTIONS |= {name: _geography(name) for name in shapes.FUNCTIONS}
# of a group: its shapes are gathered, as what they give may have all their parts
FUNCTIONS |= {
    "ST_UNION_AGG": _form("weir_st_union_all(collect_list({0}))"), "ST_CENTROID_AGG": _form("weir_st_centroid(weir_st_gather(collect_list({0})))"),
    "ST_EXTENT": _form("weir_st_boundingbox(weir_st_gather(collect_list({0})))"),
}


def spark_text(name: str, args: list[str]) -> str | None:
    """The Spark SQL of a call; None if Spark's own function of that name is meant."""
    template = FUNCTIONS.get(name)
    return template(args) if template is not None else None


def register(spark: SparkSession) -> None:
    """The functions that are UDFs, once for each session."""
    if spark.conf.get("weir.functions", "") != "registered":
        for name, f in (udfs.NAMED | shapes.named()).items():
            spark.udf.register(name, f)
        spark.conf.set("weir.functions", "registered")
