"""Functions that Spark's expressions cannot say, as Arrow UDFs over whole batches."""

from __future__ import annotations

import base64
import ipaddress
import json
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A batch is taken by so many bytes, and results kept between batches are let go at so many.
_SPAN, _HELD = 4 << 20, 64 << 20
_MEMO: dict[tuple[str, str], object] = {}
_memo_size = 0


def _udf(kind: str | T.DataType, arrow: pa.DataType, f, memo: str | None = None):
    """An Arrow UDF that maps ``f`` over rows whose arguments are all known; equal rows of a span are computed once.

    With a name as ``memo``, what short rows give is kept between batches and tasks of a worker.
    """

    @F.arrow_udf(kind)
    def run(*values: pa.Array) -> pa.Array:
        return _mapped(values, arrow, f, memo)

    return run


def _mapped(values: tuple[pa.Array, ...], arrow: pa.DataType, f, memo: str | None) -> pa.Array:
    rows = len(values[0])
    step = max(1, min(rows, _SPAN * rows // max(sum(v.nbytes for v in values), 1)))
    out = [_once([v.slice(at, step) for v in values], arrow, f, memo) for at in range(0, max(rows, 1), step)]
    return out[0] if len(out) == 1 else pa.concat_arrays(out)


def _once(values: list[pa.Array], arrow: pa.DataType, f, memo: str | None) -> pa.Array:
    """Results of a span's distinct rows, dealt to its rows."""
    if any(pa.types.is_nested(v.type) or pa.types.is_null(v.type) for v in values):
        known, out = {}, []
        for r in zip(*(v.to_pylist() for v in values)):
            key = repr(r)
            if key not in known:
                known[key] = _result(r, key, f, memo)
            out.append(known[key])
        return pa.array(out, arrow)
    code = np.zeros(len(values[0]), np.int64)
    for v in values:
        own = v.dictionary_encode()
        one = own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = code * (len(own.dictionary) + 1) + one
        if len(values) > 1:  # so that codes of many columns stay small
            code = np.unique(code, return_inverse=True)[1]
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    distinct = zip(*(v.take(pa.array(first)).to_pylist() for v in values))
    return pa.array([_result(r, repr(r) if memo else "", f, memo) for r in distinct], arrow).take(pa.array(place))


def _result(row: tuple, key: str, f, memo: str | None):
    global _memo_size
    if any(x is None for x in row):
        return None
    if memo is None or len(key) > 2_000:
        return f(*row)
    if (memo, key) not in _MEMO:
        if _memo_size > _HELD:
            _MEMO.clear()
            _memo_size = 0
        out = _MEMO[memo, key] = f(*row)
        _memo_size += len(key) + 300 + (len(out) if isinstance(out, (str, bytes)) else sum(map(len, out)) if isinstance(out, list) else 0)
    return _MEMO[memo, key]


def _each(kind: str, arrow: pa.DataType, f, doc: str):
    """A builder of columns by ``_udf``."""

    def call(*columns):
        return _udf(kind, arrow, f)(*columns)

    call.__doc__ = doc
    return call


def normalize(form: str = "NFC", casefold: bool = False):
    return _each("string", pa.string(), lambda x: unicodedata.normalize(form, x.casefold() if casefold else x), "NORMALIZE and NORMALIZE_AND_CASEFOLD.")


to_base32 = _each("string", pa.string(), lambda b: base64.b32encode(b).decode(), "TO_BASE32.")
from_base32 = _each("binary", pa.binary(), base64.b32decode, "FROM_BASE32.")


def _ip(text: str) -> bytes | None:
    try:
        return ipaddress.ip_address(text).packed
    except ValueError:
        return None


def _mask(size: int, prefix: int) -> bytes:
    bits = 8 * size
    return ((1 << bits) - (1 << (bits - prefix))).to_bytes(size, "big")


safe_ip_from_string = _each("binary", pa.binary(), _ip, "NET.SAFE_IP_FROM_STRING: null for what is no address.")
ip_from_string = _each("binary", pa.binary(), lambda x: ipaddress.ip_address(x).packed, "NET.IP_FROM_STRING.")
ip_to_string = _each("string", pa.string(), lambda b: str(ipaddress.ip_address(b)), "NET.IP_TO_STRING.")
ip_net_mask = _each("binary", pa.binary(), _mask, "NET.IP_NET_MASK(bytes, prefix).")
ip_trunc = _each("binary", pa.binary(), lambda b, p: bytes(x & y for x, y in zip(b, _mask(len(b), p))), "NET.IP_TRUNC(address, prefix).")


def ipv4_from_int64(x):
    """NET.IPV4_FROM_INT64."""
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def ipv4_to_int64(x):
    """NET.IPV4_TO_INT64."""
    return F.conv(F.hex(x), 16, 10).cast("long")


def host(x):
    """NET.HOST: without scheme, user, port, path; lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(x), r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^//", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(name), F.lit(""))


#: Public suffixes of two labels; all others have one.
TWO_LABELS = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx"]


def public_suffix(x):
    """NET.PUBLIC_SUFFIX over the suffixes named above."""
    h = host(x)
    two = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(TWO_LABELS), two).otherwise(F.nullif(F.regexp_extract(h, r"([^.]+)$", 1), F.lit("")))


def reg_domain(x):
    """NET.REG_DOMAIN: the public suffix and one label more."""
    h, s = host(x), public_suffix(x)
    lead = F.substring(h, F.lit(1), F.length(h) - F.length(s) - 1)
    return F.when(F.length(h) > F.length(s), F.concat(F.regexp_extract(lead, r"([^.]+)$", 1), F.lit("."), s))


# JSON as text


def _steps(path: str) -> list[str | int]:
    out: list[str | int] = []
    for name, at, quoted in re.findall(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[['\"](.*?)['\"]\]", path):
        out.append(int(at) if at else name or quoted)
    return out


def _dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _reach(doc, steps):
    for s in steps:
        doc = doc[s]
    return doc


def _set_at(steps, create: bool):
    def f(text: str, value: str) -> str:
        doc, new = json.loads(text), json.loads(value)
        if not steps:
            return _dump(new)
        at = doc
        for i, s in enumerate(steps):
            last = i == len(steps) - 1
            if isinstance(at, dict) and isinstance(s, str):
                if s not in at and not create:
                    return _dump(doc)
                if last:
                    at[s] = new
                elif at.get(s) is None:
                    at[s] = [] if isinstance(steps[i + 1], int) else {}
            elif isinstance(at, list) and isinstance(s, int):
                if s >= len(at) and not create:
                    return _dump(doc)
                at.extend([None] * (s + 1 - len(at)))
                if last:
                    at[s] = new
                elif at[s] is None:
                    at[s] = [] if isinstance(steps[i + 1], int) else {}
            else:
                return _dump(doc)
            at = at[s]
        return _dump(doc)

    return f


def _remove_at(steps):
    def f(text: str) -> str:
        doc = json.loads(text)
        try:
            del _reach(doc, steps[:-1])[steps[-1]]
        except (KeyError, IndexError, TypeError):
            pass
        return _dump(doc)

    return f


def _append_at(steps):
    def f(text: str, value: str) -> str:
        doc = json.loads(text)
        try:
            at = _reach(doc, steps)
        except (KeyError, IndexError, TypeError):
            return _dump(doc)
        if isinstance(at, list):
            new = json.loads(value)
            at.extend(new if isinstance(new, list) else [new])
        return _dump(doc)

    return f


def _insert_at(steps):
    def f(text: str, value: str) -> str:
        doc = json.loads(text)
        try:
            at = _reach(doc, steps[:-1])
        except (KeyError, IndexError, TypeError):
            return _dump(doc)
        if isinstance(at, list) and isinstance(steps[-1], int):
            new = json.loads(value)
            at.extend([None] * (steps[-1] - len(at)))
            at[steps[-1] : steps[-1]] = new if isinstance(new, list) else [new]
        return _dump(doc)

    return f


def _stripped(x, arrays: bool, empty: bool):
    if isinstance(x, dict):
        x = {k: _stripped(v, arrays, empty) for k, v in x.items()}
        return {k: v for k, v in x.items() if v is not None and not (empty and v in ({}, []))}
    if isinstance(x, list):
        x = [_stripped(v, arrays, empty) for v in x]
        return [v for v in x if v is not None and not (empty and v in ({}, []))] if arrays else x
    return x


def _walked(x, lead, left):
    if isinstance(x, dict) and (left is None or left > 0):
        for k, v in x.items():
            yield ".".join([*lead, k])
            yield from _walked(v, [*lead, k], None if left is None else left - 1)


def _flat(x):
    return [z for y in x for z in _flat(y)] if isinstance(x, list) else [_dump(x)]


def json_set(path: str, create: bool = True):
    """JSON_SET(json, path, value as JSON)."""
    return _each("string", pa.string(), _set_at(_steps(path), create), "JSON_SET.")


def json_remove(path: str):
    return _each("string", pa.string(), _remove_at(_steps(path)), "JSON_REMOVE.")


def json_array_append(path: str):
    return _each("string", pa.string(), _append_at(_steps(path)), "JSON_ARRAY_APPEND.")


def json_array_insert(path: str):
    return _each("string", pa.string(), _insert_at(_steps(path)), "JSON_ARRAY_INSERT.")


def json_strip_nulls(include_arrays: bool = True, remove_empty: bool = False):
    return _each("string", pa.string(), lambda t: _dump(_stripped(json.loads(t), include_arrays, remove_empty)), "JSON_STRIP_NULLS.")


def json_keys(depth: int | None = None):
    return _each("array<string>", pa.list_(pa.string()), lambda t: sorted(_walked(json.loads(t), [], depth)), "JSON_KEYS.")


def json_flatten():
    return _each("array<string>", pa.list_(pa.string()), lambda t: _flat(json.loads(t)), "JSON_FLATTEN.")


# FORMAT

_SPEC = re.compile(r"%([-+ #0']*)(\*|\d+)?(?:\.(\*|\d+))?([diuoxXfFeEgGsptT%])")


def _shown(value, kind: str, literal: bool) -> str:
    """%t, or %T if ``literal``: a value as text, or as an expression of the dialect."""
    if value is None:
        return "NULL"
    if kind.startswith("array<"):
        return "[" + ", ".join(_shown(x, kind[6:-1], literal) for x in value) + "]"
    if kind.startswith("struct<"):
        return "(" + ", ".join(_shown(x, "string" if isinstance(x, str) else "", literal) for x in value.values()) + ")"
    if isinstance(value, bool):
        return str(value).lower()
    if kind == "double":
        return f"{value:.1f}" if value == int(value) and abs(value) < 1e15 else repr(value)
    if kind == "string" and literal:
        return json.dumps(value, ensure_ascii=False)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        text = str(value).replace("T", " ").replace("Z", "+00").removesuffix(".000") if kind != "date" else str(value)
        names = {"date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME"}
        return f'{names[kind]} "{text}"' if literal else text
    return str(value)


def format_text(fmt: str, args: list[str]) -> str | None:
    """FORMAT: printf with %t and %T; null where a value of another element than these is null."""
    return _format_values(fmt, [(x.get("v"), x["k"]) for x in map(json.loads, args)])


def _format_values(fmt: str, values: list[tuple]) -> str | None:
    at, out, last = 0, [], 0
    for m in _SPEC.finditer(fmt):
        out.append(fmt[last : m.start()])
        last = m.end()
        flags, width, digits, kind = m.groups()
        if kind == "%":
            out.append("%")
            continue
        if width == "*":
            width, at = str(values[at][0]), at + 1
        if digits == "*":
            digits, at = str(values[at][0]), at + 1
        value, of = values[at]
        at += 1
        pad = flags.replace("'", "") + (width or "")
        if kind in "tT":
            out.append(("%" + pad + "s") % _shown(value, of, kind == "T"))
            continue
        if value is None:
            return None
        if kind == "p":
            kind, value = "s", json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        if kind in "iu":
            kind = "d"
        whole = "%" + pad + ("." + digits if digits is not None else "") + kind
        text = whole % (float(value) if kind in "fFeEgG" else value)
        if "'" in flags and kind in "dfF":
            head, dot, tail = text.strip().partition(".")
            text = (f"{int(head):,}" + dot + tail).rjust(len(text))
        out.append(text)
    if at < len(values):
        raise ValueError("FORMAT: more values than elements")
    return "".join([*out, fmt[last:]])


#: Types whose values FORMAT takes as they are; those of others cross as JSON.
PLAIN = ("tinyint", "smallint", "int", "bigint", "double", "boolean", "string")


def _values(column: pa.Array) -> list:
    """Values as JSON has them, in which floats that are no number are words."""
    if not pa.types.is_floating(column.type):
        return column.to_pylist()
    words = {math.inf: "Infinity", -math.inf: "-Infinity"}
    return [x if x is None or math.isfinite(x) else words.get(x, "NaN") for x in column.to_pylist()]


def _compiled(fmt: str, kinds: list[str]):
    """Of elements without stars, commas and JSON, Python's own format with a function for each value, and whether it may be null; None for other formats."""
    at, out, last, own = 0, [], 0, []
    for m in _SPEC.finditer(fmt):
        out.append(fmt[last : m.start()].replace("%", "%%"))
        last = m.end()
        flags, width, digits, kind = m.groups()
        if kind == "%":
            out.append("%%")
            continue
        if "'" in flags or "*" in (width, digits) or kind == "p" or at >= len(kinds):
            return None
        pad, of = flags + (width or ""), kinds[at]
        at += 1
        if kind in "tT":
            out.append("%" + pad + "s")
            own.append((lambda x, of=of, quoted=kind == "T": _shown(x, of, quoted), True))
        else:
            out.append("%" + pad + ("." + digits if digits is not None else "") + ("d" if kind in "iu" else kind))
            own.append((float if kind in "fFeEgG" else None, False))
    if at < len(kinds):
        return None
    return "".join([*out, fmt[last:].replace("%", "%%")]), own


def _formatted(fmt: pa.Array, kinds: pa.Array, *values: pa.Array) -> pa.Array:
    """``format_text`` of plain columns: a format is read once a batch."""
    if not len(fmt):
        return pa.array([], pa.string())
    of = kinds[0].as_py().split(",")
    columns = [_values(v) for v in values]
    one = fmt.unique()
    plan = _compiled(one[0].as_py(), of) if len(one) == 1 and one[0].is_valid else None
    if plan is None:
        rows = zip(*columns)
        return pa.array([None if f is None else _format_values(f, list(zip(r, of))) for f, r in zip(fmt.to_pylist(), rows)], pa.string())
    text, own = plan
    needed = [i for i, (_, nullable) in enumerate(own) if not nullable]
    for i, (f, nullable) in enumerate(own):
        if f is not None:
            columns[i] = [x if x is None and not nullable else f(x) for x in columns[i]]
    return pa.array([None if any(r[i] is None for i in needed) else text % r for r in zip(*columns)], pa.string())


@F.arrow_udf(T.StringType())
def _format_plain(fmt: pa.Array, kinds: pa.Array, *values: pa.Array) -> pa.Array:
    return _formatted(fmt, kinds, *values)


# FarmHash's 64-bit fingerprint, from its public description

_M64 = (1 << 64) - 1
#: The hash's three odd constants.
_K0, _K1, _K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _turn(x: int, n: int) -> int:
    return (x >> n | x << 64 - n) & _M64


def _word(b: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(b[at : at + size], "little")


def _fold16(u: int, v: int, mul: int) -> int:
    a = (u ^ v) * mul & _M64
    a ^= a >> 47
    b = (v ^ a) * mul & _M64
    return (b ^ b >> 47) * mul & _M64


def _weak(b: bytes, at: int, x: int, y: int) -> tuple[int, int]:
    """The state of a hash of 32 bytes, from two seeds."""
    w = [_word(b, at + 8 * i) for i in range(4)]
    x = x + w[0] & _M64
    y = _turn(y + x + w[3] & _M64, 21)
    first = x
    x = x + w[1] + w[2] & _M64
    y = y + _turn(x, 44) & _M64
    return x + w[3] & _M64, y + first & _M64


def farm_fingerprint(b: bytes) -> int:
    """FARM_FINGERPRINT as a signed integer."""
    n = len(b)
    mul = _K2 + 2 * n & _M64
    if n <= 16:
        if n >= 8:
            head, tail = _word(b, 0) + _K2 & _M64, _word(b, n - 8)
            h = _fold16(_turn(tail, 37) * mul + head & _M64, (_turn(head, 25) + tail) * mul & _M64, mul)
        elif n >= 4:
            h = _fold16(n + (_word(b, 0, 4) << 3) & _M64, _word(b, n - 4, 4), mul)
        elif n:
            y, z = b[0] + (b[n >> 1] << 8), n + (b[n - 1] << 2)
            mixed = y * _K2 & _M64 ^ z * _K0 & _M64
            h = (mixed ^ mixed >> 47) * _K2 & _M64
        else:
            h = _K2
    elif n <= 32:
        p, q = _word(b, 0) * _K1 & _M64, _word(b, 8)
        r, t = _word(b, n - 8) * mul & _M64, _word(b, n - 16) * _K2 & _M64
        h = _fold16(_turn(p + q & _M64, 43) + _turn(r, 30) + t & _M64, p + _turn(q + _K2 & _M64, 18) + r & _M64, mul)
    elif n <= 64:
        p, q = _word(b, 0) * _K2 & _M64, _word(b, 8)
        r, t = _word(b, n - 8) * mul & _M64, _word(b, n - 16) * _K2 & _M64
        y = _turn(p + q & _M64, 43) + _turn(r, 30) + t & _M64
        z = _fold16(y, p + _turn(q + _K2 & _M64, 18) + r & _M64, mul)
        e, f = _word(b, 16) * mul & _M64, _word(b, 24)
        g, k = (y + _word(b, n - 32)) * mul & _M64, (z + _word(b, n - 24)) * mul & _M64
        h = _fold16(_turn(e + f & _M64, 43) + _turn(g, 30) + k & _M64, e + _turn(f + p & _M64, 18) + g & _M64, mul)
    else:
        h = _farm_long(b)
    return h - (1 << 64) if h >> 63 else h


def _farm_long(b: bytes) -> int:
    n, seed = len(b), 81
    x, y = seed, seed * _K1 + 113 & _M64
    z = (y * _K2 + 113 & _M64)
    z = (z ^ z >> 47) * _K2 & _M64
    v, w = (0, 0), (0, 0)
    x = x * _K2 + _word(b, 0) & _M64
    stop, at = (n - 1) // 64 * 64, 0
    while at < stop:
        x = _turn(x + y + v[0] + _word(b, at + 8) & _M64, 37) * _K1 & _M64
        y = _turn(y + v[1] + _word(b, at + 48) & _M64, 42) * _K1 & _M64
        x ^= w[1]
        y = y + v[0] + _word(b, at + 40) & _M64
        z = _turn(z + w[0] & _M64, 33) * _K1 & _M64
        v = _weak(b, at, v[1] * _K1 & _M64, x + w[0] & _M64)
        w = _weak(b, at + 32, z + w[1] & _M64, y + _word(b, at + 16) & _M64)
        x, z = z, x
        at += 64
    mul = _K1 + ((z & 0xFF) << 1) & _M64
    at = n - 64
    w = w[0] + (n - 1 & 63) & _M64, w[1]
    v = v[0] + w[0] & _M64, v[1]
    w = w[0] + v[0] & _M64, w[1]
    x = _turn(x + y + v[0] + _word(b, at + 8) & _M64, 37) * mul & _M64
    y = _turn(y + v[1] + _word(b, at + 48) & _M64, 42) * mul & _M64
    x ^= w[1] * 9 & _M64
    y = y + v[0] * 9 + _word(b, at + 40) & _M64
    z = _turn(z + w[0] & _M64, 33) * mul & _M64
    v = _weak(b, at, v[1] * mul & _M64, x + w[0] & _M64)
    w = _weak(b, at + 32, z + w[1] & _M64, y + _word(b, at + 16) & _M64)
    x, z = z, x
    mixed = (y ^ y >> 47) * _K0 & _M64
    return _fold16(_fold16(v[0], w[0], mul) + mixed + z & _M64, _fold16(v[1], w[1], mul) + x & _M64, mul)


def _json_edit(builder):
    """A JSON function whose path is an argument of each row."""
    made = {}

    def f(text: str, path: str, *more: str):
        if path not in made:
            made[path] = builder(path)
        return made[path](text, *more)

    return f


_text, _bytes, _long, _texts = pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string())


def _suffix(h: str) -> str | None:
    two = ".".join(h.split(".")[-2:])
    return two if two in TWO_LABELS else h.split(".")[-1] or None


def _domain(h: str) -> str | None:
    s = _suffix(h)
    labels = h.split(".")[: -1 - s.count(".")] if s else []
    return f"{labels[-1]}.{s}" if labels and labels[-1] else None


def _fold(x: str) -> str:
    return unicodedata.normalize("NFKC", x).casefold()


#: By the name that SQL text calls them.
NAMED = {
    "weir_holds": _udf(T.BooleanType(), pa.bool_(), lambda x, part: part in _fold(x)),
    "weir_fold": _udf(T.StringType(), _text, _fold),
    "weir_normalize": _udf(T.StringType(), _text, lambda x, form: unicodedata.normalize(form, x)),
    "weir_casefold": _udf(T.StringType(), _text, lambda x, form: unicodedata.normalize(form, unicodedata.normalize(form, x).casefold())),
    "weir_to_base32": _udf(T.StringType(), _text, lambda b: base64.b32encode(b).decode()),
    "weir_from_base32": _udf(T.BinaryType(), _bytes, base64.b32decode),
    "weir_farm": _udf(T.LongType(), _long, farm_fingerprint),
    "weir_format": _udf(T.StringType(), _text, format_text),
    "weir_format_plain": _format_plain,
    "weir_ip": _udf(T.BinaryType(), _bytes, lambda x: ipaddress.ip_address(x).packed),
    "weir_safe_ip": _udf(T.BinaryType(), _bytes, _ip),
    "weir_ip_text": _udf(T.StringType(), _text, lambda b: str(ipaddress.ip_address(b))),
    "weir_mask": _udf(T.BinaryType(), _bytes, _mask),
    "weir_ip_trunc": _udf(T.BinaryType(), _bytes, lambda b, p: bytes(x & y for x, y in zip(b, _mask(len(b), p)))),
    "weir_suffix": _udf(T.StringType(), _text, _suffix),
    "weir_domain": _udf(T.StringType(), _text, _domain),
    "weir_json_set": _udf(T.StringType(), _text, _json_edit(lambda path: _set_at(_steps(path), True))),
    "weir_json_remove": _udf(T.StringType(), _text, _json_edit(lambda path: _remove_at(_steps(path)))),
    "weir_json_append": _udf(T.StringType(), _text, _json_edit(lambda path: _append_at(_steps(path)))),
    "weir_json_insert": _udf(T.StringType(), _text, _json_edit(lambda path: _insert_at(_steps(path)))),
    "weir_json_strip": _udf(T.StringType(), _text, lambda t: _dump(_stripped(json.loads(t), True, False))),
    "weir_json_keys": _udf(T.ArrayType(T.StringType()), _texts, lambda t: sorted(_walked(json.loads(t), [], None))),
    "weir_json_flatten": _udf(T.ArrayType(T.StringType()), _texts, lambda t: _flat(json.loads(t))),
}
