"""Row ingestion and read sessions over managed tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Catalog

_TRUE, _FALSE = {"true", "1", "t", "y", "yes"}, {"false", "0", "f", "n", "no"}


def convert(value, kind: T.DataType):
    """A JSON value as a value of a column's type; ValueError if it isn't one."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError("array expected")
        return [convert(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict) or set(value) - set(kind.names):
            raise ValueError("record with unknown fields")
        return tuple(convert(value.get(f.name), f.dataType) for f in kind)
    if isinstance(value, (list, dict)):
        raise ValueError("scalar expected")
    if isinstance(kind, (T.LongType, T.IntegerType)):
        if isinstance(value, bool) or isinstance(value, float) and value != int(value):
            raise ValueError("integer expected")
        return int(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.BooleanType):
        text = str(value).lower()
        if text not in _TRUE | _FALSE:
            raise ValueError("boolean expected")
        return text in _TRUE
    if isinstance(kind, T.StringType):
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.DecimalType):
        try:
            return Decimal(str(value))
        except InvalidOperation as e:
            raise ValueError("number expected") from e
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(str(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, (int, float)):
            return dt.datetime.fromtimestamp(value, dt.timezone.utc).replace(tzinfo=None if isinstance(kind, T.TimestampNTZType) else dt.timezone.utc)
        return dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if isinstance(kind, T.BinaryType):
        import base64

        return base64.b64decode(value, validate=True)
    raise ValueError(f"{kind.simpleString()} can't be inserted")


def insert_all(catalog: Catalog, name: str, rows: list[dict], *, skip_invalid: bool = False, ignore_unknown: bool = False) -> list[dict]:
    """tabledata.insertAll: the rows that don't fit, by index and reason. Without ``skip_invalid`` one such row keeps all out."""
    schema = catalog.read(name).schema
    good, errors = [], []
    for i, row in enumerate(rows):
        try:
            unknown = set(row) - set(schema.names)
            if unknown and not ignore_unknown:
                raise ValueError(f"no such field: {sorted(unknown)[0]}")
            good.append(tuple(convert(row.get(f.name), f.dataType) for f in schema))
        except (ValueError, TypeError) as e:
            errors.append({"index": i, "reason": "invalid", "message": str(e)})
    if good and (skip_invalid or not errors):
        catalog.insert(name, catalog.spark.createDataFrame(good, schema))
    return errors


def list_rows(catalog: Catalog, name: str, *, start: int = 0, most: int = 100, columns: list[str] | None = None) -> list[dict]:
    """tabledata.list: a page of rows."""
    df = catalog.read(name)
    return [r.asDict(recursive=True) for r in df.select(*(columns or df.columns)).offset(start).limit(most).collect()]


def read_session(catalog: Catalog, name: str, *, columns: list[str] | None = None, restriction: Column | str | None = None, version: int | None = None, streams: int = 1) -> list[DataFrame]:
    """A storage read session: one version, restricted and pruned in the scan, in ``streams`` disjoint parts."""
    df = catalog.read(name, version=version if version is not None else catalog._now(name)["version"])
    df = df if restriction is None else df.where(restriction)
    df = df.select(*columns) if columns else df
    if streams == 1:
        return [df]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(streams))
    return [df.where(part == k) for k in range(streams)]


class WriteStream:
    """A storage write stream: COMMITTED rows show at once, BUFFERED ones up to a flush, PENDING ones when streams are committed together."""

    def __init__(self, catalog: Catalog, name: str, kind: str = "COMMITTED") -> None:
        self.catalog, self.name, self.kind = catalog, name, kind
        self.batches: list[DataFrame] = []
        self.offset, self.flushed, self.final = 0, 0, False

    def append(self, rows: DataFrame, offset: int | None = None) -> int:
        """The offset after the rows. An offset that was written already is an error, so a retried append does nothing twice."""
        if self.final:
            raise ValueError("the stream is finalized")
        if offset is not None and offset != self.offset:
            raise ValueError(f"offset {offset}; the next is {self.offset}")
        n = rows.count()
        self.offset += n
        if self.kind == "COMMITTED":
            self.catalog.insert(self.name, rows)
        else:
            # written now: what is committed later are these rows, whatever becomes of their source
            m = self.catalog._now(self.name)
            parts = self.catalog._data(self.name, self.catalog._checked(rows, T.StructType.fromJson(m["schema"]), m["options"]), m["options"])
            self.batches.append(self.catalog._of(m, parts))
        return self.offset

    def flush(self) -> None:
        """BUFFERED rows so far become visible."""
        self._insert()

    def finalize(self) -> int:
        self.final = True
        return self.offset

    def _insert(self) -> None:
        if self.batches:
            out = self.batches[0]
            for more in self.batches[1:]:
                out = out.unionByName(more)
            self.catalog.insert(self.name, out)
            self.batches = []


def commit_streams(streams: list[WriteStream]) -> None:
    """Finalized PENDING streams of one table become visible as one version."""
    if any(not s.final or s.kind != "PENDING" for s in streams) or len({s.name for s in streams}) != 1:
        raise ValueError("only finalized PENDING streams of one table are committed")
    first = streams[0]
    first.batches = [b for s in streams for b in s.batches]
    first._insert()
