"""Managed tables: versioned Parquet with DML, time travel, snapshots and information schema.

A table is a folder of data folders and one manifest per version. A manifest
names the data folders that its version has, and of each the files that it no
longer has. So an insert writes its own rows only, and DELETE, UPDATE and MERGE
rewrite just the files that hold rows they change. A manifest is written under
another name and then linked or renamed to the next number, which fails if that
is taken: a version is seen whole or not at all, a writer that dies leaves
nothing that others wait for, and readers of an older version are undisturbed.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

_RID = "_weir_rid"


class Conflict(RuntimeError):
    """Another writer made this version first, or rows matched more than once."""


@dataclass
class When:
    """A MERGE clause: kind ``matched``, ``not_matched`` or ``not_matched_by_source``; action update, delete or insert."""

    kind: str
    action: str
    cond: Column | None = None
    values: dict[str, Column] | None = None


class Catalog:
    """Datasets of tables under a root folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self, name: str) -> list[int]:
        return [int(n[1:-5]) for n in self._names(f"{self.root}/{name}/manifests") if n.startswith("v") and n.endswith(".json")]

    def _manifest(self, name: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}/manifests/v{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def history(self, name: str) -> list[dict]:
        """All versions' manifests, oldest first."""
        return [self._manifest(name, v) for v in self._versions(name)]

    def _now(self, name: str) -> dict:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"table {name} does not exist")
        return self._manifest(name, max(versions))

    def _commit(self, name: str, base: int, schema: StructType, parts: list[dict], options: dict, at: float | None = None) -> int:
        """Make ``parts`` ({folder, without}) the version after ``base``."""
        version = base + 1
        body = {"version": version, "schema": json.loads(schema.json()), "parts": parts, "options": options, "committed": time.time() if at is None else at}
        to = self._path(f"{self.root}/{name}/manifests/v{version:012d}.json")
        tmp = self._path(f"{self.root}/{name}/manifests/_{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":  # whose rename replaces; a link does not
                file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(file(to), file(tmp))
                self._fs.delete(tmp, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(context.makeQualified(tmp), context.makeQualified(to), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(tmp, False)
            if not self._fs.exists(to):
                raise
            raise Conflict(f"{name}: version {version} is taken") from e
        return version

    def _data(self, name: str, df: DataFrame, options: dict) -> list[dict]:
        """Write rows to a data folder of their own."""
        folder = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        by = options.get("partition_by")
        writer = df.write
        if by:
            writer = df.withColumn("_p", F.date_trunc("DAY", by).cast("date") if options.get("partition_kind") == "DAY" else F.col(by)).write.partitionBy("_p")
        writer.parquet(folder)
        return [{"folder": folder, "without": []}]

    def _write(self, name: str, df: DataFrame, base: int, options: dict, at: float | None = None) -> int:
        """``df`` as the whole version after ``base``."""
        return self._commit(name, base, df.schema, self._data(name, df, options), options, at)

    def _checked(self, df: DataFrame, schema: StructType, options: dict) -> DataFrame:
        """Rows in the table's columns: defaults for those that are left out, an error for a null where none may be."""
        out, given = [], set(df.columns)
        for f in schema:
            own = F.col(f"`{f.name}`") if f.name in given else F.expr(options.get("defaults", {}).get(f.name) or "NULL")
            if f.name in options.get("required", []):
                own = F.when(own.isNotNull(), own).otherwise(F.raise_error(F.lit(f"column {f.name} must not be null")).cast(f.dataType))
            out.append(own.cast(f.dataType).alias(f.name))
        return df.select(*out)

    # DDL

    def create(self, name: str, df_or_schema: DataFrame | StructType, *, at: float | None = None, **options) -> int:
        """CREATE TABLE (a schema) or CREATE TABLE AS SELECT (a DataFrame)."""
        if self._versions(name):
            raise ValueError(f"table {name} exists")
        if isinstance(df_or_schema, DataFrame):
            return self._write(name, df_or_schema, 0, options, at)
        return self._commit(name, 0, df_or_schema, [], options, at)

    def replace(self, name: str, df: DataFrame, **options) -> int:
        """CREATE OR REPLACE TABLE … AS: older versions stay readable."""
        return self._write(name, df, self._now(name)["version"], options)

    def create_external(self, name: str, form: str, uris: list[str]) -> int:
        """CREATE EXTERNAL TABLE: read where it lies, whenever it is read."""
        options = {"external": {"format": {"NEWLINE_DELIMITED_JSON": "json"}.get(form.upper(), form.lower()), "uris": uris}}
        return self._commit(name, 0, self._external(options["external"]).schema, [], options)

    def _external(self, own: dict) -> DataFrame:
        reader = self.spark.read
        return (reader.option("header", True).option("inferSchema", True) if own["format"] == "csv" else reader).format(own["format"]).load(own["uris"])

    def create_schema(self, name: str, *, if_not_exists: bool = False) -> None:
        at = self._path(f"{self.root}/_schemas/{name}")
        if self._fs.exists(at) and not if_not_exists:
            raise ValueError(f"schema {name} exists")
        self._fs.mkdirs(at)

    def drop_schema(self, name: str, *, if_exists: bool = False) -> None:
        """Tables are named in one space, so a schema is never in use."""
        at = self._path(f"{self.root}/_schemas/{name}")
        if not self._fs.exists(at) and not if_exists:
            raise ValueError(f"schema {name} does not exist")
        self._fs.delete(at, True)

    def schemas(self) -> list[str]:
        return self._names(f"{self.root}/_schemas")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def clone(self, name: str, source: str, *, version: int | None = None) -> int:
        """CREATE TABLE … CLONE, COPY or SNAPSHOT: the source's files are shared, as no version is ever changed."""
        m = self._now(source) if version is None else self._manifest(source, version)
        if self._versions(name):
            raise ValueError(f"table {name} exists")
        return self._commit(name, 0, StructType.fromJson(m["schema"]), m["parts"], m["options"])

    def restore(self, name: str, version: int) -> int:
        """An older version becomes the newest."""
        m = self._manifest(name, version)
        return self._commit(name, self._now(name)["version"], StructType.fromJson(m["schema"]), m["parts"], m["options"])

    def rename(self, name: str, to: str) -> None:
        """ALTER TABLE … RENAME TO: the new name shares the files of the old one's newest version, whose name is given up."""
        if self._versions(to):
            raise ValueError(f"table {to} exists")
        m = self._now(name)
        if not self._fs.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{to}")):
            raise ValueError(f"{name} cannot be renamed")
        parts = [{**p, "folder": p["folder"].replace(f"{self.root}/{name}/", f"{self.root}/{to}/")} for p in m["parts"]]
        self._commit(to, m["version"], StructType.fromJson(m["schema"]), parts, m["options"])

    def rename_column(self, name: str, column: str, to: str) -> int:
        """The files are read under the old name."""
        m = self._now(name)
        schema = StructType([StructField(to if f.name == column else f.name, f.dataType, f.nullable, f.metadata) for f in StructType.fromJson(m["schema"])])
        read = m["options"].get("read_as", {})
        return self._commit(name, m["version"], schema, m["parts"], {**m["options"], "read_as": {**{k: v for k, v in read.items() if k != column}, to: read.get(column, column)}})

    def set_column(self, name: str, column: str, **change) -> int:
        """ALTER COLUMN: ``default`` (text of SQL, or None), ``required`` (False), ``kind`` (a wider type)."""
        m = self._now(name)
        options, schema = dict(m["options"]), StructType.fromJson(m["schema"])
        if "default" in change:
            options["defaults"] = {**options.get("defaults", {}), column: change["default"]}
        if change.get("required") is False:
            options["required"] = [c for c in options.get("required", []) if c != column]
        if "kind" in change:
            wide = StructType.fromDDL(f"`{column}` {change['kind']}")[0].dataType
            schema = StructType([StructField(f.name, wide if f.name == column else f.dataType, f.nullable) for f in schema])
            # files of the narrow type are written anew, under the columns' names of now, so all are read alike
            df = self.read(name).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
            options.pop("read_as", None)
            return self._commit(name, m["version"], schema, self._data(name, df, options), options)
        return self._commit(name, m["version"], schema, m["parts"], options)

    def add_column(self, name: str, column: str, kind: str) -> int:
        """Files keep their schema; the new column reads as null."""
        m = self._now(name)
        schema = StructType([*StructType.fromJson(m["schema"]), *StructType.fromDDL(f"`{column}` {kind}")])
        return self._commit(name, m["version"], schema, m["parts"], m["options"])

    def drop_column(self, name: str, column: str) -> int:
        m = self._now(name)
        schema = StructType([f for f in StructType.fromJson(m["schema"]) if f.name != column])
        return self._commit(name, m["version"], schema, m["parts"], m["options"])

    # reading

    def read(self, name: str, *, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The newest version, one by number, or FOR SYSTEM_TIME AS OF seconds since 1970."""
        if as_of is not None:
            if as_of > time.time():
                raise ValueError("FOR SYSTEM_TIME AS OF: in the future")
            kept = [m for m in self.history(name) if m["committed"] <= as_of]
            if not kept:
                raise ValueError(f"{name} did not exist then")
            m = kept[-1]
        else:
            m = self._now(name) if version is None else self._manifest(name, version)
        return self._of(m)

    def _of(self, m: dict, parts: list[dict] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts."""
        schema, options = StructType.fromJson(m["schema"]), m["options"]
        if "external" in options:
            return self._external(options["external"]).select(*schema.names)
        names = options.get("read_as", {})
        stored = StructType([StructField(names.get(f.name, f.name), f.dataType) for f in schema])
        paths = [x for p in (m["parts"] if parts is None else parts) for x in ([p["folder"]] if not p["without"] else self._files(p))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*paths).select(*[F.col(f"`{names.get(n, n)}`").alias(n) for n in schema.names])
        days, by = options.get("partition_expiration_days"), options.get("partition_by")
        # partitions past their time are not read, whether they are still there or not
        return out.where(F.col(by).isNull() | (F.col(by).cast("timestamp") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(days * 86400)))) if days and by else out

    def _files(self, part: dict) -> list[str]:
        """The files that a part still has."""
        gone, out = set(part["without"]), []
        found = self._fs.listFiles(self._path(part["folder"]), True)
        while found.hasNext():
            path = found.next().getPath()
            inner = path.toString()[path.toString().index(part["folder"].rsplit("/", 1)[-1]) :]
            if path.getName().endswith(".parquet") and inner not in gone:
                out.append(path.toString())
        return out

    # DML: each makes the next version and gives the number of rows it touched

    def insert(self, name: str, rows: DataFrame, *, at: float | None = None, options: dict | None = None) -> int:
        """Rows in a folder of their own, whatever the table's size. Writers that only insert don't get in each other's way."""
        m = self._now(name)
        parts = self._data(name, self._checked(rows, StructType.fromJson(m["schema"]), m["options"]), m["options"])
        n = self.spark.read.schema(StructType.fromJson(m["schema"])).option("recursiveFileLookup", True).parquet(parts[0]["folder"]).count()
        for k in range(20):
            try:
                self._commit(name, m["version"], StructType.fromJson(m["schema"]), [*m["parts"], *parts], {**m["options"], **(options or {})}, at)
                return n
            except Conflict:
                time.sleep(0.05 * 2 ** min(k, 6))
                m = self._now(name)
        raise Conflict(f"{name}: other writers kept committing")

    def truncate(self, name: str) -> int:
        m = self._now(name)
        n = self._of(m).count()
        self._commit(name, m["version"], StructType.fromJson(m["schema"]), [], m["options"])
        return n

    def _touched(self, m: dict, cond: Column) -> tuple[list[dict], list[dict], int]:
        """The parts without the files that hold rows where ``cond`` is true; parts of just those files; the number of such rows."""
        names = m["options"].get("read_as", {})
        schema = StructType.fromJson(m["schema"])
        stored = StructType([StructField(names.get(f.name, f.name), f.dataType) for f in schema])
        paths = [x for p in m["parts"] for x in ([p["folder"]] if not p["without"] else self._files(p))]
        if not paths:
            return m["parts"], [], 0
        rows = self.spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*paths)
        rows = rows.select(*[F.col(f"`{names.get(n, n)}`").alias(n) for n in schema.names], F.col("_metadata.file_path").alias("_weir_file"))
        # at most one row for each file
        hit = rows.where(F.coalesce(cond, F.lit(False))).groupBy("_weir_file").count().collect()
        by: dict[str, list[str]] = {}
        for r in hit:
            for p in m["parts"]:
                tail = p["folder"].rsplit("/", 1)[-1]
                if f"/{tail}/" in r[0]:
                    by.setdefault(p["folder"], []).append(r[0][r[0].index(tail) :])
        kept = [{"folder": p["folder"], "without": sorted({*p["without"], *by.get(p["folder"], [])})} for p in m["parts"]]
        own = [{"folder": p["folder"], "files": [f"{p['folder'].rsplit('/', 1)[0]}/{x}" for x in by[p["folder"]]]} for p in m["parts"] if p["folder"] in by]
        return kept, own, sum(r[1] for r in hit)

    def _rewrite(self, name: str, cond: Column, change) -> int:
        """Rewrite the files that hold rows where ``cond`` is true by ``change``, rows to rows."""
        m = self._now(name)
        kept, own, n = self._touched(m, cond)
        if not n:
            return 0
        schema, names = StructType.fromJson(m["schema"]), m["options"].get("read_as", {})
        stored = StructType([StructField(names.get(f.name, f.name), f.dataType) for f in schema])
        rows = self.spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*[f for p in own for f in p["files"]]).select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in schema.names])
        parts = self._data(name, self._checked(change(rows), schema, m["options"]).select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in schema.names]), m["options"])
        self._commit(name, m["version"], schema, [*kept, *parts], m["options"])
        return n

    def delete(self, name: str, cond: Column) -> int:
        """Rows where the condition is true go; where it is null they stay."""
        return self._rewrite(name, cond, lambda rows: rows.where(~F.coalesce(cond, F.lit(False))))

    def update(self, name: str, values: dict[str, Column], cond: Column, source: DataFrame | None = None, on: Column | None = None) -> int:
        """UPDATE … [FROM source]; a row that two source rows match is an error."""
        if source is None:
            hit = F.coalesce(cond, F.lit(False))
            return self._rewrite(name, cond, lambda rows: rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]))
        return self.merge(name, source, on & cond, [When("matched", "update", values=values)])

    def merge(self, name: str, source: DataFrame, on: Column, clauses: list[When]) -> int:
        """MERGE. Columns are named t_* and s_* in conditions and values; per row the first clause that applies acts.

        One outer join tags each pair; the check for a target row that several
        source rows would update rides on a window over the row's number.
        """
        target = self.read(name)
        cols = target.columns
        t = target.select(*[F.col(c).alias(f"t_{c}") for c in cols]).withColumn(_RID, F.monotonically_increasing_id())
        s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("_weir_s", F.lit(True))
        pairs = t.join(s, on, "full_outer")
        kind = F.when(F.col(_RID).isNull(), "not_matched").when(F.col("_weir_s").isNull(), "not_matched_by_source").otherwise("matched")
        action = F.lit(-1)
        for i, c in reversed(list(enumerate(clauses))):
            action = F.when((kind == c.kind) & F.coalesce(c.cond if c.cond is not None else F.lit(True), F.lit(False)), i).otherwise(action)
        updates = [i for i, c in enumerate(clauses) if c.action == "update" and c.kind == "matched"]
        deletes = [i for i, c in enumerate(clauses) if c.action == "delete"]
        w = Window.partitionBy(_RID)
        acted = pairs.withColumn("_weir_a", action)
        hits = F.sum((F.col("_weir_a") >= 0).cast("int")).over(w)
        bad = F.col(_RID).isNotNull() & (hits > 1) & F.lit(bool(updates))
        # of several pairs of a target row one is kept, a deleting one first
        place = F.row_number().over(w.orderBy(F.col("_weir_a").isin(deletes).desc(), F.desc("_weir_a")))
        one = acted.withColumns({"_weir_bad": bad, "_weir_n": F.when(F.col(_RID).isNull(), 1).otherwise(place)})
        one = one.where("_weir_n = 1 or _weir_bad")
        drop = F.col("_weir_a").isin(deletes) | (F.col(_RID).isNull() & (F.col("_weir_a") < 0))
        keep = one.where(~drop | F.col("_weir_bad"))

        def value(c: str) -> Column:
            out = F.col(f"t_{c}")
            for i, clause in enumerate(clauses):
                if clause.action == "insert":
                    out = F.when(F.col("_weir_a") == i, (clause.values or {}).get(c, F.lit(None) if clause.values else F.col(f"s_{c}"))).otherwise(out)
                elif clause.action == "update" and c in (clause.values or {}):
                    out = F.when(F.col("_weir_a") == i, clause.values[c]).otherwise(out)
            return out

        failed = F.raise_error(F.lit("MERGE: more than one source row matches a target row")).cast("boolean")
        m = self._now(name)
        n = one.where("_weir_a >= 0").count()
        rows = self._checked(keep.where(F.when(F.col("_weir_bad"), failed).otherwise(True)).select(*[value(c).alias(c) for c in cols]), StructType.fromJson(m["schema"]), m["options"])
        plain = {k: v for k, v in m["options"].items() if k != "read_as"}
        self._commit(name, m["version"], StructType.fromJson(m["schema"]), self._data(name, rows, plain), plain)
        return n

    # information schema

    def _all(self) -> list[tuple[str, dict]]:
        return [(n, self._now(n)) for n in self._names(self.root) if n != "_schemas" and self._versions(n)]

    def information_schema(self) -> dict[str, DataFrame]:
        """The INFORMATION_SCHEMA views by name: one row for each table, column, option, partition folder or schema."""
        tables, columns, paths, options, partitions, storage = [], [], [], [], [], []

        def walk(lead: str, kind: DataType):
            yield lead, kind.simpleString()
            if isinstance(kind, StructType):
                for f in kind:
                    yield from walk(f"{lead}.{f.name}", f.dataType)

        for name, m in self._all():
            tables.append((name, "EXTERNAL" if "external" in m["options"] else "BASE TABLE", m["version"]))
            required, defaults = m["options"].get("required", []), m["options"].get("defaults", {})
            for i, f in enumerate(StructType.fromJson(m["schema"])):
                nullable = "NO" if f.name in required or not f.nullable else "YES"
                columns.append((name, f.name, i + 1, nullable, f.dataType.simpleString(), defaults.get(f.name), "YES" if m["options"].get("partition_by") == f.name else "NO"))
                paths += [(name, f.name, path, kind) for path, kind in walk(f.name, f.dataType)]
            options += [(name, k, json.dumps(v)) for k, v in sorted(m["options"].items()) if k not in ("required", "defaults")]
            files = [x for p in m["parts"] for x in self._files(p)]
            storage.append((name, len(files), sum(self._fs.getFileStatus(self._path(x)).getLen() for x in files)))
            for key in sorted({part for x in files for part in x.split("/") if part.startswith("_p=")}):
                own = [x for x in files if f"/{key}/" in x]
                partitions.append((name, key[3:], sum(self._fs.getFileStatus(self._path(x)).getLen() for x in own)))
        make = self.spark.createDataFrame
        return {
            "TABLES": make(tables, "table_name string, table_type string, version long"),
            "COLUMNS": make(columns, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string, column_default string, is_partitioning_column string"),
            "COLUMN_FIELD_PATHS": make(paths, "table_name string, column_name string, field_path string, data_type string"),
            "TABLE_OPTIONS": make(options, "table_name string, option_name string, option_value string"),
            "PARTITIONS": make(partitions, "table_name string, partition_id string, total_logical_bytes long"),
            "TABLE_STORAGE": make(storage, "table_name string, total_partitions long, total_logical_bytes long"),
            "TABLE_SNAPSHOTS": make([(n, m["version"], float(m["committed"])) for n, _ in self._all() for m in self.history(n)], "table_name string, version long, snapshot_time double"),
            "SCHEMATA": make([(n,) for n in self.schemas()], "schema_name string"),
        }

    def tables(self) -> DataFrame:
        """INFORMATION_SCHEMA.TABLES."""
        return self.information_schema()["TABLES"]

    def columns(self) -> DataFrame:
        """INFORMATION_SCHEMA.COLUMNS."""
        return self.information_schema()["COLUMNS"]

    def transaction(self) -> "Transaction":
        return Transaction(self)


class Transaction:
    """Several statements; a failure takes every table back to the version it had."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def __enter__(self) -> Catalog:
        self.before = {n: m["version"] for n, m in self.catalog._all()}
        return self.catalog

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            return
        c = self.catalog
        for n in c._names(c.root):
            versions = c._versions(n)
            if versions and n not in self.before:
                c.drop(n)
            elif versions and max(versions) > self.before[n]:
                m = c._manifest(n, self.before[n])
                c._commit(n, max(versions), StructType.fromJson(m["schema"]), m["parts"], m["options"])
