"""Sharding by size-tiered compaction with a versioned manifest.

A store is a folder with immutable Parquet shards and manifests. Arrivals are
appended as runs of small shards, each shard as a task wrote it. Runs within a
factor of ``fan_in`` of each other's bytes are a tier; when a tier holds
``fan_in`` runs, they are merged into one run of files of about the target size,
by one shuffle of just their rows, until no tier is full. A run whose files are
well under the target is rewritten so whatever its size and its tier.

What runs there are, and which files they have, is said by the newest manifest
alone. A manifest is written under another name and then linked or renamed to
the next version, which fails if that version exists: readers see a whole
version or none, a writer that dies leaves nothing that others wait for, and one
that lost a race starts anew from the version that won. On object stores, give
``root`` a file system whose rename without overwriting is atomic. ``vacuum``
removes old manifests, the files that no kept version names, and what failed
writers left.

Defined cases: all columns and rows pass through, nulls, very long texts and
repeated rows included; columns named like the operator's own (``_weir_arrival``,
``_weir_deal``) pass through too; an empty arrival adds no run; a store without
runs reads as an empty table of the given schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Tries of a writer that others keep overtaking.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards under ``root`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fan_in = target_bytes, fan_in
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _list(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files right under a folder of the store."""
        at = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(at):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at) if s.isFile())

    def _folders(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()) if self._fs.exists(at) else []

    def _run(self, folder: str) -> dict | None:
        files = [(n, b) for n, b in self._list(folder) if n.endswith(".parquet") and b]
        return {"folder": folder, "files": files, "bytes": sum(b for _, b in files)} if files else None

    # manifests

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._list("manifests") if n.endswith(".json") and n.startswith("v")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or the one asked for; version 0 has no runs."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, runs: list[dict]) -> dict:
        """Make ``runs`` the version after ``base``; Conflict if there is one."""
        new = {"version": base["version"] + 1, "runs": runs}
        to = self._path(f"{self.root}/manifests/v{new['version']:012d}.json")
        tmp = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":  # whose rename replaces; a link does not
                files, at = jvm.java.nio.file.Files, lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                files.createLink(at(to), at(tmp))
                self._fs.delete(tmp, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
                never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(context.makeQualified(tmp), context.makeQualified(to), never)
        except Exception as e:
            self._fs.delete(tmp, False)
            if not self._fs.exists(to):
                raise
            raise Conflict(f"version {new['version']} is taken") from e
        return new

    def _commit(self, change) -> dict | None:
        """Commit what ``change`` makes of the newest runs, anew while others win the race; None if it gives up."""
        for k in range(TRIES):
            now = self.manifest()
            runs = change(now["runs"])
            if runs is None:
                return None
            try:
                return self.commit(now, runs)
            except Conflict:
                time.sleep(0.05 * 2 ** min(k, 6))
        raise Conflict("other writers kept committing")

    def _free(self, name: str) -> str:
        """``name``, or one like it, that is no column's."""
        while name in self.schema.names:
            name += "_"
        return name

    # writing

    def append(self, rows: DataFrame, arrival: Column | None = None) -> dict:
        """Write ``rows`` as they are dealt, small shards and all; one run, or one for each value of ``arrival``, each committed in turn."""
        folder = f"runs/{uuid.uuid4().hex}"
        out = rows.select(*self.schema.names)
        if arrival is None:
            out.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            found = [self._run(folder)]
        else:
            name = self._free("_weir_arrival")
            out.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
            found = [self._run(f"{folder}/{sub}") for sub in self._folders(folder) if sub.startswith(name)]
        now = self.manifest()
        for run in found:
            if run:
                now = self._commit(lambda runs: [*runs, run])  # noqa: B023
        return now

    def wanted(self, runs: list[dict]) -> int:
        """How many files of about the target size hold ``runs``."""
        return max(1, round(sum(r["bytes"] for r in runs) / self.target_bytes))

    def loose(self, run: dict) -> bool:
        """Whether a run has files, at least two, of under half the target. What a merge wrote is so only if it came out smaller than thought."""
        return sum(b < self.target_bytes / 2 for _, b in run["files"]) > 1 and self.wanted([run]) < run.get("wanted", math.inf)

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """The merges to make: of every tier with ``fan_in`` runs that are loose or of less than the target each, all its runs; then every other loose run.

        Runs near a tier's edge count with the tier above it if that fills it,
        so runs of one size aren't kept apart by the logarithm.
        """
        loose = [r for r in runs if self.loose(r)]
        small = sorted((r for r in runs if r in loose or r["bytes"] < self.target_bytes * self.fan_in), key=lambda r: r["bytes"])
        out, held = [], []
        for r in small:
            if held and r["bytes"] > self.fan_in * held[0]["bytes"]:
                if len(held) >= self.fan_in:
                    out.append(held)
                held = []
            held.append(r)
        if len(held) >= self.fan_in:
            out.append(held)
        met = {r["folder"] for held in out for r in held}
        return [*out, *([r] for r in loose if r["folder"] not in met)]

    def compact(self) -> dict:
        """Merge until no tier is full; every merge is one new version."""
        while merges := self.plan(self.manifest()["runs"]):
            merged = merges[0]
            files = self.wanted(merged)
            folder = f"runs/{uuid.uuid4().hex}"
            rows, name = self._read(merged), self._free("_weir_deal")
            # dealt by a hash of the whole row, so no key is hot; rows that are alike in all columns are many only by their own size
            deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *self.schema.names), F.lit(1 << 20))
            rows.withColumn(name, deal).repartition(files, name).drop(name).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone, made = {r["folder"] for r in merged}, self._run(folder)

            def swap(runs: list[dict]) -> list[dict] | None:
                if not gone <= {r["folder"] for r in runs}:  # noqa: B023
                    return None  # another writer merged some of these
                return [*(r for r in runs if r["folder"] not in gone), *([made | {"wanted": files}] if made else [])]  # noqa: B023

            if self._commit(swap) is None:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return self.manifest()

    def vacuum(self, keep: int = 1, grace_seconds: float = 0) -> None:
        """Remove all but the last ``keep`` versions and the runs that none of these names.

        Runs of writers that have not committed look like those of writers
        that died: with writers about, give ``grace_seconds`` that none of
        them takes longer than.
        """
        versions = sorted(self.versions())
        named = {r["folder"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        roots = {"/".join(f.split("/")[:2]) for f in named}
        before = (time.time() - grace_seconds) * 1000

        def drop(path: str) -> None:
            at = self._path(f"{self.root}/{path}")
            if self._fs.exists(at) and (not grace_seconds or self._fs.getFileStatus(at).getModificationTime() < before):
                self._fs.delete(at, True)

        for old in versions[:-keep]:
            drop(f"manifests/v{old:012d}.json")
        for name, _ in self._list("manifests"):
            if name.endswith(".tmp"):
                drop(f"manifests/{name}")
        for name in self._folders("runs"):
            if f"runs/{name}" not in roots:
                drop(f"runs/{name}")
            elif f"runs/{name}" not in named:
                for sub in self._folders(f"runs/{name}"):
                    if f"runs/{name}/{sub}" not in named:
                        drop(f"runs/{name}/{sub}")

    # reading

    def _read(self, runs: list[dict]) -> DataFrame:
        files = [f"{self.root}/{r['folder']}/{name}" for r in runs for name, _ in r["files"]]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._read(self.manifest(version)["runs"])

    def shards(self, *columns: str, version: int | None = None) -> DataFrame:
        """``columns`` of all rows of a version with the shard's file name and the version."""
        now = self.manifest(version)
        rows = self._read(now["runs"])
        name = F.col("_metadata.file_name") if now["runs"] else F.lit(None).cast("string")
        return rows.select(*columns, name.alias("shard"), F.lit(now["version"]).cast("long").alias("version"))


def shard(docs: DataFrame, root: str, *, arrivals: int = 8, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, id_col: str = "doc_id") -> ShardStore:
    """Append ``docs`` in ``arrivals`` by the hash of their ids, compact, and drop what no version needs."""
    store = ShardStore(docs.sparkSession, root, docs.schema, target_bytes=target_bytes, fan_in=fan_in)
    store.append(docs, F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals)))
    store.compact()
    store.vacuum()
    return store


def op9_compaction(spark, sf_dir: str) -> DataFrame:
    from .common import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, f"{scratch(spark)}/shards-{uuid.uuid4().hex}").shards("doc_id")
