"""SimHash near-duplicates linked through sharded BK-trees.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of the
text's word shingles. Distinct fingerprints, never documents, are searched.
Two fingerprints within radius r agree wholly on at least k-r of any k bit
blocks, so each one is dealt to C(k, k-r) shards, keyed by the bits of one
choice of blocks; every link meets in some shard. A shard is a BK-tree whose
children are keyed by their Hamming distance to the parent; a fingerprint
entering the tree follows only the edges within the radius. It reports one
link to each component of the shard that it touches, so a shard of m
fingerprints yields under m links, whatever its size, and connectivity is
exact. Shards with more than ``split_at`` fingerprints are dealt again by
blocks of their remaining bits, which keeps every link by the same argument,
and a task parts what is still larger in the same way, as long as that is less
work than one tree. A shard holds 64-bit numbers, never texts. Trees are built
where their shard is dealt and not broadcast, as they grow with the data.

Defined cases: null or wordless text has fingerprint zero, linked like any
other; fewer words than a shingle: the whole sequence is the shingle; repeated
rows share a component; a component of null ids alone has a null name; very
long texts are hashed whole; columns beside id and text are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, partitions, stage, text_batches

SEED = 42
BLOCKS = 5
SPLIT_AT = 4096
_POWERS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """The 64-bit fingerprints of lower-cased byte texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digests, ends, rows = [], [], []
    digest = xxhash.xxh64_digest
    pending = 0

    def flush() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8)).reshape(-1, 64)
        starts = np.array([0, *ends[:-1]])
        n = np.diff(np.array([0, *ends]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[rows] = ((2 * ones > n[:, None]) * _POWERS).sum(axis=1, dtype=np.uint64)
        digests.clear(), ends.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= width:
            own = [digest(b" ".join(words), SEED)]
        elif width == 3:
            own = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
        else:
            own = [digest(b" ".join(x), SEED) for x in zip(*(words[j:] for j in range(width)))]
        digests += own
        pending += len(own)
        ends.append(len(digests))
        rows.append(i)
        if len(digests) > 200_000:
            flush()
    if digests:
        flush()
    return out


def fingerprint(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            fp = fingerprints_of(as_bytes(b.column(1)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """Bit masks of all choices of ``keep`` among ``blocks`` even runs of ``bits``."""
    runs = [[b for b in part] for part in np.array_split(np.array(bits), blocks)]
    return [int(sum(1 << int(b) for run in pick for b in run)) for pick in combinations(runs, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """A tree over integers whose children are keyed by Hamming distance to the parent."""

    __slots__ = ("root", "below")

    def __init__(self) -> None:
        self.root: int | None = None
        self.below: dict[int, dict[int, int]] = {}

    def insert(self, x: int, radius: int) -> list[int]:
        """Put ``x`` in; the earlier members within ``radius`` of it."""
        if self.root is None:
            self.root, self.below[x] = x, {}
            return []
        found, todo, at = [], [self.root], self.root
        while todo:
            y = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                found.append(y)
            todo += [z for k, z in self.below[y].items() if d - radius <= k <= d + radius]
        while (d := (x ^ at).bit_count()) and d in self.below[at]:
            at = self.below[at][d]
        if d:
            self.below[at][d], self.below[x] = x, {}
        return found


def shard_links(members: list[int], radius: int, split_at: int = SPLIT_AT) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct ``members``.

    More than ``split_at`` members are parted by each of ``radius`` + 1 runs of
    the bits in which they differ, on one of which a link's ends agree, as
    long as that makes the trees less work.
    """
    up, links = {x: x for x in members}, []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    todo = [members]
    while todo:
        own = todo.pop()
        if len(own) > split_at:
            differ = 0
            for x in own:
                differ |= x ^ own[0]
            parts: list[list[int]] = []
            for run in _masks([b for b in range(64) if differ >> b & 1], radius + 1, 1):
                groups: dict[int, list[int]] = {}
                for x in own:
                    groups.setdefault(x & run, []).append(x)
                parts += [g for g in groups.values() if len(g) > 1]
            if 2 * sum(len(g) ** 2 for g in parts) < len(own) ** 2:
                todo += parts
                continue
        tree = BKTree()
        for x in own:
            for y in tree.insert(x, radius):
                a, b = top(x), top(y)
                if a != b:
                    up[a] = b
                    links.append((x, y))
    return links


def links(distinct: DataFrame, *, radius: int = 3, blocks: int = BLOCKS, split_at: int = SPLIT_AT) -> DataFrame:
    """Rows (a, b): links that connect just what the distinct ``fp`` within ``radius`` connect."""
    spark = distinct.sparkSession
    masks = _masks(list(range(64)), blocks, blocks - radius)
    # the level-two masks: a shard's members agree on its mask already, so they differ in the remaining bits only
    finer = [[m | x for x in _masks([b for b in range(64) if not m >> b & 1], radius + 1, 1)] for m in masks]
    first = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("shard", "key"))
    first = stage(first, "shards")
    counts = first.groupBy("shard", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = first.join(counts, ["shard", "key"])
    small = crowded.where(F.col("n") <= split_at).select("shard", "key", "fp")
    pick = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in own]) for own in finer]), F.col("shard") + 1)
    again = crowded.where(F.col("n") > split_at).select(F.col("shard").alias("s"), "fp", F.posexplode(pick).alias("j", "mask"))
    again = again.select((F.lit(len(masks)) + F.col("s") * len(finer[0]) + F.col("j")).alias("shard"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    dealt = small.union(again).repartition(partitions(spark), "shard", "key").sortWithinPartitions("shard", "key", "fp")

    def run(batches):
        shard, members = None, []
        out: list[tuple[int, int]] = []
        for b in batches:
            s, k, f = (b.column(i).to_numpy() for i in range(3))
            turns = np.flatnonzero((np.diff(s) != 0) | (np.diff(k) != 0)) + 1
            for lo, hi in zip([0, *turns], [*turns, len(s)]):
                if lo == hi:
                    continue
                if (s[lo], k[lo]) != shard:
                    if len(members) > 1:
                        out += shard_links(members, radius, split_at)
                    shard, members = (s[lo], k[lo]), []
                members += f[lo:hi].view(np.uint64).tolist()
            if out:
                yield _pairs(out)
                out = []
        if len(members) > 1:
            out += shard_links(members, radius, split_at)
        if out:
            yield _pairs(out)

    return dealt.mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(rows, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id): one per document; the component is named by the smallest id in it."""
    fps = stage(fingerprint(docs, width=width, id_col=id_col, text_col=text_col), "fps")
    distinct = stage(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius=radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
