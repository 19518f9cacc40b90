"""SimHash near-duplicates by similarity: BK-trees of fingerprints, each link confirmed by the exact Jaccard similarity of word-shingle sets.

Fingerprints of sets of similarity 0.8 differ in 9.7 of 64 bits with a
deviation of 2.9, so a radius of ``RADIUS`` misses none. Blocks of equal bits
cannot deal fingerprints for such a radius; here a shard is a key that the
sets share. A set has ``BANDS`` keys, each made of the least values of
``ROWS`` hashes of its shingles. Sets of similarity s agree on a hash with
chance s, so two of 0.8 share no key with chance (1 - 0.8^4)^20, under 3 in
100,000, and those more alike less often. What chains of shared keys connect is
one shard, so its texts move once; where that is more than ``split_at`` sets or
``HEAVY`` shingles, each of its keys is a shard, and keys that are still too
large are dealt again by one more key. A shard is a BK-tree; what a fingerprint
finds there within the radius is intersected, nearest first, except what links
already connect. So a shard of m sets yields under m links, whatever its size.
Distinct shingle sets, never documents, are searched.

Defined cases: null or wordless text has the empty set, and all of these are
one component; fewer words than a shingle: the whole sequence is the shingle;
rows with equal sets share a component; very long texts are hashed whole;
columns ``_row``, ``_node``, ``_size`` and ``_bands`` are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import as_bytes, components, discard, partitions, stage, text_batches
from .simhash import BKTree

LEAST = 0.8
BANDS, ROWS = 20, 4
SPLIT_AT, HEAVY = 4096, 4_000_000
#: Over the mean by six deviations; by five for the shortest sets that can be this similar without being equal, of four and five shingles.
RADIUS = 28
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
ROW, COMPONENT = "_row", "_component"


def hashes_of(text: bytes, width: int) -> np.ndarray:
    """The distinct XXH64 hashes of the lower-cased text's word shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = [words] if len(words) <= width else zip(*(words[j:] for j in range(width)))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(x)) for x in own]), dtype=">u8").astype(np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, none of them empty, its ``BANDS`` keys."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        # the high bits of a product depend on all bits of the hash
        x = np.minimum.reduceat(flat * factor, starts)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ x ^ x >> np.uint64(31)) * _MIX
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0) > len(hashes)).tobytes(), "big")


def similar_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` whose similarity is ``least`` or more."""
    sizes = [len(s) for s in sets]
    ends = np.cumsum(sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = [codes[z - n : z] for z, n in zip(ends, sizes)]
    inside, up, out = np.zeros(len(distinct), dtype=bool), list(range(len(sets))), []
    tree, at = BKTree(), {}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (fp, n) in enumerate(zip(fps.tolist(), sizes)):
        near = sorted(tree.insert(fp, RADIUS), key=lambda x: (x ^ fp).bit_count())  # noqa: B023
        found = [j for x in near for j in at[x] if min(n, sizes[j]) >= least * max(n, sizes[j])]
        at.setdefault(fp, []).append(i)
        inside[own[i]] = True
        for j in found:
            if top(i) != top(j):
                both = np.count_nonzero(inside[own[j]])
                if both >= least * (n + sizes[j] - both):
                    out.append((int(nodes[i]), int(nodes[j])))
                    up[top(i)] = top(j)
        inside[own[i]] = False
    return out


def marked(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """The rows with a key of the row, of its shingle set, the set's size and bands; an empty set has no bands."""
    text_batches(docs.sparkSession)
    docs = docs.drop(ROW, "_node", "_size", "_bands")
    at = docs.columns.index(text_col)
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    schema = StructType([*rows.schema.fields]).add("_node", LongType()).add("_size", LongType()).add("_bands", ArrayType(LongType()))

    def run(batches):
        for b in batches:
            sets = [hashes_of(t, width) for t in as_bytes(b.column(at))]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            full = [s for s in sets if len(s)]
            keys = band_keys(full).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            ends = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes), pa.array(list(map(len, sets)), pa.int64()), bands], names=schema.names)

    return rows.mapInArrow(run, schema)


def _links(rows: DataFrame, names: DataFrame, width: int, text_col: str, least: float, split_at: int) -> DataFrame:
    """Rows (a, b): links among the distinct sets of ``rows``; ``names`` has one row's key for each."""
    spark = rows.sparkSession
    one = rows.select(ROW, "_node", "_size", "_bands").join(names.select(ROW), ROW, "left_semi")
    first = stage(one.select("_node", "_size", F.posexplode("_bands").alias("shard", "key")), "bands")
    held = F.count("*").alias("n"), F.sum("_size").alias("heavy")
    large = (F.col("n") > split_at) | (F.col("heavy") > HEAVY)
    counts = first.groupBy("shard", "key").agg(*held, F.min("_node").alias("hub")).where("n > 1")
    crowded = stage(first.join(counts, ["shard", "key"]), "shards")
    met = components(crowded.where("_node <> hub").select(F.col("_node").alias("a"), F.col("hub").alias("b")))
    own = first.where("shard = 0").select("_node", "_size").join(met.withColumnRenamed("node", "_node"), "_node")
    groups = own.groupBy("root").agg(*held).where("n > 1").select("root", large.alias("large"))
    group = stage(own.join(groups, "root").select("_node", "root", "large"), "groups")
    whole = group.where("not large").select("_node", F.lit(-1).alias("shard"), F.col("root").alias("key"))
    some = crowded.join(group.where("large").select("_node"), "_node", "left_semi")
    others = first.select("_node", F.col("shard").alias("j"), F.col("key").alias("more"))
    again = some.where(large).join(others, "_node").where("shard <> j").select("_node", (F.lit(BANDS) + F.col("shard") * BANDS + F.col("j")).alias("shard"), F.xxhash64("key", "more").alias("key"))
    deal = whole.union(some.where(~large).select("_node", "shard", "key")).union(again)
    texts = rows.select(ROW, F.col(text_col).alias("text")).join(names.join(group.select("_node"), "_node", "left_semi"), ROW).select("_node", "text")
    text_batches(spark)
    dealt = deal.join(texts, "_node").select("shard", "key", "_node", "text").repartition(partitions(spark), "shard", "key").sortWithinPartitions("shard", "key", "_node")

    def run(batches):
        shard, nodes, sets = None, [], []

        def found():
            fps = np.array([fingerprint(s) for s in sets], dtype=np.uint64)
            x = np.array(similar_links(np.array(nodes), fps, sets, least), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])

        for b in batches:
            for s, k, node, text in zip(*(c.to_pylist() for c in b.columns[:3]), as_bytes(b.column(3))):
                if (s, k) != shard:
                    if len(nodes) > 1:
                        yield found()
                    shard, nodes, sets = (s, k), [], []
                nodes.append(node), sets.append(hashes_of(text, width))
        if len(nodes) > 1:
            yield found()

    # components() reads the links twice
    links = stage(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(first, crowded, group)
    return links


def grouped(docs: DataFrame, *, width: int = 5, least: float = LEAST, split_at: int = SPLIT_AT, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``ROW``, a key of the row, and ``_node``, that of its set; rows (node, root), the group of each set that has links."""
    rows = stage(marked(docs, width, text_col), "marked")
    names = stage(rows.groupBy("_node").agg(F.min(ROW).alias(ROW)), "names")
    return rows, components(_links(rows, names, width, text_col, least, split_at))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """Rows (``ROW``, ``COMPONENT``) beside the columns of ``docs``: a key of the row, and one of the group of near copies that it is in."""
    rows, roots = grouped(docs, **options)
    return rows.join(roots, rows["_node"] == roots.node, "left").select(*(c for c in docs.columns if c != ROW), ROW, F.coalesce("root", "_node").alias(COMPONENT))


def firsts(docs: DataFrame, rank: list, **options) -> DataFrame:
    """One row of ``docs`` for each group of near copies, the first by the columns ``rank``; only these are dealt, and texts once."""
    rows, roots = grouped(docs, **options)
    keys = rows.select("_node", F.struct(*rank, ROW).alias("rank")).join(roots, F.col("_node") == roots.node, "left")
    first = keys.groupBy(F.coalesce("root", "_node").alias(COMPONENT)).agg(F.min("rank").alias("rank")).select(F.col(f"rank.{ROW}").alias(ROW))
    return rows.join(stage(first, "first"), ROW, "left_semi").select(*docs.columns)
