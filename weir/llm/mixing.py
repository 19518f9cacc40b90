"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's place in its source's permutation is a 63-bit hash of its id.
The top bits of that hash name its block. A source whose target is r times its
size is read floor(r) times whole and once more up to a cut in the
permutation, found by three histograms that refine the cut's bits (at most
4,096 bins a source meet in one sort); nothing but one row per source, source
and block, or source and key under the cut's 24-bit prefix reaches the driver.
Shards follow the words (``SHARD_WORDS`` in each, ``SHARDS`` at least), and a
source has blocks in proportion to its words, so there are some ``UNITS``
blocks a shard, whatever the size and the number of sources.

The units (source, copy, block) are the balls of the tree: a node that feeds n
shards sends each half its share of the units, drawn from the exact per-source
quotas by one multivariate-hypergeometric sample, until a leaf is one shard.
Each source's units, permuted, are then dealt to shards by those quotas, so
blocks of a shard are disjoint and quotas add up exactly. Within a shard rows
follow another hash.

Defined cases: null text has size 0; null source is a source of its own, last
in order; rows with one id are taken alike; a null id hashes like any value;
very long texts are counted whole; an empty table gives an empty result; of a
table with columns named like the operator's own (prefix ``_mix_``) these are
replaced, all others pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

WORDS = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SHARDS, SHARD_WORDS, UNITS = 16, 160_000_000, 64
#: A source's blocks are at most 2 to this.
MOST_BITS = 24
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Split ``share`` of all sizes by weight; who passes ``cap`` times its size stops there and the excess is shared anew."""
    n = np.array(sizes, dtype=float)
    w = np.resize(np.array(weights, dtype=float), len(n))
    out, free = np.zeros(len(n)), np.ones(len(n), dtype=bool)
    while free.any():
        unit = (share * n.sum() - out.sum()) / w[free].sum()
        over = free & (unit * w > cap * n)
        if not over.any():
            out[free] = unit * w[free]
            break
        out[over] = cap * n[over]
        free &= ~over
    return out.tolist()


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Deal each source's exact quota of units among shards: for each shard the sources it has units of, and how many."""
    own = np.flatnonzero(quotas)
    return _split(own, quotas[own], shards, rng)


def _split(sources: np.ndarray, quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    if shards == 1:
        return [(sources, quotas)]
    left = shards // 2
    took = rng.multivariate_hypergeometric(quotas, round(int(quotas.sum()) * left / shards), method="marginals") if len(quotas) else quotas
    halves = (took, left), (quotas - took, shards - left)
    return [x for q, n in halves for x in _split(sources[q > 0], q[q > 0], n, rng)]


def _cuts(rows: DataFrame, need: dict[int, float]) -> dict[int, int]:
    """Per source the key up to which (included) documents add up to nearest ``need`` words."""
    spark, cut, shift = rows.sparkSession, {s: -1 for s in need}, 63
    open_ = {s: (0, float(n)) for s, n in need.items() if n > 0}
    for level in range(2):
        if not open_:
            return cut
        at = small(spark, [(s, p, n) for s, (p, n) in open_.items()], "_mix_sid int, _mix_prefix long, _mix_need double")
        inside = rows.join(at, "_mix_sid")
        if level:
            inside = inside.where(F.shiftright("_mix_key", shift) == F.col("_mix_prefix"))
        shift -= LEVEL_BITS
        bins = inside.groupBy("_mix_sid", "_mix_need", F.shiftright("_mix_key", shift).alias("bin")).agg(F.sum("_mix_size").alias("sz"))
        up = F.sum("sz").over(Window.partitionBy("_mix_sid").orderBy("bin"))
        found = bins.withColumn("up", up).where("up >= _mix_need and up - sz < _mix_need").collect()
        for s in set(open_) - {r["_mix_sid"] for r in found}:
            cut[s] = 2**63 - 1  # rounding asked for a little more than there is
        open_ = {r["_mix_sid"]: (r["bin"], r["_mix_need"] - (r["up"] - r["sz"])) for r in found}
    if not open_:
        return cut
    at = small(spark, [(s, p) for s, (p, _) in open_.items()], "_mix_sid int, _mix_prefix long")
    last = rows.join(at, "_mix_sid").where(F.shiftright("_mix_key", shift) == F.col("_mix_prefix"))
    keys: dict[int, list] = {}
    for r in last.groupBy("_mix_sid", "_mix_key").agg(F.sum("_mix_size").alias("sz")).collect():
        keys.setdefault(r["_mix_sid"], []).append((r["_mix_key"], r["sz"]))
    for s, (prefix, n) in open_.items():
        best, cut[s], had = abs(n), (prefix << shift) - 1, 0
        for key, sz in sorted(keys[s]):
            had += sz
            if abs(n - had) < best:
                best, cut[s] = abs(n - had), key
    return cut


def assign(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 17, keep_text: bool = True, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Add to every row: _mix_size, _mix_source_size, _mix_target and _mix_places, an array of (copy, shard), empty if not taken.

    With ``keep_text`` false the text is dropped, and words are counted just once.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c.startswith("_mix_")))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 1)
    size = word_count(F.col(text_col))
    sized = docs.withColumns({"_mix_size": size, "_mix_has": F.coalesce(F.col(text_col).rlike(HAS_WORD), F.lit(False)), "_mix_key": key})
    if not keep_text:
        sized = stage(sized.drop("_mix_has", text_col), "mix").withColumn("_mix_has", F.col("_mix_size") > 0)
    narrow = sized.select(F.col(source_col).cast("string").alias("_mix_source"), "_mix_size", "_mix_key")
    narrow = stage(narrow, "mix") if keep_text else narrow
    found = [(r[0], r[1]) for r in narrow.groupBy("_mix_source").agg(F.sum("_mix_size")).collect()]
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode()))
    total = sum(n for _, n in found)
    shards = shards or max(SHARDS, total // SHARD_WORDS)
    goal = targets([n for _, n in found], weights, share, cap) if total else [0.0] * len(found)
    passes = [min(int(cap), int(t // n)) if n else 0 for t, (_, n) in zip(goal, found)]
    bits = [min(MOST_BITS, max(0, math.ceil(math.log2(max(n * UNITS * shards / max(total, 1), 1))))) for _, n in found]
    known = small(spark, [(s, i, int(n), float(t), p, b) for i, ((s, n), t, p, b) in enumerate(zip(found, goal, passes, bits))], "_mix_name string, _mix_sid int, _mix_source_size long, _mix_target double, _mix_passes int, _mix_bits int")
    rows = narrow.join(known, F.col("_mix_source").eqNullSafe(F.col("_mix_name")))
    cuts = _cuts(rows.select("_mix_sid", "_mix_size", "_mix_key"), {i: t - p * n for i, ((_, n), t, p) in enumerate(zip(found, goal, passes))})
    cut = small(spark, list(cuts.items()), "_mix_sid int, _mix_cut long")
    known = known.join(cut, "_mix_sid")

    # the units of the tree: the blocks that each copy of a source has
    block = F.expr("cast(shiftright(shiftright(_mix_key, 31), 32 - _mix_bits) as int)")
    copies = F.when(F.col("_mix_has"), F.col("_mix_passes") + (F.col("_mix_key") <= F.col("_mix_cut")).cast("int")).otherwise(0)
    had = rows.select("_mix_sid", "_mix_key", "_mix_passes", "_mix_bits", (F.col("_mix_size") > 0).alias("_mix_has")).join(cut, "_mix_sid")
    units = had.groupBy("_mix_sid", block.alias("b")).agg(F.max(copies).alias("n")).orderBy("_mix_sid", "b").toArrow()
    sid, b, n = (c.to_numpy() for c in units.columns)
    # one line per unit: the source's blocks, copy by copy
    of = np.repeat(np.arange(len(sid)), n)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    rng = np.random.default_rng(seed)
    dealt = split(np.bincount(sid[of], minlength=len(found)), shards, rng)
    to_sid, to_n = (np.concatenate([x[i] for x in dealt] or [np.zeros(0, np.int64)]) for i in range(2))
    to_shard = np.repeat(np.repeat(np.arange(shards), [len(x[0]) for x in dealt]), to_n)
    # a source's shards, in order, meet its units, permuted
    shard_of = np.zeros(len(of), dtype=np.int64)
    shard_of[np.lexsort((rng.random(len(of)), sid[of]))] = to_shard[np.argsort(np.repeat(to_sid, to_n), kind="stable")]
    ends = np.cumsum(n)
    places = [(int(s), int(x), shard_of[e - k : e].tolist()) for s, x, k, e in zip(sid, b, n, ends)]
    to = small(spark, places, "_mix_sid int, _mix_block int, _mix_to array<int>")
    out = sized.join(known, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_name"))).withColumn("_mix_block", block)
    out = out.join(to, ["_mix_sid", "_mix_block"], "left")
    pair = F.transform(F.slice(F.coalesce("_mix_to", F.array().cast("array<int>")), F.lit(1), copies), lambda k, c: F.struct(c.cast("int").alias("copy"), k.alias("shard")))
    return out.withColumn("_mix_places", pair).drop("_mix_name", "_mix_sid", "_mix_block", "_mix_to", "_mix_passes", "_mix_cut", "_mix_bits", "_mix_has")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: ``docs`` rows once per copy taken, with _mix_shard and _mix_copy, each shard shuffled in itself."""
    seed = options.get("seed", 17)
    own = [c for c in docs.columns if not c.startswith("_mix_")]
    taken = assign(docs, **options).select(*own, F.explode("_mix_places").alias("_mix_p"), "_mix_key")
    taken = taken.select(*own, F.col("_mix_p.shard").alias("_mix_shard"), F.col("_mix_p.copy").alias("_mix_copy"), F.xxhash64(F.lit(seed + 1), "_mix_key", "_mix_p.copy").alias("_mix_order"))
    # a shard's rows are salted by their hash, so one shard spans up to 8 partitions
    return taken.repartition(F.col("_mix_shard"), F.pmod("_mix_order", F.lit(8))).sortWithinPartitions("_mix_shard", "_mix_order").drop("_mix_order")


def op1_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = assign(docs, keep_text=False)
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.size("_mix_places") * F.col("_mix_size")).cast("long").alias("taken"), F.col("_mix_places.shard").alias("shards"))
