"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words in lower case without punctuation.
Karp-Rabin hashes of all windows of ``shortest`` words, computed for a whole
batch at once, are joined with those of the items: a shared window is a seed.
For each document and item with a seed, successive seeds on one diagonal are
maximal matches; the longest is marked as a tile first, and what others lose to
marked words is cut off them before they are taken up again, until none of
``shortest`` words is left. Tiles don't overlap in the document or in the item,
and their order is free, so a reordered passage is covered like a straight one.
A document is contaminated by an item of which tiles cover ``least`` or more.

The items are a stated query set: they go to the tasks in blocks of some
``block_chars`` characters, one pass over the documents for each block, written
before the next block is made, so there is one block's index at a time.

Defined cases: null or empty text has no tiles; items without words match
nothing, items of fewer than ``shortest`` words must stand in the document
whole; of tiles of one length the earliest in the document, then in the item, is
marked first; repeated documents or items are judged alike; very long texts are
tiled whole; no items or no documents: an empty result; a column ``_hits`` is
replaced.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, discard, stage, text_batches
from .licences import words_of

SHORTEST = 5
LEAST = 0.6
BLOCK_CHARS = 4_000_000
#: Pairs of equal windows of texts and items that are sorted at once.
LOT = 1_000_000
_BASE = np.uint64(0x100000001B3)


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size if n > 0 else 0):
        h = h * _BASE + ids[j : j + n]
    return h


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in the document, start in the item) grown from seeds (places of equal windows)."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for d, i in seeds:
        if (doc[d : d + shortest] == item[i : i + shortest]).all():
            diagonals[d - i].append(d)
    heap: list[tuple[int, int, int]] = []

    def add(d: int, i: int, n: int) -> None:
        if n >= shortest:
            heapq.heappush(heap, (-n, d, i))

    for diagonal, at in diagonals.items():
        at.sort()
        begin = at[0]
        for x, y in zip(at, [*at[1:], -1]):
            if y != x + 1:
                add(begin, begin - diagonal, x - begin + shortest)
                begin = y
    doc_free, item_free = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        free = doc_free[d : d - n] & item_free[i : i - n]
        if free.all():
            doc_free[d : d - n] = item_free[i : i - n] = False
            tiles.append((-n, d, i))
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            add(d + a, i + a, z - a)
    return tiles


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], shortest: int = SHORTEST) -> None:
        words = [words_of((t or "").encode()) for _, t in items]
        self.vocab: dict[bytes, int] = {}
        for w in (w for x in words for w in x):
            self.vocab.setdefault(w, len(self.vocab) + 1)
        self.names = [i for i, _ in items]
        self.items = [np.array([self.vocab[w] for w in x], dtype=np.uint64) for x in words]
        #: By window size: sorted hashes with the item and place of each.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = [min(shortest, len(x)) for x in self.items]
        for size in sorted(set(sizes) - {0}):
            h, of, at = [], [], []
            for k, x in enumerate(self.items):
                if sizes[k] == size:
                    own = windows(x, size)
                    h.append(own), of.append(np.full(len(own), k)), at.append(np.arange(len(own)))
            h, of, at = np.concatenate(h), np.concatenate(of), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], of[order], at[order]

    def find(self, texts: list[bytes], least: float) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, its words, words covered, tiles) of the items covered to ``least``."""
        get, coded = self.vocab.get, []
        for t in texts:
            words = words_of(t)
            coded.append(np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words)))
        ends = np.cumsum([len(x) for x in coded])
        flat = np.concatenate(coded) if coded else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(coded)), [len(x) for x in coded])
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        lengths = np.array([len(x) for x in self.items])
        for size, (hashes, of, at) in self.seeds.items():
            h = windows(flat, size)
            if not len(h):
                continue
            lo = np.searchsorted(hashes, h)
            hit = np.flatnonzero((hashes[np.minimum(lo, len(hashes) - 1)] == h) & (owner[: len(h)] == owner[size - 1 :]))
            lo = lo[hit]
            many = np.searchsorted(hashes, h[hit], side="right") - lo
            if not len(hit):
                continue
            # whole documents in lots of some LOT pairs, so that little more than what one text shares with all items is held at a time
            of_doc = owner[hit]
            lead = np.flatnonzero(np.diff(of_doc, prepend=-1))
            lot = (np.cumsum(np.add.reduceat(many, lead)) - 1) // LOT
            bounds = [*lead[np.flatnonzero(np.diff(lot, prepend=-1))].tolist(), len(hit)]
            for x, y in zip(bounds, bounds[1:]):
                n = many[x:y]
                row = np.repeat(lo[x:y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                doc = np.repeat(of_doc[x:y], n)
                pair = doc * len(self.items) + of[row]
                order = np.argsort(pair, kind="stable")
                cut = np.flatnonzero(np.diff(pair[order], prepend=-1))
                seeds = np.diff(np.append(cut, len(pair)))
                doc, k = np.divmod(pair[order][cut], len(self.items))
                # even apart, fewer seeds cannot cover enough
                able = np.flatnonzero(np.maximum(size + seeds - 1, size * seeds) >= least * lengths[k])
                start, place = np.repeat(hit[x:y], n), at[row]
                for j in able.tolist():
                    own, d = order[cut[j] : cut[j] + seeds[j]], int(doc[j])
                    begin = int(ends[d]) - len(coded[d])
                    tiles = tile(coded[d], self.items[k[j]], list(zip((start[own] - begin).tolist(), place[own].tolist())), size)
                    covered = sum(n for n, _, _ in tiles)
                    if covered >= least * lengths[k[j]]:
                        out[d].append((int(k[j]), int(lengths[k[j]]), covered, len(tiles)))
        return out


def blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, each collected when it is its turn."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in items.where(part == k).collect()]


def _finder(held, kind, schema: str, least: float):
    one = pa.struct([("item_id", to_arrow_type(kind)), ("item_words", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32()), ("coverage", pa.float64())])

    @F.arrow_udf(schema)
    def run(text: pa.Array) -> pa.Array:
        index = held.value
        found = index.find(as_bytes(text), least)
        rows = [[{"item_id": index.names[k], "item_words": n, "covered": c, "tiles": t, "coverage": c / n} for k, n, c, t in sorted(own)] for own in found]
        return pa.array(rows, pa.list_(one))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, shortest: int = SHORTEST, least: float = LEAST, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with _hits: an array of (item_id, item_words, covered, tiles, coverage)."""
    spark = docs.sparkSession
    text_batches(spark)
    kind = benchmark.schema[item_id].dataType
    schema = f"array<struct<item_id:{kind.simpleString()},item_words:int,covered:int,tiles:int,coverage:double>>"
    out, before, held = docs.withColumn("_hits", F.array().cast(schema)), None, None
    for block in blocks(benchmark, block_chars, item_id, item_text):
        if held is not None:
            out = stage(out, "hits")
            held.destroy()
            if before is not None:
                discard(before)
            before = out
        held = spark.sparkContext.broadcast(Index(block, shortest))  # some block_chars characters
        out = out.withColumn("_hits", F.concat("_hits", _finder(held, kind, schema, least)(text_col)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    return contamination(docs, benchmark, **options).where(F.size("_hits") == 0).select(*docs.columns)


def op8_tiling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.*")
