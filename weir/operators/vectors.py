"""Exact nearest neighbours of vectors, by blocks of matrices."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A block has so many numbers at most, and so many distances are held at a time.
_BLOCK, _HELD = 1 << 18, 1 << 21
_FOUND = pa.schema([("q", pa.int64()), ("i", pa.int64()), *((c, pa.float64()) for c in ("d", "dot", "ee", "qq"))])


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """To each of ``queries`` the ``k`` of ``rows`` at the least Euclidean distance, then of the least key: (q, key, d, dot, ee, qq).

    Each block of rows meets each block of queries, so all pairs are compared, and a task holds two blocks; of these k rows a
    query go on. Distances are sums term after term; matrix products only tell which rows come into question. As in the
    dialect a distance is null, and first, where a vector is null, has nulls, or is of another length.
    """
    of = lambda df: df.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_blocks, "block binary")
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    cells = of(rows.repartition(parts)).crossJoin(of(queries.repartition(1)).withColumnRenamed("block", "other"))
    found = cells.mapInArrow(lambda batches: _cells(batches, k), "q long, i long, d double, dot double, ee double, qq double")
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "i"))
    return found.withColumn("_r", best).where(F.col("_r") <= k).select("q", F.col("i").alias(key), "d", "dot", "ee", "qq")


def _blocks(batches):
    """Rows as pickled {length: (keys, matrix)}; vectors without a length, or with nulls, are at -1."""
    held, size = {}, 0

    def done():
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps({n: (np.array([i for i, _ in r], np.int64), np.array([v for _, v in r], float).reshape(len(r), max(n, 0))) for n, r in held.items()})], pa.binary())})

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else None
            n = -1 if v is None else len(v)
            held.setdefault(n, []).append((i, [] if v is None else v))
            size += 1 + max(n, 0)
            if size >= _BLOCK:
                yield done()
                held, size = {}, 0
    if held:
        yield done()


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, term after term, as an aggregate adds them."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[0])
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _cells(batches, k: int):
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            a, b = pickle.loads(a.as_py()), pickle.loads(b.as_py())
            for n, (keys, own) in b.items():
                apart = np.sort(np.concatenate([np.empty(0, np.int64), *(i for m, (i, _) in a.items() if m != n or n < 0)]))[:k]
                step = max(1, _HELD // max(len(a[n][0]) if n >= 0 and n in a else 1, 1))
                for at in range(0, len(keys), step):
                    yield from _best(keys[at : at + step], own[at : at + step], *(a[n] if n >= 0 and n in a else (apart[:0], own[:0])), apart, k)


def _best(keys, own, ids, rows, apart, k):
    """The k best of a block to each of some queries, ``apart`` being those at no distance."""
    scale = (rows * rows).sum(1)
    square = (own * own).sum(1)
    with np.errstate(all="ignore"):
        gaps = square[:, None] + scale[None, :] - 2 * (own @ rows.T)
    out = [[], [], [], [], [], []]
    for r in range(len(keys)):
        if len(ids) > k:
            limit = np.partition(gaps[r], k - 1)[k - 1]
            slack = 1e-10 * (square[r] + scale.max())
            # what is no number comes into question too
            pick = np.flatnonzero(~(gaps[r] > limit + slack))
        else:
            pick = np.arange(len(ids))
        near = rows[pick]
        with np.errstate(all="ignore"):
            d = np.sqrt(_sums(near - own[r], near - own[r]))
        best = np.lexsort((ids[pick], d))[:k]
        one, near = own[r : r + 1], near[best]
        for column, found in zip(out, (np.full(len(best), keys[r]), ids[pick][best], d[best], _sums(near, one), _sums(near, near), np.repeat(_sums(one, one), len(best)))):
            column.extend(found.tolist())
        for i in apart.tolist():
            for column, x in zip(out, (int(keys[r]), i, None, None, None, None)):
                column.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)
