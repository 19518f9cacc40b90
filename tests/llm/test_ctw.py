import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weir.llm import ctw
from weir.llm.ctw import grams, op10_ctw, pieces, score, tally


def naive(train, depth):
    """P(one) at a node by the recursion of context-tree weighting over dictionaries."""
    nodes = {}
    for t in train:
        p = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(p)):
            for k in range(8):
                for d in range(depth + 1):
                    n = nodes.setdefault((p[i - d : i], p[i] >> (8 - k), k), [0, 0])
                    n[p[i] >> (7 - k) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weight = {}
    for key in sorted(nodes, key=lambda x: -len(x[0])):
        ctx, pre, k = key
        own = kt(*nodes[key])
        if len(ctx) < depth:
            below = sum(weight[c][0] for b in range(256) if (c := (bytes([b]) + ctx, pre, k)) in nodes)
            w = np.logaddexp(own, below) - math.log(2)
            weight[key] = (w, math.exp(own - math.log(2) - w))
        else:
            weight[key] = (own, 1.0)

    def one(ctx, pre, k):
        p, rest = 0.0, 1.0
        for d in range(depth + 1):
            key = (ctx[depth - d :], pre, k)
            if key not in nodes:
                return p + rest / 2
            z, o = nodes[key]
            p += rest * weight[key][1] * (o + 0.5) / (z + o + 1)
            rest *= 1 - weight[key][1]
        return p + rest / 2

    def log10(t):
        p, total = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(p)):
            for k in range(8):
                q = one(p[i - depth : i], p[i] >> (8 - k), k)
                total += math.log10(q if p[i] >> (7 - k) & 1 else 1 - q)
        return total

    return log10


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


TRAIN = ["abracadabra", "", "the cat sat on the mat", "é" * 5, "a\0b\0b", "abracadabra"]
OTHERS = ["", "abra", "zzz", "the mat", "\0", "a\0b", "ca" * 40]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
@pytest.mark.parametrize("frequent", [0, 7, 10_000])
def test_scores_against_naive(spark, depth, frequent):
    want = naive([t.encode() for t in TRAIN], depth)
    docs = table(spark, TRAIN + OTHERS)
    got = score(docs, F.col("doc_id") < len(TRAIN), depth=depth, frequent_grams=frequent).toPandas().sort_values("id")
    assert np.allclose(got.score, [want(t.encode()) for t in TRAIN + OTHERS], atol=1e-9)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    texts = TRAIN + OTHERS + ["the cat " * 50]
    docs, train = table(spark, texts), F.col("doc_id") < len(TRAIN)
    a = score(docs, train).toPandas().sort_values("id")
    for t in texts:
        whole = np.concatenate([grams(lot, 5)[0] for _, lot in pieces([t.encode()], 5)])
        cut = np.concatenate([grams(lot, 5)[0] for _, lot in pieces([t.encode()], 5, 7)])
        assert (whole == cut).all() and len(whole) == len(t.encode()) + 1
    whole, small = pieces, lambda texts, depth: whole(texts, depth, 7)
    monkeypatch.setattr(ctw, "pieces", small)
    rows = list(small([t.encode() for t in texts], 5))
    assert len(rows) > len(texts)
    b = score(docs, train, frequent_grams=20).toPandas().sort_values("id")
    assert a.drop(columns="score").equals(b.drop(columns="score").reset_index(drop=True).set_index(a.index)) and np.allclose(a.score, b.score)


def test_groups_of_grams_stay_whole():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 20, 5000)) << 20 | 7
    keys = keys[np.argsort(keys >> 8 & 0xFFFFFF, kind="stable")]
    n = np.arange(len(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 100]) for x in (keys, n, n)], names=["gram", "n", "m"]) for i in range(0, len(keys), 100)]
    got = list(ctw._in_pieces(batches, 5, 300))
    assert len(got) > 5 and sorted(x for k, _, _ in got for x in k) == sorted(keys)
    groups = [set((k >> 8 & 0xFFFFFF).tolist()) for k, _, _ in got]
    assert sum(map(len, groups)) == len(set().union(*groups))
    assert all((keys[c] == k).all() for k, c, _ in got)


def test_next_byte_probabilities_add_up():
    train = [b"abracadabra", b"the cat sat on the mat"]
    held = [tally(grams(lot, 3)[0]) for _, lot in pieces(train, 3)]
    keys, n = (x[np.argsort(held[0][0])] for x in held[0])
    upper = ctw.Upper(3, ctw.top_sums(keys, n.astype(float), 3))
    for ctx in (b"bra", b"xyz", b"\xff\xff\xff"):
        g = (int.from_bytes(ctx, "big") << 8) + np.arange(256)
        all_keys = np.union1d(keys, g)
        counts = np.zeros(len(all_keys), np.int64)
        counts[np.searchsorted(all_keys, keys)] = n
        logs = ctw.gram_scores(upper, all_keys, counts)[np.searchsorted(all_keys, g)]
        assert abs((10**logs).sum() - 1) < 1e-9


def brute(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i if i is not None else -1, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def check(got, rows):
    have = sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    for a, b in zip(have, brute(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5
    assert (got.score <= 0).all()


def test_query(spark, sf, docs):
    check(op10_ctw(spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))


def test_few_frequent_words_change_nothing(spark, awkward):
    from weir.llm.common import fold

    a = score(awkward, ~fold(awkward, 7, 2), frequent_words=3, frequent_grams=9).toPandas().sort_values(["id", "n_tokens"])
    b = score(awkward, ~fold(awkward, 7, 2)).toPandas().sort_values(["id", "n_tokens"])
    assert np.allclose(a.base_score, b.base_score) and np.allclose(a.score, b.score) and list(a.n_known) == list(b.n_known)


def test_awkward(awkward, on_table):
    check(on_table(op10_ctw, awkward), [(r.doc_id, r.text) for r in awkward.collect()])


def test_empty(nothing, on_table):
    assert len(on_table(op10_ctw, nothing)) == 0
