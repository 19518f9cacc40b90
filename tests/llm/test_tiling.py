import random

import numpy as np
import pandas as pd

from weir.llm.licences import words_of
from weir.llm.tiling import Index, contamination, op8_tiling, tile


def brute(doc, item, shortest):
    """Greedy string tiling by trying all starts, longest first; ties by place."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < shortest:
            return covered
        free_d[d : d + n] = free_i[i : i + n] = [False] * n
        covered += n


def test_tiles_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        doc, item = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(2)]
        size = 3
        seeds = [(d, i) for d in range(len(doc) - size + 1) for i in range(len(item) - size + 1) if doc[d : d + size] == item[i : i + size]]
        tiles = tile(np.array(doc), np.array(item), seeds, size)
        assert sum(n for n, _, _ in tiles) == brute(doc, item, size)
        used_d, used_i = [x for n, d, _ in tiles for x in range(d, d + n)], [x for n, _, i in tiles for x in range(i, i + n)]
        assert len(set(used_d)) == len(used_d) and len(set(used_i)) == len(used_i)
        assert all(doc[d : d + n] == item[i : i + n] for n, d, i in tiles)


def test_query_against_brute_force(spark, sf, docs):
    bench = pd.read_parquet(f"{sf}/benchmark.parquet")
    got = op8_tiling(spark, sf).toPandas()
    want = {}
    items = {i: words_of(t.encode()) for i, t in zip(bench.item_id, bench.text)}
    for doc, text in zip(docs.doc_id, docs.text):
        words = words_of(text.encode())
        grams = {tuple(words[j : j + 5]) for j in range(len(words))}
        for i, item in items.items():
            if any(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)) and len(words) * len(item) < 60_000:
                c = brute(words, item, 5)
                if c >= 0.6 * len(item):
                    want[doc, i] = c
    short = {d for d, t in zip(docs.doc_id, docs.text) if len(words_of(t.encode())) < 600}
    assert {(r.doc_id, r.item_id): r.covered for r in got.itertuples() if r.doc_id in short} == {k: v for k, v in want.items() if k[0] in short}
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, s in zip(bench.item_id, bench.text) if s in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in got.itertuples()}


def test_reordered_and_clean():
    rng = random.Random(5)
    item = [f"w{rng.randrange(400)}" for _ in range(40)]
    moved = " ".join([*item[20:], "between", *item[:20]]).upper()
    clean = " ".join(f"w{rng.randrange(400)}" for _ in range(3000))
    got = Index([(9, " ".join(item))]).find([moved.encode(), clean.encode(), b""], 0.6)
    assert [(k, c) for k, _, c, _ in got[0]] == [(0, 40)] and not got[1] and not got[2]


def test_blocks_and_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat another line"), (2, None), (3, ""), (None, "cc by nc"), (4, "word word word word word word")], "item_id long, text string")
    a, b = (contamination(awkward, bench, block_chars=n).select("doc_id", "_hits.item_id").toPandas() for n in (10, 10**6))
    key = lambda p: sorted((str(d), sorted(map(str, h))) for d, h in zip(p.doc_id, p.item_id))
    assert key(a) == key(b)
    hits = {None if d != d else int(d): list(h) for d, h in zip(b.doc_id, b.item_id)}
    assert hits[3] == [1] and hits[8] == [4] and hits[None] == [None] and hits[1] == []
    assert contamination(nothing, bench).count() == 0
    assert contamination(awkward, bench.limit(0)).where("size(_hits) > 0").count() == 0
