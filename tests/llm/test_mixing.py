import re

import numpy as np
import pytest

from weir.llm.mixing import assign, mix, op1_mixture, split, targets



def test_targets_stop_at_the_cap():
    assert targets([100, 100, 100], (5, 2, 1), 1.5, 2.0) == pytest.approx([200.0, 500 / 3, 250 / 3])
    assert targets([10, 0, 1000], (5, 2, 1), 1.5, 2.0) == pytest.approx([20.0, 0.0, 1495.0])
    for sizes in ([1, 2, 3, 4], [7], [0, 0], [5, 10**6, 3]):
        t = targets(sizes, (5, 2, 1), 1.5, 2.0)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * n + 1e-9 for x, n in zip(t, sizes))


def test_tree_keeps_quotas():
    q = np.array([100, 7, 0, 33])
    parts = split(q, 9, np.random.default_rng(1))
    got = np.zeros((9, 4), int)
    for row, (sources, n) in zip(got, parts, strict=True):
        row[sources] = n
    assert got.shape == (9, 4) and (got.sum(0) == q).all() and got.sum(1).max() - got.sum(1).min() <= 4


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(got, rows):
    size = {}
    for i, s, t in rows:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, targets([size[s] for s in order], (5, 2, 1), 1.5, 2.0)))
    most = {s: max(words(t) for _, q, t in rows if q == s) for s in size}
    taken = dict.fromkeys(size, 0)
    of = {}
    for i, s, t in rows:
        of.setdefault((i, words(t)), []).append(s)
    assert len(got) == len(rows)
    for r in got.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        s = of[i, r.size].pop()
        assert r.source_size == size[s] and r.target == pytest.approx(goal[s]) and r.taken <= 2 * r.size and len(r.shards) * r.size == r.taken
        taken[s] += r.taken
    for s in size:
        # nearest cut in the permutation: off by no more than a document, twice where rows share an id
        assert abs(taken[s] - goal[s]) <= 2 * most[s], s


def test_query(spark, sf, docs):
    a, b = op1_mixture(spark, sf).toPandas(), op1_mixture(spark, sf).toPandas()
    check(a, list(zip(docs.doc_id, docs.source, docs.text)))
    key = lambda p: sorted((r.doc_id, r.taken, tuple(r.shards)) for r in p.itertuples())
    assert key(a) == key(b)


def test_awkward(awkward, on_table):
    check(on_table(op1_mixture, awkward), [(r.doc_id, r.source, r.text) for r in awkward.collect()])


def test_shards_and_blocks_follow_the_words(spark, monkeypatch):
    from weir.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    rows = [(i, f"s{i % 3}", "word " * 10) for i in range(900)] + [(1000 + i, f"t{i}", "word " * 10) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = assign(docs).toPandas()
    check(got.rename(columns={"_mix_size": "size", "_mix_source_size": "source_size", "_mix_target": "target"}).assign(taken=got["_mix_places"].map(len) * got["_mix_size"], shards=got["_mix_places"]), rows)
    used = {p.shard for ps in got["_mix_places"] for p in ps}
    assert max(used) < 94 and len(used) > 80
    assert all(len({p.copy for p in ps}) == len(ps) for ps in got["_mix_places"])


def test_own_names_are_replaced(awkward):
    from pyspark.sql import functions as F

    docs = awkward.withColumns({"_mix_size": F.lit("x"), "_mix_key": F.lit("y")})
    assert assign(docs).count() == awkward.count() and "_mix_key" not in mix(docs).columns


def test_mixture_rows(awkward, nothing):
    placed = assign(awkward).toPandas()
    rows = mix(awkward).toPandas()
    assert len(rows) == placed["_mix_places"].map(len).sum()
    assert list(mix(awkward).columns)[: len(awkward.columns)] == awkward.columns
    assert mix(nothing).count() == 0 and assign(nothing).count() == 0
