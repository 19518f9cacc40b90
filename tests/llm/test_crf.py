from itertools import product

import numpy as np
import pandas as pd
import zlib

from weir.llm import crf
from weir.llm.crf import Model, forward_backward, op2_crf


def brute(e, step, start):
    """Word posteriors by adding up all labellings."""
    n, k = e.shape
    post, total = np.zeros((n, k)), 0.0
    for path in product(range(k), repeat=n):
        p = start[path[0]] * np.prod([e[t, path[t]] for t in range(n)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
        total += p
        for t, y in enumerate(path):
            post[t, y] += p
    return post / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    e, step, start = rng.random((2, 5, 3)), rng.random((3, 3)), rng.random(3)
    post, pairs, _ = forward_backward(e, step, start)
    for s in range(2):
        assert np.allclose(post[s], brute(e[s], step, start))
    assert np.isclose(pairs.sum(), 2 * 4)


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    m = Model(["a", "b", "c"], np.zeros((1, 3)), rng.random((3, 3)), rng.random(3))
    lengths = np.array([7, 1, 4, 3])
    e = rng.random((lengths.sum(), 3))
    want = [brute(x, m.step, m.start).sum(0) for x in np.split(e, np.cumsum(lengths)[:-1])]
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(crf, "BLOCK", block)
        assert np.allclose(m._chains(e, lengths), want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_crf(spark, sf).toPandas()
    d = pd.read_parquet(f"{sf}/documents.parquet")
    x = got.merge(d, on="doc_id")
    assert len(got) == len(d)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    test = x[x.held_out & (x.n_chars > 40)]
    assert (test.lang == test.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_code_switching():
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    m = crf.train([(t, y) for t, y in zip(d.text[:300], d.lang[:300])], rounds=30)
    a, b = (d[(d.lang == y) & (d.n_chars.between(500, 900))].text.iloc[-1] for y in ("de", "es"))
    words = crf.words_of(a) + crf.words_of(b)
    e = crf._soft(crf.emissions(m.weights, *crf.features(np.array(words, dtype=object)), len(words))).astype(float)
    post, _, _ = forward_backward(e[None], m.step, m.start)
    gold = [m.labels.index("de")] * len(crf.words_of(a)) + [m.labels.index("es")] * len(crf.words_of(b))
    assert (post[0].argmax(1) == gold).mean() > 0.95


def test_awkward(awkward, on_table):
    got = on_table(op2_crf, awkward)
    assert len(got) == awkward.count()
    by = {None if i != i else int(i): (p, s) for i, p, s in zip(got.doc_id, got.lang_pred, got.score)}
    assert by[1] == by[2] == by[4] == by[9] == ("und", 0.0)
    assert by[3][0] in {"en", "de", "fr", "xx"}


def test_empty(nothing, on_table):
    assert len(on_table(op2_crf, nothing)) == 0


def test_short_texts_teach(spark, on_table):
    """Titles of a few words, one language with no text longer than that."""
    rows = [(i, f"the {w} house", "en") for i, w in enumerate("red big old new far tall wide".split() * 6)]
    rows += [(100 + i, "δ" * (1 + i % 4) + "λ", "el") for i in range(30)]
    got = on_table(op2_crf, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {i: y for i, _, y in rows}
    assert (got.lang_pred == got.doc_id.map(want)).mean() > 0.95


def test_ties_and_own_names(spark):
    m = Model(["a", "b"], np.zeros((3 * crf.BUCKETS, 2), np.float32), np.ones((2, 2)), np.ones(2))
    docs = spark.createDataFrame([(1, "word", "x")], "doc_id long, text string, _lang string")
    (row,) = crf.identify(docs, m).collect()
    assert row["_lang"]["lang_pred"] == "a" and row["_lang"]["score"] == 0.5


def test_labels_are_those_of_all_labellings():
    """Predictions of whole texts against adding up all labellings."""
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    m = crf.train([(t, y) for t, y in zip(d.text[:100], d.lang[:100])], rounds=10)
    texts = [" ".join(t.split()[i : i + 6]) for i, t in enumerate(d.text[100:120])]
    langs, score = m.predict(texts)
    for text, lang, s in zip(texts, langs, score):
        words = crf.words_of(text)
        if not words:
            assert lang == "und" and s == 0
            continue
        e = crf._soft(crf.emissions(m.weights, *crf.features(np.array(words, dtype=object)), len(words))).astype(float)
        sums = brute(e, m.step, m.start).sum(0)
        assert lang == m.labels[int(sums.argmax())] and np.isclose(s, sums.max() / len(words), atol=1e-6)
