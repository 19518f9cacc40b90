import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.llm.rindex import RunIndex, op3_rindex, pieces, remove, repeats


def brute(rows, width=100):
    """Rows (id, text) in order; what a first-seen set of all windows removes."""
    seen, out = set(), []
    for doc, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((doc, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def rows_of(got, name="doc_id"):
    return sorted((None if i != i else int(i), int(b), int(r), int(s), h) for i, b, r, s, h in got[[name, "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8))
def test_statistics_and_count(strings):
    index = RunIndex(strings)
    flat = [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]
    suffixes = sorted(flat, key=lambda x: (strings[x[0]][x[1] :] + b"", x[0]))
    want = {}
    for a, b in zip([None, *suffixes], suffixes):
        x, y = (strings[a[0]][a[1] :] if a else b""), strings[b[0]][b[1] :]
        want[b] = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    assert [max(x, 0) for x in index.statistics().tolist()] == [want[f] for f in flat]
    for p in (b"\0", b"\0\1", strings[0][:3], b"\2\2\2"):
        assert index.count(p) == sum(s[i : i + len(p)] == p for s in strings for i in range(len(s) - len(p) + 1))


def test_equal_windows_pick_alike():
    rng = random.Random(3)
    common = bytes(rng.randrange(97, 101) for _ in range(180))
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) + common + bytes(rng.randrange(97, 123) for _ in range(50)) for n in (7, 130, 64)]
    seen = []
    for t in texts:
        anchor, _, start, n = pieces(np.frombuffer(t, np.uint8), np.array([len(t)]))
        own = {}
        for a, s, k in zip(anchor.tolist(), start.tolist(), n.tolist()):
            own.update({t[x : x + 100]: a for x in range(s, s + k)})
        assert len(own) == len(t) - 99
        seen.append(own)
    shared = set(seen[0]) & set(seen[1]) & set(seen[2])
    assert len(shared) == 81 and all(seen[0][w] == seen[1][w] == seen[2][w] for w in shared)


def test_slices_change_no_windows(monkeypatch):
    from weir.llm import rindex

    monkeypatch.setattr(rindex, "SLICE", 250)
    runs = list(rindex.slices([50, 1000, 300, 99, 100]))
    windows = [(i, s) for run in runs for i, a, z in run for s in range(a, z - 99)]
    assert windows == [(i, s) for i, n in enumerate([50, 1000, 300, 99, 100]) for s in range(n - 99)]


def test_repeats_in_strings():
    a = bytes(range(65, 91)) * 2
    place = (np.array([2, 1, 1]), np.zeros(3, np.int64), np.array([0, 0, 500]))
    string, offset = repeats([a[:30], a[5:20], a[:12]], place, 10)
    assert sorted(zip(string.tolist(), offset.tolist())) == sorted([*((0, i) for i in range(5, 11)), *((0, i) for i in range(0, 3))])


def test_query(spark, sf, docs):
    assert rows_of(op3_rindex(spark, sf).toPandas()) == sorted(brute(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("hot", [0, 20_000])
def test_planted(spark, hot):
    """Near copies, passages, periods, a common line in many contexts; hot anchors go window by window."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, base = prose(16), prose(200)
    rows = [(i, prose(rng.randrange(5, 60)) + line + prose(rng.randrange(5, 60))) for i in range(25)]
    rows += [(25 + i, base[: rng.randrange(300)] + word() + base[rng.randrange(300, 900) :]) for i in range(12)]
    rows += [(40, "ab" * 400), (41, "x" + "ba" * 90), (42, "z" * 99), (43, "z" * 101), (44, None), (45, ""), (46, base), (47, base), (48, prose(2000)), (49, rows[3][1][10:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove(df, hot_at=hot).toPandas()
    assert rows_of(got, "id") == sorted(brute(rows))
    assert all(hashlib.sha256(bytes(k)).hexdigest() == h for k, h in zip(got.kept, got.kept_sha256))


def test_awkward(awkward, on_table):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = on_table(op3_rindex, awkward)
    assert len(got) == len(rows)
    once = list({(i, t): None for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))})
    want = {(x[0], x[1]): x for x in brute(once)}
    for r in got.itertuples(index=False):
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert (i, *r[1:]) == want[(i, r.n_bytes)]


def test_empty(nothing, on_table):
    assert len(on_table(op3_rindex, nothing)) == 0
