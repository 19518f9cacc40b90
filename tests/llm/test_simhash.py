import numpy as np
import xxhash

from weir.llm.simhash import BKTree, fingerprints_of, links, near_duplicates, op7_simhash, shard_links


def print_of(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for j in range(len(a)):
        for k in np.flatnonzero(np.bitwise_count(a[:j] ^ a[j]) <= 3):
            x, y = top(j), top(int(k))
            up[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(a))]


def test_fingerprints(docs):
    texts = [t.encode() for t in docs.text[:60]] + [b"", b"  ", b"One", b"one TWO", "É É".encode()]
    for width in (3, 5):
        assert fingerprints_of(texts, width).tolist() == [print_of(t.decode(), width) for t in texts]


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    members = list({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, int(rng.integers(0, 5)))) for b in base for _ in range(15)})
    tree = BKTree()
    for j, x in enumerate(members):
        assert sorted(tree.insert(x, 3)) == sorted(y for y in members[:j] if (x ^ y).bit_count() <= 3)
    assert len(shard_links(members, 3)) == len(members) - len(set(components(members)))


def test_large_shards_are_parted_and_linked_alike():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    members = sorted({int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 6))).tolist())) for b in base for _ in range(10)})
    for split_at in (1, 5, 50, 4096):
        found = shard_links(members, 3, split_at)
        assert all((a ^ b).bit_count() <= 3 for a, b in found)
        assert len(found) == len(members) - len(set(components(members)))


def test_links_connect_alike_when_shards_are_split(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    members = sorted({int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 6))).tolist())) for b in base for _ in range(40)})
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in members], "fp long")
    want = len(set(components(members)))
    for split_at in (3, 4096):
        up = {x: x for x in members}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in links(df, split_at=split_at).collect():
            a, b = (x % 2**64 for x in r)
            assert (a ^ b).bit_count() <= 3
            up[top(a)] = top(b)
        assert len({top(x) for x in members}) == want


def check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [print_of(t) for _, t in rows]
    ids = [i for i, _ in rows]
    least = {}
    tops = components(prints)
    for i, t in zip(ids, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted(str((i, f"{p:016x}", least.get(t))) for i, p, t in zip(ids, prints, tops))
    num = lambda x: None if x is None or x != x else int(x)
    assert sorted(str((num(r.doc_id), r.fingerprint, num(r.component_id))) for r in got.itertuples()) == want


def test_query(spark, sf, docs):
    check(op7_simhash(spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))


def test_awkward(awkward, nothing, on_table):
    check(on_table(op7_simhash, awkward), [(r.doc_id, r.text) for r in awkward.collect()])
    assert near_duplicates(nothing).count() == 0
