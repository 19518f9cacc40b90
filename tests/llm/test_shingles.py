import pandas as pd

import corpus_pipeline
from weir.llm.shingles import COMPONENT, near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=corpus_pipeline.SHINGLE):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, least=0.8):
    """For each text the least index of what chains of pairs of Jaccard similarity ``least`` connect it with; and the pairs."""
    sets, up, pairs = [shingles(t) for t in texts], list(range(len(texts))), []

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j])):
                pairs.append((j, i))
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))], pairs


def test_links_are_those_of_brute_force(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    up, pairs = brute(docs.text)
    assert sum(shingles(docs.text[i]) != shingles(docs.text[j]) for i, j in pairs) >= 10
    for split_at in (4096, 1):  # every shard is dealt again
        got = near_copies(spark.createDataFrame(docs[["doc_id", "text"]]), split_at=split_at).toPandas().sort_values("doc_id")
        group = got[COMPONENT].tolist()
        assert [group.index(g) for g in group] == up


def test_stage_drops_near_copies(spark):
    base = [f"word{i}" for i in range(200)]
    near = [w if i not in (20, 90, 150) else "other" for i, w in enumerate(base)]  # 181 of 211 shingles
    far = [w if i % 20 else "other" for i, w in enumerate(base)]
    rows = [(k, " ".join(words), "en", "a", 1) for k, words in enumerate((base, near, far))]
    got = corpus_pipeline.near_duplicate_groups(spark, spark.createDataFrame(rows, COLUMNS), "").toPandas()
    assert sorted(got.doc_id) == [0, 2]


def test_distinct_texts_stay_whatever_their_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, text[0], "en", "a", 1), (None, text[1], "en", "a", 1), (None, text[0], "en", "b", 1), (7, text[2], "en", "a", 1), (7, text[3], "en", "a", 1), (5, text[3], "en", "a", 1)]
    got = corpus_pipeline.near_duplicate_groups(spark, spark.createDataFrame(rows, COLUMNS), "").toPandas()
    assert sorted(got.text) == text and got[got.text == text[3]].doc_id.tolist() == [5]
