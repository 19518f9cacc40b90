from collections import Counter

import pandas as pd

import corpus_pipeline
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_shingles import brute as similar


def test_stages_in_order(spark, sf, docs):
    stages = corpus_pipeline.STAGES
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now, steps = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in stages:
        now = f(spark, now, sf)
        if name != stages[-1][0]:
            assert now.columns == columns
        now = now.cache()
        steps.append(now.toPandas())
    kept, single, clean, mixed, written = steps
    text = dict(zip(docs.doc_id, docs.text))
    assert all(not quality_brute(t)[-1] for t in kept.text)
    # near duplicates: of what chains of pairs of similarity 0.8 or more connect, the smallest id stays
    ids = sorted(kept.doc_id)
    tops, _ = similar([text[i] for i in ids])
    assert sorted(single.doc_id) == [i for k, i in enumerate(ids) if tops[k] == k]
    bench = pd.read_parquet(f"{sf}/benchmark.parquet")
    leaked = {i for i in single.doc_id if any(t in text[i] for t in bench.text)}
    assert set(clean.doc_id) <= set(single.doc_id) - leaked and len(single) - len(clean) < len(leaked) + 5
    times = Counter(mixed.doc_id)
    assert set(times) <= set(clean.doc_id) and max(times.values()) <= 2
    assert Counter(written.doc_id) == times


def test_awkward(spark, awkward, nothing, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    for name, table in (("a", awkward), ("b", nothing)):
        d = f"{tmp_path}/{name}"
        table.select(*columns).write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        assert corpus_pipeline.run(spark, d).count() >= 0
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, table.select(*columns), d).count() >= 0


def test_one_of_each_group_stays(spark, awkward):
    rows = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.near_duplicate_groups(spark, rows, "").toPandas()
    assert got.doc_id.isna().sum() + got.doc_id.nunique() == len(got)
