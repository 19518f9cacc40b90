import pytest

from weir.llm.compaction import Conflict, ShardStore, op9_compaction, shard


def test_query(spark, sf, docs):
    got = op9_compaction(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert got.version.nunique() == 1


def rows(df):
    return sorted(map(str, df.collect()))


def test_nothing_is_lost(awkward, nothing, tmp_path):
    store = shard(awkward, f"file://{tmp_path}/a", arrivals=5, fan_in=2)
    assert rows(store.read()) == rows(awkward)
    assert not store.plan(store.manifest()["runs"])
    empty = shard(nothing, f"file://{tmp_path}/b")
    assert empty.read().count() == 0 and empty.shards("doc_id").columns == ["doc_id", "shard", "version"]


def test_tiers_and_targets(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text", "sha2(cast(id as string), 256) as noise")
    store = ShardStore(spark, f"file://{tmp_path}/s", df.schema, target_bytes=300_000, fan_in=4)
    for k in range(6):
        store.append(df.where(f"doc_id % 6 = {k}").repartition(5))
    before = store.manifest()
    assert before["version"] == 6 and len(before["runs"]) == 6
    after = store.compact()
    files = [b for r in after["runs"] for _, b in r["files"]]
    assert after["version"] > 6 and len(files) < 30 and all(b < 900_000 for b in files)
    assert rows(store.read()) == rows(df)
    # an old version is whole until it is vacuumed
    assert store.read(3).count() == df.where("doc_id % 6 < 3").count()
    store.vacuum()
    assert store.read().count() == 40_000


def test_two_writers(awkward, spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/c", awkward.schema)
    base = store.append(awkward)
    store.commit(base, base["runs"])
    with pytest.raises(Conflict):
        store.commit(base, [])
    assert store.manifest()["version"] == base["version"] + 1 and store.read().count() == awkward.count()


def test_large_runs_of_small_files_are_rewritten(spark, tmp_path):
    df = spark.range(12_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as noise")
    for n in (1, 5):  # fewer runs than a tier takes, and more
        store = ShardStore(spark, f"file://{tmp_path}/{n}", df.schema, target_bytes=40_000, fan_in=4)
        for k in range(n):
            store.append(df.where(f"doc_id % {n} = {k}").repartition(40))
        before = store.manifest()["runs"]
        assert len(before) == n and all(r["bytes"] > 160_000 and max(b for _, b in r["files"]) < 40_000 for r in before)
        after = store.compact()["runs"]
        files = [b for r in after for _, b in r["files"]]
        assert all(20_000 <= b <= 80_000 for b in files) and not store.plan(after)
        assert rows(store.read()) == rows(df)


def test_a_loser_starts_anew_and_the_dead_block_nobody(spark, tmp_path):
    df = spark.range(30).selectExpr("id as doc_id", "id as _weir_arrival", "id as _weir_deal")
    store = ShardStore(spark, f"file://{tmp_path}/s", df.schema)
    store.append(df.where("doc_id < 10"))
    # a writer that died after writing its run and its manifest's text
    (tmp_path / "s" / "runs" / "dead").mkdir()
    (tmp_path / "s" / "runs" / "dead" / "x.parquet").write_bytes(b"x")
    (tmp_path / "s" / "manifests" / "_dead.tmp").write_text('{"version": 2, "ru')
    late, commit, met = ShardStore(spark, f"file://{tmp_path}/s", df.schema), ShardStore.commit, []

    def overtaken(base, runs):
        if not met:
            met.append(store.append(df.where("doc_id between 10 and 19")))
        return commit(late, base, runs)

    late.commit = overtaken
    late.append(df.where("doc_id >= 20"), df.doc_id % 3)
    assert met and rows(store.read()) == rows(df)
    store.compact()
    store.vacuum()
    assert store.versions() == [store.manifest()["version"]] and rows(store.read()) == rows(df)
    kept = {r["folder"].split("/")[1] for r in store.manifest()["runs"]}
    assert {p.name for p in (tmp_path / "s" / "runs").iterdir()} == kept
    assert not list((tmp_path / "s" / "manifests").glob("*.tmp"))


def test_a_merge_that_was_overtaken_is_dropped(spark, tmp_path):
    df = spark.range(400).selectExpr("id as doc_id")
    stores = [ShardStore(spark, f"file://{tmp_path}/s", df.schema, fan_in=2) for _ in range(2)]
    for k in range(4):
        stores[0].append(df.where(f"doc_id % 4 = {k}"))
    run, met = stores[0]._run, []

    def other(folder):
        if not met:
            met.append(stores[1].compact())
        return run(folder)

    stores[0]._run = other
    stores[0].compact()
    assert met and rows(stores[1].read()) == rows(df)
