import pytest
from pyspark.sql import functions as F
from threadloom.llm.sharding import ManifestConflict, ShardStore, Tiers, shard_documents

SCHEMA = "doc_id bigint, text string, shard string"


def test_round_trip_and_tiers(spark, tmp_path):
    data = [(i, f"text {i} " * (i % 50), None) for i in range(2000)] + [(None, None, "clash")] * 2 + [(1, "x" * 200_000, "")]
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    tiers = Tiers(target_bytes=1 << 20)
    store = shard_documents(docs, ShardStore(spark, f"file://{tmp_path}/s"), tiers)
    back = store.read()
    assert back.columns == ["doc_id", "text", "shard", "_shard"]
    back = back.drop("_shard")
    assert back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    _, shards, _ = store.manifest()
    counts = {}
    for s in shards:
        counts[tiers.tier(s.bytes)] = counts.get(tiers.tier(s.bytes), 0) + 1
    assert all(n < tiers.runs for t, n in counts.items() if t) and sum(s.rows for s in shards) == len(data)


def test_versions_and_conflicts(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.range(10).select(F.col("id").alias("doc_id"))
    assert store.append(df) == 1 and store.append(df) == 2
    assert store.read(1).count() == 10 and store.read().count() == 20
    version, shards, schema = store.manifest(1)
    with pytest.raises(ManifestConflict):
        store.commit(version, shards, schema)
    assert store.read().count() == 20


def test_arrivals_of_other_columns(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    store.append(spark.createDataFrame([("b", 0.5)], "text string, score double"))
    store.append(spark.createDataFrame([(3,)], "doc_id bigint"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    want = {(1, "a", None), (None, "b", 0.5), (3, None, None)}
    assert {tuple(r) for r in store.read().drop("shard").collect()} == want
    store.compact(Tiers(runs=2))
    assert len(store.manifest()[1]) == 1 and {tuple(r) for r in store.read().drop("shard").collect()} == want


def test_empty(spark, tmp_path):
    store = shard_documents(spark.createDataFrame([], "doc_id bigint, text string"), ShardStore(spark, f"file://{tmp_path}/s"))
    assert store.read().count() == 0
