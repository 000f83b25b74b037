"""Every stage, and all of them, over rows of every odd kind and columns of every clashing name."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from threadloom.llm import common, quality

NAMES = ("size", "target", "taken", "cover", "source_size", "kept", "n_words", "host_failed", "score", "shard", "_windows", "_hashes", "_lines", "_bad", "_host", "row", "doc", "host", "hub", "component_id", "lang_pred", "p", "copy", "held", "n", "twice", "gone", "part", "key", "ids", "text_b")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES) + ", `dotted.name` string"


def story(k, n=60):
    return " ".join(f"the cat{(k * 7 + i * i) % 997} sat on word{k}x{i}" for i in range(n // 5))


def rows():
    out = [(k, story(k), "en", ("a", "b", None)[k % 3]) for k in range(40)]
    out += [(100, story(100), "en", "a")] * 2 + [(101, story(101), "en", "a"), (102, story(101), "en", "b")]
    out += [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t", "en", "a"), (203, "1 2 3 " * 9, "en", "a"), (None, story(300), "en", "a"), (None, None, None, None)]
    out += [(400, story(400, 30_000), "en", "b"), (401, "x" * 100_000, None, "b"), (402, None, "en", "c")]
    return [(i, t, lang, s, None if t is None else len(t), *(f"{n}{i}" for n in NAMES), "dot") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("k", range(5), ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, "")
    empty = stage(spark, docs.limit(0), "")
    assert empty.columns == got.columns and empty.count() == 0
    made = got.collect()
    ids = [r["doc_id"] for r in made]
    if name == "packing":
        assert set(ids) == {r[0] for r in rows()} and ids.count(None) >= 2
        return
    assert got.columns == docs.columns
    if name != "mixing":
        assert got.schema == docs.schema and {tuple(r) for r in made} <= set(rows())
    for r in made:  # all other columns are as they were
        assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES) and r["dotted.name"] == "dot"
    known = {i for i in range(40)}
    if name == "quality rules":
        assert known < set(ids) and ids.count(100) == 2 and not set(ids) & {200, 201, 202, 203, 401, 402}
    if name == "language ID":
        assert known < set(ids) and ids.count(100) == 2 and not set(ids) & {200, 201, 202, 203, 402} and 400 in ids
    if name == "near-dedup":
        assert known < set(ids) and ids.count(100) == 1 and 101 in ids and 102 not in ids and {200, 201, 202} <= set(ids) and ids.count(None) == 2
    if name == "mixing":
        assert not set(ids) & {200, 201, 202, 402} and all(r["text"] and r["n_chars"] == len(r["text"]) for r in made)


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} >= {100, 101} and not {r["doc_id"] for r in got.collect()} & {102, 200, 201, 202, 203, 401, 402}


def test_clashing_names_of_statistics(spark, docs):
    got = quality.judge(docs)
    assert {"n_words", "kept", "_windows", "host"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert got.where("doc_id = 0").select("n_words").first()[0] == len(story(0).split())


def test_measured_join(spark):
    right = common.durable(spark.range(1000).select(F.col("id").cast("string").alias("k"), F.array(F.lit("x" * 50)).alias("v"), F.array(F.col("id")).alias("w")), "right")
    assert 60_000 < common.measured_bytes(right) < 300_000 and common.measured_bytes(right.limit(0)) == 0
    left = spark.range(10).select(F.col("id").cast("string").alias("k"))
    plan = lambda limit: common.measured_join(left, right, "k", "left", limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 20) and "strategy=merge" in plan(1000)
