import corpus_pipeline
from threadloom.llm import dedup, langid, packing, quality
from tokenizers import Tokenizer


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-dedup", "mixing", "packing"]
    kept = quality.stage(spark, docs, sf)
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged and kept.columns == docs.columns
    named = langid.stage(spark, kept, sf)
    assert {r["doc_id"] for r in named.collect()} <= judged
    one = dedup.stage(spark, named, sf)
    groups = {r["component_id"] for r in dedup.near_duplicates(named).collect()}
    assert {r["doc_id"] for r in one.collect()} == groups and one.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= groups
    mixed = corpus_pipeline.STAGES[3][1](spark, one, sf)
    whole = Tokenizer.from_file(packing.default_packing().tokenizer)
    assert mixed.columns == docs.columns
    assert sum(r["length"] for r in out) == sum(len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
