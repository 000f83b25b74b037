import inspect

import pytest
from pyspark.sql import functions as F
from threadloom.operators import topics
from threadloom.plans import load_all
from threadloom.plans import models as plans

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def test_coherence_pipeline_keeps_long_and_null_turns(spark, tmp_path):
    rows = [(1, 0, "user", "long root " * 100), (1, 1, "assistant", "short reply"), (2, 0, "user", "short root"), (2, 1, "assistant", "long reply " * 100), (2, 2, "user", None)]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["thread_id"]: r["n_replies"] for r in load_all().QUERIES["x5_x7_coherence_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2}


def test_lda_passes_take_each_text_once(spark):
    """From one start, a pass over disjoint texts must give every one of their words weight."""
    words = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(k, [w] * 50) for k, w in enumerate(words)], "id bigint, tokens array<string>")
    model = topics.fit_lda(df, 2, 1, no_below=1, no_above=1.0)
    weights = model.topic_terms().groupBy("term").agg(F.sum("weight").alias("w")).collect()
    least, most = min(r["w"] for r in weights), max(r["w"] for r in weights)
    assert len(weights) == 60 and most < 1.5 * least


def test_lda_queries_use_the_operators_passes(spark, monkeypatch):
    default, used = inspect.signature(topics.fit_lda).parameters["passes"].default, []

    class Stop(Exception):
        pass

    def fit(df, k=8, passes=default, *a, **b):
        used.append(passes)
        raise Stop

    monkeypatch.setattr(topics, "fit_lda", fit)
    monkeypatch.setattr(plans, "prepared", lambda spark, d: None)
    for name in ("l3_l4_lda_words", "l5_lda_topics", "l6_perplexity"):
        with pytest.raises(Stop):
            load_all().QUERIES[name](spark, "")
    assert used == [10, 10, 10]
