"""Models: the lexicon rules in both forms, and Python models behind the hooks."""

import random

import pytest
from pyspark.sql import functions as F
from threadloom.backends import models
from threadloom.operators import clustering, coherence, sentiment, topics

VALENCE = {"fine": 1.0, "grim": -2.0}


def compound(text, valence=VALENCE):
    return models.score_words(text, valence)[3]


def test_rules_by_hand():
    squash = lambda s: s / (s * s + 15) ** 0.5
    cases = {
        "fine": 1.0, "very fine": 1.293, "very odd fine": 1 + 0.95 * 0.293, "not fine": -0.74, "never very grim": 2.293 * 0.74, "FINE day": 1.733, "FINE": 1.0,
        "fine but grim": 0.5 - 3.0, "fine!!": 1.584, "fine!!!!!!": 1 + 4 * 0.292, "grim??": -2.36, "grim????": -2.96, "fine?": 1.0, "stone": 0.0, "stone!": 0.0,
    }
    for text, total in cases.items():
        assert compound(text) == pytest.approx(squash(total)), text
    assert models.score_words("fine grim stone", VALENCE)[:3] == pytest.approx((3 / 6, 1 / 6, 2 / 6))


def test_both_forms_agree(spark):
    r = random.Random(2)
    words = ["good", "Bad", "GREAT", "very", "not", "but", "the", "hate", "so", "never", "x", "LOSE", "slightly"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "!", "?", ",", "..."]) for _ in range(r.randrange(1, 14))) for _ in range(300)] + ["", " ", None, "!!!", "?", "GOOD BAD"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", models.lexicon_sentiment(F.col("t")).alias("a"), models.lexicon_model(models.VALENCE)(F.col("t")).alias("b")).collect()
    for x in rows:
        if x["a"] is None:
            assert x["b"] is None and not x["t"]
        else:
            assert [x["a"][c] for c in ("neg", "neu", "pos", "compound")] == pytest.approx([x["b"][c] for c in ("neg", "neu", "pos", "compound")], abs=1.1e-3), x["t"]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("Fine\t1.0\t0.5\t[1, 1]\ngrim\t-2.0\n\n")
    model = models.lexicon_model(models.read_lexicon(str(tmp_path / "lexicon.txt")))
    rows = sentiment.add_polarity(spark.createDataFrame([("so fine",), ("grim",), ("",)], "clean_text string"), model=model).collect()
    assert [x["vader_label"] for x in rows] == ["positive", "negative", None]


def test_python_models_behind_the_hooks(spark):
    seen = models.classifier(lambda: lambda texts: [[{"label": "LABEL_2", "score": 0.9}, {"label": "LABEL_0", "score": 0.1}] for _ in texts], batch=2)
    rows = sentiment.add_sentiment(spark.createDataFrame([("a",), (" ",), (None,), ("b",), ("c",)], "clean_text string"), model=seen).collect()
    assert [x["roberta_label"] for x in rows] == ["positive", None, None, "positive", "positive"]
    posts = spark.createDataFrame([(1, 1, -1, 0, 7, "root words"), (2, 1, 1, 1, 8, "root"), (3, 1, 1, 2, 8, None)], "id long, thread_id long, comment_to long, round long, user_id long, tweet string")
    embed = models.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    cross = models.pair_scorer(lambda: lambda pairs: [float(len(a) - len(b)) for a, b in pairs], batch=1)
    flagged, summary = coherence.run(posts, embed, models.token_overlap_matcher, cross)
    assert flagged.count() == 2 and summary.first()["n_replies"] == 2


def test_injected_estimators(spark):
    """Reducers and clusterers of the caller's are used in place of the own ones."""
    first = lambda df, columns, key: df.select(key, F.array(F.col(columns[0]).cast("double"), F.lit(1.0)).alias("x"))
    sign = lambda df, key: df.select(key, F.when(F.get("x", F.lit(0)) > 0, 1).otherwise(0).alias("cluster"))
    agents = spark.createDataFrame([(i, float(i - 5), float(i * i)) for i in range(12)], "id long, a double, b double")
    got = clustering.fit_agents(agents, ("a", "b"), scaler=lambda df, columns: df, reducer=first, clusterer=sign, mixer=sign).collect()
    assert all(r["hdbscan_cluster"] == r["gmm_cluster"] == int(r["a"] > 0) for r in got) and len(got) == 12
    texts = spark.createDataFrame([(i, f"text number{i} of many words here and there now") for i in range(8)], "id long, tweet string")
    embed = models.encoder(lambda: lambda rows: [[float(len(t) % 2) - 0.5, 0.0] for t in rows])
    assert {r["cluster"] for r in clustering.cluster_texts(texts, embed, size=2, reducer=first, clusterer=sign).collect()} <= {0, 1}
    found = topics.embedding_topics(topics.prepare(texts, ("of",)), embed, 2, reducer=first, clusterer=sign).collect()
    assert len(found) == 8 and {r["bertopic_topic"] for r in found} <= {0, 1}
