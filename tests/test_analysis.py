import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from threadloom.functions import scores, stats, vectors
from threadloom.kernels import changepoint, density, louvain, special
from threadloom.operators import clustering, coherence, dynamics, echo, eda, graph, sentiment, topics


def by(rows, key):
    return {r[key]: r for r in rows}


def test_polarity_and_classifiers(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0,), (None,)], "c double")
    assert [r[0] for r in df.select(scores.polarity_label(F.col("c"))).collect()] == ["positive", "negative", "neutral", None]
    fake = lambda t: F.when(t != "", F.array(*(F.struct(F.lit(f"LABEL_{k}").alias("label"), F.lit(s).alias("score")) for k, s in enumerate((0.1, 0.2, 0.7)))))
    rows = sentiment.add_sentiment(spark.createDataFrame([("x",), ("",)], "clean_text string"), model=fake).collect()
    assert (rows[0]["roberta_label"], rows[0]["roberta_score"]) == ("positive", 0.7) and rows[0]["roberta_compound"] == pytest.approx(0.6) and rows[1]["roberta_label"] is None
    p = dict(zip(scores.EMOTIONS, (0.10, 0.05, 0.15, 0.60, 0.20, 0.10, 0.30), strict=True))
    r = sentiment.emotion_columns(spark.createDataFrame([tuple(p.values())], [f"emotion_{k}" for k in p])).first()
    assert r["emotion_label"] == "joy" and r["emotion_valence"] == pytest.approx(0.6 - 0.1) and r["emotion_arousal"] == pytest.approx((0.1 + 0.15 + 0.3 + 0.6) / 4 - (0.1 + 0.05 + 0.2) / 3)


def test_turns_and_summaries(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.3), (2, 1, 1, 0.0), (3, 2, 1, None), (4, None, 1, 0.1)], "id bigint, thread_id bigint, round bigint, roberta_compound double")
    rows = by(dynamics.order_turns(df).collect(), "id")
    assert [(rows[i]["turn"], rows[i]["thread_len"], rows[i]["turn_rel"]) for i in (1, 2, 3)] == [(1, 2, 1.0), (0, 2, 0.0), (0, 1, 0.0)] and 4 not in rows
    df = spark.createDataFrame([(1, t, x, y) for t, x, y in ((0, 0.0, 0.0), (1, 0.3, -0.2), (2, 0.6, 0.5))], "thread_id bigint, round bigint, roberta_compound double, vader_compound double")
    rows = dynamics.turn_features(dynamics.order_turns(df)).orderBy("turn").collect()
    assert [r["roberta_compound_delta"] for r in rows] == [None, 0.3, 0.3] and [r["low_agreement"] for r in rows] == [False, True, False]
    assert [r["roberta_compound_roll3_mean"] for r in rows] == [0.0, 0.15, pytest.approx(0.3)] and rows[0]["roberta_compound_roll3_std"] is None
    with pytest.raises(ValueError):
        dynamics.order_turns(df.drop("thread_id"))


def test_arcs(spark):
    cases = [(None, 0.1, 0, "unknown"), (0.1, 0.3, 0, "chaotic"), (0.1, 0.1, 1, "V-shape"), (-0.1, 0.1, 1, "inverted-V"), (0.01, 0.1, 0, "stable"), (0.1, 0.1, 0, "escalating"), (-0.1, 0.1, 2, "de-escalating")]
    df = spark.createDataFrame(cases, "s double, v double, n int, want string")
    assert all(r[0] == r[1] for r in df.select(scores.arc_type(F.col("s"), F.col("v"), F.col("n")), "want").collect())
    flat = spark.createDataFrame([(1, t, 0.2) for t in range(5)], "thread_id bigint, round bigint, roberta_compound double")
    r = dynamics.run(flat)[1].first()
    assert r["trend_r2"] == 0 and r["arc_type"] == "stable" and r["changepoint_turns"] == []


def test_change_points():
    x = np.concatenate([np.zeros(8), np.ones(8) * 5, np.zeros(8)])
    assert changepoint.change_points(x, 1.0) == [7, 15] and changepoint.change_points([1, 2, 3]) == []
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (5, 7, 9):
        y = rng.normal(size=n)
        k = changepoint.gram(y)
        cost = lambda a, b, k=k: (b - a) - k[a:b, a:b].sum() / (b - a)
        best = (math.inf, None)
        for mask in range(1 << (n - 1)):
            ends = [i + 1 for i in range(n - 1) if mask >> i & 1] + [n]
            starts = [0, *ends[:-1]]
            if all(b - a >= 2 for a, b in zip(starts, ends, strict=True)):
                total = sum(cost(a, b) for a, b in zip(starts, ends, strict=True)) + 0.3 * (len(ends) - 1)
                best = min(best, (total, [e - 1 for e in ends[:-1]]), key=lambda z: z[0])
        assert changepoint.change_points(y, 0.3) == best[1]


def test_coherence(spark):
    df = spark.createDataFrame([(1, 0.1, 0.8, 0.9), (2, 0.6, 0.85, 0.9), (3, None, 0.7, 0.1)], "id bigint, cosine_similarity double, bs_f1 double, cross_encoder_score double")
    rows = by(coherence.add_composite(coherence.flag(df)).collect(), "id")
    assert [rows[i]["flag_consensus"] for i in (1, 2, 3)] == [True, False, True] and rows[2]["composite"] == pytest.approx((0.6 + 0.5 + 0.9) / 3)
    posts = spark.createDataFrame([(1, 7, -1, 0, 1, "r"), (2, 7, 1, 1, 2, "a"), (3, 7, 2, 2, 1, "b")], "id bigint, thread_id bigint, comment_to bigint, round bigint, user_id bigint, tweet string")
    assert {(r["id"], r["root_id"]) for r in coherence.pair(posts).collect()} == {(2, 1), (3, 1)} and {(r["id"], r["root_id"]) for r in coherence.pair(posts, "direct_parent").collect()} == {(2, 1), (3, 2)}
    no_root = posts.withColumn("comment_to", F.lit(0)).where("round > 0")
    assert {(r["id"], r["root_id"]) for r in coherence.pair(no_root).collect()} == {(3, 2)}
    with pytest.raises(ValueError):
        coherence.pair(posts, "nearest")


def test_stance_and_attitudes(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0.5), ([0.8, 0.2], 0.4), ([0.0, 1.0], -0.9), ([5.0, 5.0], 0.3)], "v array<double>, s double")
    r = echo.prototypes(df, "v", "s", 2).first()
    assert r["pro"] == pytest.approx([0.9, 0.1]) and r["anti"] == [0.0, 1.0] and echo.prototypes(df.where("s > 0"), "v", "s", 2).first()["anti"] == [0.0, 0.0]
    f = echo.fuse(spark.createDataFrame([(-1.0, -2.0), (0.0, 0.0), (1.0, 2.0)], "stance_similarity double, cross_encoder_score double")).collect()
    assert [x["stance_ensemble"] for x in f] == pytest.approx([-1, 0, 1])
    tweets = echo.add_attitudes(spark.createDataFrame([(1, 0.5, 0.2, 1, 0, 2), (1, -0.5, -0.4, 3, 4, 1), (2, 0.1, 0.0, 1, 0, 0)], "user_id bigint, stance_ensemble double, roberta_compound double, day int, like bigint, reaction_count bigint"))
    a, b = math.tanh(0.5 * 1.1), math.tanh(-0.5 * 1.2)
    u = by(echo.user_attitudes(tweets).collect(), "user_id")
    assert u[1]["mean_attitude"] == pytest.approx((a + b) / 2) and u[1]["weighted_attitude"] == pytest.approx((a * math.exp(-2) + b) / (math.exp(-2) + 1)) and u[1]["engagement_weighted_attitude"] == pytest.approx((a + 5 * b) / 6) and u[2]["attitude_std"] is None
    got = {(r["day"], r["user_id"]): r["attitude"] for r in echo.propagation(tweets).collect()}
    assert set(got) == {(1, 1), (3, 1), (1, 2), (3, 2)} and got[3, 1] == pytest.approx((a + b) / 2) and got[3, 2] == got[1, 2]


EDGE = "a bigint, b bigint, weight bigint"
ATT = "user_id bigint, attitude double"


def test_graph(spark):
    posts = spark.createDataFrame([(1, 1, -1, -1), (2, 2, 1, -1), (3, 2, 1, -1), (4, 3, -1, 2), (5, 1, 1, 99)], "id bigint, user_id bigint, comment_to bigint, shared_from bigint")
    people = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], ATT)
    assert {tuple(r) for r in graph.build(posts, people).collect()} == {(2, 1, 2, "reply"), (3, 2, 1, "retweet")}
    both = spark.createDataFrame([(1, 2, 5, "reply"), (2, 1, 3, "reply"), (2, 3, 4, "retweet")], "src bigint, dst bigint, weight bigint, type string")
    assert {tuple(r) for r in graph.undirected(both).collect()} == {(1, 2, 3), (2, 3, 4)}
    path = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1)], EDGE)
    att = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, -0.3), (4, -0.5), (9, 0.1)], ATT)
    assert graph.homophily(path, att).first()["homophily_ratio"] == pytest.approx(2 / 3)
    assert {r["node"]: r["component"] for r in graph.components(att, path).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    star = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], EDGE)
    d = {r["user_id"]: r["exposure_diversity"] for r in graph.exposure_diversity(star, spark.createDataFrame([(1, 0.0), (2, -0.6), (3, 0.6), (4, 0.0)], ATT)).collect()}
    assert d[4] == 0 and d[1] == pytest.approx((0.6 + math.log(2) / 2 + 1.2) / 3, abs=1e-6)
    assert graph.homophily(path.limit(0), att).first()["assortativity"] == 0


def test_communities(spark):
    edges = [(a, b, 1) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 1)]
    found = louvain.louvain(edges)
    assert len({found[i] for i in range(5)}) == len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[10]
    people = spark.createDataFrame([(i, 0.0) for i in [*range(5), *range(10, 15), 99]], ATT)
    pairs = spark.createDataFrame(edges, EDGE)
    labels = graph.communities(people, pairs)
    assert labels.count() == 11 and labels.select("community").distinct().count() == 3
    m = 21
    assert graph.modularity(pairs, labels).first()[0] == pytest.approx(2 * (10 / m - (21 / (2 * m)) ** 2))
    assert graph.communities(people, pairs.limit(0)).select("community").distinct().count() == 1


def test_polarization_and_score(spark):
    r = echo.polarization(spark.createDataFrame([(1, -0.5), (2, 0.5), (3, 0.2), (4, -0.2)], ATT)).first()
    assert r["variance"] == pytest.approx(0.145) and r["inter_group_distance"] == pytest.approx(0.7)
    assert tuple(echo.polarization(spark.createDataFrame([], ATT)).first()) == (0.0, 0.0, 0.0)
    s = echo.echo_score(
        spark.createDataFrame([(0.25, 0.35, 0.75)], "variance double, bimodality double, inter_group_distance double"), spark.createDataFrame([(0.4, 0.6)], "assortativity double, homophily_ratio double"),
        spark.createDataFrame([(0.3,)], "exposure_diversity double"), spark.createDataFrame([(0, 2, 0.4, 0.1)], "community int, size int, avg_attitude double, attitude_std double"),
    ).first()
    assert s["polarization_score"] == pytest.approx(0.5) and s["homophily_score"] == pytest.approx(0.5) and s["low_diversity_score"] == pytest.approx(0.7) and s["separation_score"] == 1.0
    assert s["echo_chamber_score"] == pytest.approx(0.15 + 0.15 + 0.14 + 0.2)


def test_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, 1.0), (3.0, 5.9, 1.0), (None, 1.0, 1.0)], "x double, y double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["x", "y", "c"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]) and got["x", "c"] is None
    table = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 9, "p string, q string")
    r = stats.contingency_tests(table, "p", "q").first()
    e = np.outer([12, 12], [13, 11]) / 24
    n = np.array([[10, 2], [3, 9]])
    assert r["chi2"] == pytest.approx((((abs(n - e)) - 0.5) ** 2 / e).sum()) and r["dof"] == 1
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and special.chi2_tail(0, 3) == 1
    v = vectors.mean_pair_cosine(spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "user_id int, v array<double>"), "user_id", "v")
    assert {r["user_id"]: r["cosine_similarity"] for r in v.collect()} == {1: pytest.approx(1.0), 2: 1.0}


def test_density():
    rng = np.random.Generator(np.random.PCG64(2))
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[50, 50]]])
    got = density.cluster(x, 6, 2)
    assert set(got[:30]) == {0} and set(got[30:60]) == {1} and got[60] == -1
    assert density.cluster(x[:3], 6, 2).tolist() == [-1] * 3


def test_bimodality_vote():
    rng = np.random.Generator(np.random.PCG64(5))
    two = np.concatenate([rng.normal(-2, 0.3, 100), rng.normal(2, 0.3, 100)])
    assert special.bimodality_vote(two)["verdict"] == "bimodal" and special.bimodality_vote(rng.normal(size=200))["verdict"] == "unimodal" and special.bimodality_vote([1, 2])["verdict"] == "insufficient"


def test_clusters_and_profiles(spark):
    rows = spark.createDataFrame([(0, "alpha beta"), (0, "alpha gamma"), (0, "alpha beta delta"), (-1, "zzz")], "cluster int, clean_tweet string")
    assert {r["cluster"]: r["cluster_label"] for r in clustering.cluster_labels(rows, ()).collect()} == {0: "Cluster 0: alpha, beta, delta, gamma", -1: "Noise"}
    agents = spark.createDataFrame([(i, i % 2, "m" if i % 2 else "f", 20 + i) for i in range(24)], "id bigint, Agent_Cluster int, gender string, age int")
    made = clustering.profile(agents, "gender")
    assert made["tests"].first()["ari"] == pytest.approx(1.0) and made["tests"].first()["significant"] and clustering.profile(agents, "missing") == {}
    assert set(clustering.profile(agents, "age")) == {"describe"}
    out = clustering.impute_coherence(spark.createDataFrame([(1, 0.5), (2, None)], "id bigint, avg_reply_coherence double")).orderBy("id").collect()
    assert [(r["has_parent"], r["avg_reply_coherence"]) for r in out] == [(1, 0.5), (0, 0.5)]


def test_topics(spark):
    info = topics.topic_info(spark.createDataFrame([(0, ["cat", "cat", "dog"]), (0, ["cat"]), (-1, ["x"])], "bertopic_topic int, tokens array<string>"))
    assert {r["Topic"]: (r["Count"], r["Name"]) for r in info.collect()} == {0: (2, "0_cat_dog"), -1: (1, "-1_x")}
    drift = topics.drift(spark.createDataFrame([(1, "t", 5)], "id bigint, tweet string, length int"), spark.createDataFrame([(1, "positive")], "id bigint, roberta_label string"))
    assert drift.columns == ["id", "tweet", "length", "sentiment"] and drift.first()["sentiment"] == "positive"


def test_eda(spark):
    daily = spark.createDataFrame([(d, 10 + d) for d in range(5)], "day int, volume bigint")
    assert not any(r["spike"] for r in eda.spikes(daily).collect())
    assert eda.hourly(spark, spark.createDataFrame([(3,), (3,)], "hour int")).agg(F.sum("n")).first()[0] == 2
