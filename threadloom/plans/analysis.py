"""Queries: thread dynamics, scores, coherence, stance, attitudes, graphs, echo chambers, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, stats, vectors
from ..operators import clustering, coherence, dynamics, echo, graph
from ..sources.driver_tables import POSTS, STANCES, THREADS, posts, stances, table, threads
from .registry import query

D = dynamics.Dynamics(emotion_signals=())

TURNS = f"""SELECT *, turn / CAST(greatest(thread_len - 1, 1) AS DOUBLE) AS turn_rel FROM (SELECT *, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY round, id) - 1 AS INT) AS turn, CAST(count(*) OVER (PARTITION BY thread_id) AS INT) AS thread_len FROM ({THREADS}) WHERE thread_id IS NOT NULL)"""


def turns(spark, d):
    return dynamics.order_turns(threads(spark, d), D)


@query("w1_w3_turns", f"SELECT id, turn, thread_len, turn_rel FROM ({TURNS})", "turn_rel")
def ordered(spark, d):
    return turns(spark, d).select("id", "turn", "thread_len", "turn_rel")


_ROLL = "(PARTITION BY thread_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
FEATURES = f"""SELECT id, roberta_compound - lag(roberta_compound) OVER (PARTITION BY thread_id ORDER BY turn) AS d, avg(roberta_compound) OVER {_ROLL} AS m, stddev_samp(roberta_compound) OVER {_ROLL} AS s, abs(roberta_compound - vader_compound) AS a, coalesce(abs(roberta_compound - vader_compound) > 0.4, FALSE) AS low FROM ({TURNS})"""


@query("w4_w6_turn_features", FEATURES, "d m s a")
def turn_features(spark, d):
    s = "roberta_compound"
    return dynamics.turn_features(turns(spark, d), D).select("id", F.col(f"{s}_delta").alias("d"), F.col(f"{s}_roll3_mean").alias("m"), F.col(f"{s}_roll3_std").alias("s"), F.col("sentiment_agreement").alias("a"), F.col("low_agreement").alias("low"))


TRENDS = f"""SELECT thread_id, max(thread_len) AS thread_len, avg(roberta_compound) AS mean_sentiment, stddev_pop(roberta_compound) AS std_sentiment, regr_slope(roberta_compound, turn) AS trend_slope,
  CASE WHEN count(roberta_compound) < 2 THEN NULL WHEN var_pop(roberta_compound) = 0 THEN 0 ELSE regr_r2(roberta_compound, turn) END AS trend_r2,
  arg_min(roberta_compound, turn) AS sentiment_start, arg_max(roberta_compound, turn) AS sentiment_end, arg_max(roberta_compound, turn) - arg_min(roberta_compound, turn) AS sentiment_delta, max(thread_len) < 3 AS short_thread
FROM ({TURNS}) GROUP BY thread_id"""
ARCS = f"""SELECT thread_id, thread_len, mean_sentiment, std_sentiment, CASE WHEN NOT short_thread THEN trend_slope END AS trend_slope, CASE WHEN NOT short_thread THEN trend_r2 END AS trend_r2, sentiment_start, sentiment_end, sentiment_delta, short_thread,
  CASE WHEN short_thread OR trend_slope IS NULL OR std_sentiment IS NULL THEN 'unknown' WHEN std_sentiment > 0.25 THEN 'chaotic' WHEN abs(trend_slope) < 0.05 THEN 'stable' WHEN trend_slope > 0 THEN 'escalating' ELSE 'de-escalating' END AS arc_type FROM ({TRENDS})"""
_TR = "mean_sentiment std_sentiment trend_slope trend_r2 sentiment_start sentiment_end sentiment_delta"


@query("h1_h2_w12_thread_trends", TRENDS, _TR)
def trends(spark, d):
    return dynamics.thread_trends(turns(spark, d), D)


@query("thread_summaries", ARCS, _TR)
def summaries(spark, d):
    """Flagship: trend and arc of each thread, without change points."""
    return dynamics.thread_summaries(turns(spark, d), D, with_changes=False)


@query("m16_worst_threads", f"SELECT thread_id, trend_slope, arc_type FROM ({ARCS}) WHERE trend_slope IS NOT NULL ORDER BY trend_slope, thread_id LIMIT 10", "trend_slope")
def worst(spark, d):
    return summaries(spark, d).where("trend_slope is not null").select("thread_id", "trend_slope", "arc_type").orderBy("trend_slope", "thread_id").limit(10)


@query("h3_change_points")
def change_points(spark, d):
    return dynamics.change_points(turns(spark, d), D)


def stepped(spark, d):
    """Users' posts as threads, whose signal steps up in the middle of the month: there are change points to find."""
    rows = posts(spark, d).withColumn("thread_id", F.col("user_id") % 50).withColumn("round", F.col("id"))
    step = F.when(F.col("day") >= 15, 0.45).otherwise(-0.45)
    return dynamics.order_turns(rows.withColumn("roberta_compound", F.col("roberta_compound") * 0.1 + step), D)


@query("m16_arcs_with_changes")
def arcs_with_changes(spark, d):
    return dynamics.thread_summaries(stepped(spark, d), D)


@query("m17_change_timing")
def change_timing(spark, d):
    return dynamics.change_timing(arcs_with_changes(spark, d))


E7 = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")
EMO = f"WITH m AS (SELECT thread_id, {', '.join(f'avg(emotion_{e}) AS {e}' for e in E7)} FROM ({POSTS}) GROUP BY thread_id), t AS (SELECT *, {' + '.join(E7)} AS tot, greatest({', '.join(E7)}) AS top FROM m) SELECT thread_id, CASE {' '.join(f'WHEN {e} = top THEN {chr(39)}{e}{chr(39)}' for e in E7)} END AS dominant_emotion, -({' + '.join(f'{e} / tot * ln({e} / tot + 1e-9)' for e in E7)}) AS emotion_entropy FROM t"


@query("a20_thread_emotions", EMO, "emotion_entropy")
def thread_emotions(spark, d):
    return dynamics.thread_emotions(posts(spark, d)).select("thread_id", "dominant_emotion", "emotion_entropy")


ARC_EMOTIONS = f"SELECT arc_type, {', '.join(f'avg({e}) AS {e}' for e in E7)} FROM ({ARCS.replace(THREADS, POSTS)}) JOIN (SELECT thread_id, {', '.join(f'avg(emotion_{e}) AS {e}' for e in E7)} FROM ({POSTS}) GROUP BY thread_id) USING (thread_id) GROUP BY arc_type"


@query("a21_arc_emotions", ARC_EMOTIONS, " ".join(E7))
def arc_emotions(spark, d):
    rows = dynamics.order_turns(posts(spark, d), D)
    return dynamics.arc_emotions(dynamics.thread_summaries(rows, D, with_changes=False))


@query("a22_position_curve", f"SELECT bin, avg(x) AS mean, stddev_samp(x) AS std, count(x) AS n FROM (SELECT roberta_compound AS x, CAST(least(greatest(ceil((round(turn_rel, 9) - 0) / (CAST(1 AS DOUBLE) / 10)), 1) - 1, 9) AS INT) AS bin FROM ({TURNS}) WHERE thread_len >= 3) GROUP BY bin", "mean std")
def position_curve(spark, d):
    return dynamics.position_curve(turns(spark, d).withColumn("turn_rel", F.round("turn_rel", 9)), "roberta_compound")


@query("m1_polarity_labels", f"SELECT id, CASE WHEN vader_compound >= 0.05 THEN 'positive' WHEN vader_compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM ({THREADS})")
def polarity(spark, d):
    return threads(spark, d).select("id", scores.polarity_label(F.col("vader_compound")).alias("label"))


@query("m3_m5_emotion_scores", f"SELECT id, (CASE {' '.join(f'WHEN emotion_{e} = top THEN {chr(39)}{e}{chr(39)}' for e in E7)} END) AS label, top AS score, emotion_joy - (emotion_sadness + emotion_fear + emotion_disgust + emotion_anger) / 4 AS valence, (emotion_anger + emotion_fear + emotion_surprise + emotion_joy) / 4 - (emotion_sadness + emotion_disgust + emotion_neutral) / 3 AS arousal FROM (SELECT *, greatest({', '.join(f'emotion_{e}' for e in E7)}) AS top FROM ({POSTS}))", "score valence arousal")
def emotion_scores(spark, d):
    from ..operators.sentiment import emotion_columns

    return emotion_columns(posts(spark, d)).select("id", F.col("emotion_label").alias("label"), F.col("emotion_score").alias("score"), F.col("emotion_valence").alias("valence"), F.col("emotion_arousal").alias("arousal"))


@query("m7_m15_attitude", f"SELECT id, 1 / (1 + exp(-roberta_compound)) AS sig, least(greatest(tanh(stance_ensemble * (1 + 0.5 * abs(roberta_compound))), -1), 1) AS attitude FROM ({POSTS})", "sig attitude")
def attitude(spark, d):
    return posts(spark, d).select("id", scores.sigmoid(F.col("roberta_compound")).alias("sig"), scores.attitude(F.col("stance_ensemble"), F.col("roberta_compound")).alias("attitude"))


@query("m18_bands", "SELECT event_id, CASE WHEN value / 500 < 0.3 THEN 'LOW' WHEN value / 500 < 0.6 THEN 'MODERATE' ELSE 'HIGH' END AS band FROM events")
def bands(spark, d):
    return table(spark, d, "events").select("event_id", scores.band(F.col("value") / 500).alias("band"))


_FROM = "FROM (SELECT id, thread_id, round, (roberta_compound + 1) / 2 AS c, 0.7 + 0.3 * (vader_compound + 1) / 2 AS f, (vader_compound + 1) / 2 AS x FROM (" + THREADS + "))"
FLAGS = f"SELECT id, thread_id, c, f, x, coalesce(c < 0.25, FALSE) AS f1, coalesce(f < 0.85, FALSE) AS f2, coalesce(x < 0.5, FALSE) AS f3, CAST(c < 0.25 AS INT) + CAST(f < 0.85 AS INT) + CAST(x < 0.5 AS INT) >= 2 AS consensus, (c + least(greatest((f - 0.7) / 0.3, 0), 1) + x) / 3 AS composite {_FROM}"


def scored(spark, d):
    rows = threads(spark, d)
    v = (F.col("vader_compound") + 1) / 2
    return coherence.flag(rows.select("id", "thread_id", "round", "user_id", ((F.col("roberta_compound") + 1) / 2).alias("cosine_similarity"), (0.7 + 0.3 * v).alias("bs_f1"), v.alias("cross_encoder_score")))


@query("m8_m10_coherence_flags", FLAGS, "c f x composite")
def flags(spark, d):
    return coherence.add_composite(scored(spark, d)).select("id", "thread_id", F.col("cosine_similarity").alias("c"), F.col("bs_f1").alias("f"), F.col("cross_encoder_score").alias("x"), F.col("flag_low_cosine").alias("f1"), F.col("flag_low_bertscore").alias("f2"), F.col("flag_low_crossenc").alias("f3"), F.col("flag_consensus").alias("consensus"), "composite")


@query("a12_coherence_summary", f"SELECT thread_id, count(id) AS n_replies, avg(c) AS mean_cosine_similarity, avg(f) AS mean_bs_f1, avg(x) AS mean_cross_encoder_score, min(c) AS min_cosine_similarity, min(f) AS min_bs_f1, min(x) AS min_cross_encoder_score, avg(CAST(consensus AS INT)) AS pct_flagged_consensus, (avg(c) + (avg(f) - 0.8) / 0.2 + avg(x)) / 3 AS composite_coherence FROM ({FLAGS}) GROUP BY thread_id", "mean_cosine_similarity mean_bs_f1 mean_cross_encoder_score min_cosine_similarity min_bs_f1 min_cross_encoder_score pct_flagged_consensus composite_coherence")
def coherence_summary(spark, d):
    return coherence.summarize(scored(spark, d))


@query("a11_user_coherence", f"SELECT user_id, avg(0.20 * c + 0.35 * f + 0.45 * x) AS avg_reply_coherence FROM ({FLAGS}) a JOIN (SELECT id, user_id FROM ({THREADS})) b USING (id) GROUP BY user_id", "avg_reply_coherence", 9)
def user_coherence(spark, d):
    return clustering.user_coherence(scored(spark, d))


@query("a23_h18_decay", f"SELECT round, avg(x) AS mean, stddev_samp(x) AS std, count(x) AS n FROM (SELECT round, (vader_compound + 1) / 2 AS x FROM ({THREADS})) GROUP BY round", "mean std")
def decay(spark, d):
    return coherence.decay(scored(spark, d), "cross_encoder_score")


@query("h18_decay_trend", f"SELECT regr_slope(m, round) AS slope, regr_intercept(m, round) AS intercept FROM (SELECT round, avg((vader_compound + 1) / 2) AS m FROM ({THREADS}) GROUP BY round)", "slope intercept")
def decay_trend(spark, d):
    return coherence.trend(decay(spark, d))


@query("j8_w10_root_pairs", f"SELECT a.id, b.id AS root_id FROM ({THREADS}) a JOIN ({THREADS}) b ON a.thread_id = b.thread_id AND b.comment_to = -1 WHERE a.comment_to <> -1")
def root_pairs(spark, d):
    return coherence.thread_root_pairs(threads(spark, d)).select("id", "root_id")


@query("j9_parent_pairs", f"SELECT a.id, b.id AS root_id FROM ({THREADS}) a JOIN ({THREADS}) b ON a.comment_to = b.id WHERE a.comment_to <> -1")
def parent_pairs(spark, d):
    return coherence.direct_parent_pairs(threads(spark, d)).select("id", "root_id")


@query("a24_label_agreement", f"SELECT avg(CAST(a = b AS INT)) AS agreement, count(*) AS n FROM (SELECT CASE WHEN vader_compound >= 0.05 THEN 1 WHEN vader_compound <= -0.05 THEN -1 ELSE 0 END AS a, CASE WHEN roberta_compound >= 0.05 THEN 1 WHEN roberta_compound <= -0.05 THEN -1 ELSE 0 END AS b FROM ({THREADS}))", "agreement")
def label_agreement(spark, d):
    from ..operators.sentiment import agreement_rate

    rows = threads(spark, d)
    return agreement_rate(rows.select(scores.polarity_label(F.col("vader_compound")).alias("vader_label"), scores.polarity_label(F.col("roberta_compound")).alias("roberta_label")))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
COS = lambda a, b: f"coalesce({_DOT.format(a=a, b=b)} / nullif(sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}), 0), 0)"


@query("m11_cosine", f"SELECT a.id, {COS('a.embedding', 'b.embedding')} AS c FROM ({STANCES}) a JOIN ({STANCES}) b ON a.id + 1 = b.id", "c")
def cosine(spark, d):
    a, b = stances(spark, d), stances(spark, d).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return a.join(b, "id").select("id", vectors.cosine(F.col("embedding"), F.col("other")).alias("c"))


_MEAN = "(SELECT list(m ORDER BY k) FROM (SELECT k, avg(v) AS m FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM ({s}) WHERE {c}) GROUP BY k))"
PROTO = f"SELECT {_MEAN.format(s=STANCES, c='score > 0.3')} AS pro, {_MEAN.format(s=STANCES, c='score < -0.3')} AS anti"
STANCE = f"SELECT s.id, {COS('s.embedding', 'p.pro')} AS sim_pro, {COS('s.embedding', 'p.anti')} AS sim_anti FROM ({STANCES}) s, ({PROTO}) p"


@query("x9_m12_stance_prototypes", f"SELECT *, sim_pro - sim_anti AS stance_similarity FROM ({STANCE})", "sim_pro sim_anti stance_similarity")
def stance_similarity(spark, d):
    rows = stances(spark, d)
    return echo.stance_similarity(rows, "embedding", echo.prototypes(rows, "embedding", "score", 64)).select("id", "sim_pro", "sim_anti", "stance_similarity")


FUSE = f"WITH s AS (SELECT id, sim_pro - sim_anti AS s, CASE WHEN id % 3 <> 0 THEN sim_pro END AS c FROM ({STANCE})), n AS (SELECT id, -1 + 2 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s, -1 + 2 * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS c FROM s) SELECT id, s AS stance_similarity_norm, c AS cross_encoder_norm, coalesce(0.6 * s + 0.4 * c, s) AS stance_ensemble FROM n"


@query("m13_m14_j19_fused_stance", FUSE, "stance_similarity_norm cross_encoder_norm stance_ensemble")
def fused(spark, d):
    rows = stance_similarity(spark, d).withColumn("cross_encoder_score", F.when(F.col("id") % 3 != 0, F.col("sim_pro")))
    return echo.fuse(rows).select("id", "stance_similarity_norm", "cross_encoder_norm", "stance_ensemble")


@query("u8_user_cosine", f"SELECT user_id, avg(c) AS cosine_similarity FROM (SELECT a.user_id, {COS('a.embedding', 'b.embedding')} AS c FROM ({STANCES}) a JOIN ({STANCES}) b ON a.user_id = b.user_id AND a.id < b.id) GROUP BY user_id", "cosine_similarity")
def user_cosine(spark, d):
    return clustering.user_cosine(stances(spark, d), "embedding")


ATT = f"SELECT *, least(greatest(tanh(stance_ensemble * (1 + 0.5 * abs(roberta_compound))), -1), 1) AS attitude_score FROM ({POSTS})"
USERS = f"""SELECT user_id, avg(attitude_score) AS mean_attitude, sum(w * attitude_score) / sum(w) AS weighted_attitude, sum(("like" + 1) * attitude_score) / sum("like" + 1) AS engagement_weighted_attitude, CASE WHEN count(*) >= 2 THEN stddev_pop(attitude_score) END AS attitude_std, count(*) AS num_posts, CAST(sum("like") AS BIGINT) AS total_likes, CAST(sum(reaction_count) AS BIGINT) AS total_reactions
FROM (SELECT *, exp(day - max(day) OVER (PARTITION BY user_id)) AS w FROM ({ATT})) GROUP BY user_id"""


def attitudes(spark, d):
    return echo.add_attitudes(posts(spark, d))


@query("a13_user_attitudes", USERS, "mean_attitude weighted_attitude engagement_weighted_attitude attitude_std")
def user_attitudes(spark, d):
    return echo.user_attitudes(attitudes(spark, d))


HISTORY = f"""WITH p AS (SELECT user_id, day, sum(attitude_score) AS s, count(*) AS n FROM ({ATT}) GROUP BY ALL), g AS (SELECT f.user_id, x.day FROM (SELECT user_id, min(day) AS first FROM p GROUP BY user_id) f JOIN (SELECT DISTINCT day FROM p) x ON x.day >= f.first)
SELECT g.day, g.user_id, sum(s) OVER w / sum(n) OVER w AS attitude FROM g LEFT JOIN p ON g.user_id = p.user_id AND g.day = p.day WINDOW w AS (PARTITION BY g.user_id ORDER BY g.day)"""
FINAL = f"SELECT day, user_id, attitude FROM ({HISTORY}) QUALIFY day = max(day) OVER ()"


@query("a14_propagation", HISTORY, "attitude")
def history(spark, d):
    return echo.propagation(attitudes(spark, d))


@query("a15_final_snapshot", FINAL, "attitude")
def final(spark, d):
    return echo.final_attitudes(history(spark, d))


EDGE = lambda col, kind: f"SELECT a.user_id AS src, b.user_id AS dst, count(*) AS weight, '{kind}' AS type FROM ({POSTS}) a JOIN events b ON a.{col} = b.event_id WHERE a.{col} <> -1 AND a.user_id <> b.user_id GROUP BY ALL"
EDGES = f"SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, min(type) AS type FROM ({EDGE('comment_to', 'reply')} UNION ALL {EDGE('shared_from', 'retweet')}) GROUP BY src, dst"
PAIRS = f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, coalesce(max(weight) FILTER (WHERE src > dst), max(weight) FILTER (WHERE src < dst)) AS weight FROM ({EDGES}) GROUP BY 1, 2"
SYM = f"SELECT a AS node, b AS neighbour, weight FROM ({PAIRS}) UNION ALL SELECT b, a, weight FROM ({PAIRS})"


@query("g1_nodes", f"SELECT user_id, mean_attitude AS attitude, num_posts, attitude_std FROM ({USERS})", "attitude attitude_std")
def nodes(spark, d):
    return graph.nodes(user_attitudes(spark, d))


@query("g2_reply_edges", EDGE("comment_to", "reply"))
def reply_edges(spark, d):
    return graph.interaction_edges(posts(spark, d), nodes(spark, d), "comment_to", "reply")


@query("g3_share_edges", EDGE("shared_from", "retweet"))
def share_edges(spark, d):
    return graph.interaction_edges(posts(spark, d), nodes(spark, d), "shared_from", "retweet")


@query("g4_merged_edges", EDGES)
def edges(spark, d):
    return graph.build(posts(spark, d), nodes(spark, d))


@query("g5_undirected", PAIRS)
def pairs(spark, d):
    return graph.undirected(edges(spark, d))


@query("g8_degrees", f"SELECT node, count(*) AS degree FROM ({SYM}) GROUP BY node")
def degrees(spark, d):
    return graph.degrees(pairs(spark, d))


WCC = f"WITH RECURSIVE s AS ({SYM}), r AS (SELECT DISTINCT user_id AS node, user_id AS c FROM events UNION SELECT s.neighbour, r.c FROM r JOIN s ON r.node = s.node) SELECT node, min(c) AS component FROM r GROUP BY node"


@query("g7_components", WCC)
def components(spark, d):
    return graph.components(nodes(spark, d), pairs(spark, d))


@query("g6_graph_stats", f"WITH e AS ({EDGES}), n AS (SELECT count(DISTINCT user_id) AS n FROM events), c AS ({WCC.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) SELECT n AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT component) FROM c) AS n_components, (SELECT count(*) FROM e) / CAST(n * (n - 1) AS DOUBLE) AS density, 2 * (SELECT count(*) FROM e) / CAST(n AS DOUBLE) AS avg_degree FROM n", "density avg_degree")
def graph_stats(spark, d):
    return graph.graph_stats(nodes(spark, d), edges(spark, d))


def snapshot(spark, d):
    return final(spark, d).select("user_id", "attitude")


@query("g9_j18_neighbours", f"WITH f AS ({FINAL}), s AS (SELECT node, avg(attitude) AS m, count(attitude) AS n FROM ({SYM}) JOIN f ON neighbour = user_id GROUP BY node) SELECT f.user_id, coalesce(m, 0) AS neighbour_mean, coalesce(n, 0) AS neighbour_count FROM f LEFT JOIN s ON f.user_id = s.node", "neighbour_mean")
def neighbours(spark, d):
    return graph.neighbour_attitudes(pairs(spark, d), snapshot(spark, d))


ENDS = f"SELECT x.attitude AS xa, y.attitude AS xb FROM ({PAIRS}) p JOIN ({FINAL}) x ON p.a = x.user_id JOIN ({FINAL}) y ON p.b = y.user_id"
HOMO = f"SELECT (SELECT corr(xa, xb) FROM (SELECT xa, xb FROM ({ENDS}) UNION ALL SELECT xb, xa FROM ({ENDS}))) AS assortativity, (SELECT avg(CAST(xa * xb > 0 AS INT)) FROM ({ENDS})) AS homophily_ratio"


@query("g12_g13_homophily", HOMO, "assortativity homophily_ratio")
def homophily(spark, d):
    return graph.homophily(pairs(spark, d), snapshot(spark, d))


DIV = f"""WITH f AS ({FINAL}), s AS (SELECT node, stddev_pop(attitude) AS s, max(attitude) - min(attitude) AS r, [count(*) FILTER (WHERE attitude >= -1 AND attitude < -0.5) + 1e-10, count(*) FILTER (WHERE attitude >= -0.5 AND attitude < 0) + 1e-10, count(*) FILTER (WHERE attitude >= 0 AND attitude < 0.5) + 1e-10, count(*) FILTER (WHERE attitude >= 0.5 AND attitude <= 1) + 1e-10] AS h FROM ({SYM}) JOIN f ON neighbour = user_id GROUP BY node)
SELECT f.user_id, coalesce((s + -list_sum(list_transform(h, lambda v: v / list_sum(h) * ln(v / list_sum(h)))) / 2 + r) / 3, 0) AS exposure_diversity FROM f LEFT JOIN s ON f.user_id = s.node"""


@query("g14_h14_exposure_diversity", DIV, "exposure_diversity")
def diversity(spark, d):
    return graph.exposure_diversity(pairs(spark, d), snapshot(spark, d))


MOMENTS = "SELECT {by} count(x) AS n, avg(x) AS m, var_pop(x) AS v, avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3) AS m3, kurtosis_pop(x) AS k, coalesce(avg(x) FILTER (WHERE x > 0) - avg(x) FILTER (WHERE x < 0), 0) AS dist FROM ({s}) {group}"
_POLAR = "v AS variance, CASE WHEN n <= 3 THEN 0 ELSE (pow(m3 / pow(v, 1.5), 2) + 1) / (k + 3 * (n - 1) * (n - 1) / CAST((n - 2) * (n - 3) AS DOUBLE)) END AS bimodality, dist AS inter_group_distance"
POLAR = f"SELECT {_POLAR} FROM ({MOMENTS.format(by='', s=f'SELECT attitude AS x FROM ({FINAL})', group='')})"


@query("h4_h7_polarization", POLAR, "variance bimodality inter_group_distance")
def polarization(spark, d):
    return echo.polarization(snapshot(spark, d))


@query("e7_daily_polarization", f"SELECT day, {_POLAR} FROM ({MOMENTS.format(by='day,', s=f'SELECT day, attitude AS x FROM ({HISTORY})', group='GROUP BY day')})", "variance bimodality inter_group_distance")
def daily_polarization(spark, d):
    return echo.polarization(history(spark, d), ["day"])


PEOPLE = f"SELECT f.user_id, f.attitude AS propagated_attitude, v.exposure_diversity, f.user_id % 5 AS community FROM ({FINAL}) f JOIN ({DIV}) v ON f.user_id = v.user_id"
COMM = f"SELECT community, count(user_id) AS size, round(avg(propagated_attitude), 4) AS avg_attitude, round(stddev_samp(propagated_attitude), 4) AS attitude_std, round(avg(exposure_diversity), 4) AS avg_diversity FROM ({PEOPLE}) GROUP BY community"


def people(spark, d):
    return snapshot(spark, d).withColumnRenamed("attitude", "propagated_attitude").join(diversity(spark, d), "user_id").withColumn("community", F.col("user_id") % 5)


@query("a16_community_stats", COMM)
def community_stats(spark, d):
    return echo.community_stats(people(spark, d))


SCORE = f"""WITH p AS ({POLAR}), h AS ({HOMO}), c AS ({COMM}), v AS (SELECT avg(exposure_diversity) AS dv FROM ({DIV})), s AS (SELECT var_samp(avg_attitude) AS vs, avg(attitude_std) AS ss FROM c),
x AS (SELECT least(1, 0.4 * least(1, variance / 0.5) + 0.3 * least(1, bimodality / 0.7) + 0.3 * least(1, abs(inter_group_distance) / 1.5)) AS polarization_score, least(1, 0.5 * greatest(0, assortativity) + 0.5 * homophily_ratio) AS homophily_score, greatest(0, 1 - dv) AS low_diversity_score, CASE WHEN ss > 0 THEN least(1, vs / (ss + 0.1)) ELSE 0 END AS separation_score FROM p, h, v, s)
SELECT *, 0.3 * polarization_score + 0.3 * homophily_score + 0.2 * low_diversity_score + 0.2 * separation_score AS echo_chamber_score FROM x"""


@query("e1_e5_m20_echo_score", SCORE, "polarization_score homophily_score low_diversity_score separation_score echo_chamber_score", 4)
def echo_score(spark, d):
    return echo.echo_score(polarization(spark, d), homophily(spark, d), diversity(spark, d), community_stats(spark, d))


@query("e11_sensitivity", " UNION ALL ".join(f"SELECT '{k}' AS scheme, {w[0]} * polarization_score + {w[1]} * homophily_score + {w[2]} * low_diversity_score + {w[3]} * separation_score AS score FROM ({SCORE})" for k, w in echo.SCHEMES.items()), "score", 4)
def sensitivity(spark, d):
    return echo.sensitivity(echo_score(spark, d))


@query("e10_optimized_metrics", f"SELECT least(1, variance / 0.5) AS polarization, least(1, homophily_ratio) AS homophily, least(1, greatest(0, 1 - (SELECT avg(exposure_diversity) FROM ({DIV})))) AS low_diversity, least(1, coalesce((SELECT var_samp(avg_attitude) FROM ({COMM})), 0) / 0.3) AS separation FROM ({POLAR}), ({HOMO})", "polarization homophily low_diversity separation", 4)
def optimized(spark, d):
    return echo.optimized_metrics(polarization(spark, d), homophily(spark, d), diversity(spark, d), community_stats(spark, d))


@query("g11_modularity", f"WITH p AS ({PAIRS}), t AS (SELECT sum(weight) AS m FROM p), i AS (SELECT a % 5 AS c, sum(weight) AS w FROM p WHERE a % 5 = b % 5 GROUP BY 1), g AS (SELECT node % 5 AS c, sum(weight) AS d FROM ({SYM}) GROUP BY 1) SELECT sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)) AS modularity FROM g LEFT JOIN i USING (c), t", "modularity")
def modularity(spark, d):
    return graph.modularity(pairs(spark, d), nodes(spark, d).select(F.col("user_id").alias("node"), (F.col("user_id") % 5).alias("community")))


@query("a27_low_diversity_users", f"SELECT community, count(*) FILTER (WHERE exposure_diversity < 0.1) AS n_low, count(*) FILTER (WHERE exposure_diversity < 0.3) AS n_below, count(*) FILTER (WHERE exposure_diversity > 0.6) AS n_above FROM ({PEOPLE}) GROUP BY community")
def low_diversity(spark, d):
    return people(spark, d).groupBy("community").agg(F.count_if(F.col("exposure_diversity") < 0.1).alias("n_low"), F.count_if(F.col("exposure_diversity") < 0.3).alias("n_below"), F.count_if(F.col("exposure_diversity") > 0.6).alias("n_above"))


@query("o5_least_diverse_users", f"SELECT user_id, exposure_diversity FROM ({PEOPLE}) ORDER BY round(exposure_diversity, 9), user_id LIMIT 10", "exposure_diversity")
def least_diverse(spark, d):
    return people(spark, d).select("user_id", "exposure_diversity").orderBy(F.round("exposure_diversity", 9), "user_id").limit(10)


GROUPS = f"WITH g AS (SELECT node, count(*) AS degree FROM ({SYM}) GROUP BY node), q AS (SELECT quantile_cont(degree, 0.25) AS q1, quantile_cont(degree, 0.75) AS q3 FROM g) SELECT CASE WHEN degree >= q3 THEN 'Highly Connected' WHEN degree <= q1 THEN 'Isolated' ELSE 'Moderate' END AS grp, count(*) AS n, round(avg(attitude), 4) AS mean, round(var_samp(attitude), 4) AS var FROM g JOIN ({FINAL}) ON node = user_id, q GROUP BY grp"


@query("a17_m19_connectivity_variance", GROUPS)
def connectivity(spark, d):
    deg = degrees(spark, d)
    q = deg.agg(F.percentile("degree", 0.25).alias("q1"), F.percentile("degree", 0.75).alias("q3"))
    rows = deg.crossJoin(F.broadcast(q)).join(snapshot(spark, d).withColumnRenamed("user_id", "node"), "node")
    return rows.groupBy(scores.connectivity(F.col("degree"), F.col("q1"), F.col("q3")).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("attitude"), 4).alias("mean"), F.round(F.var_samp("attitude"), 4).alias("var"))


@query("e12_attitude_shift", f"SELECT user_id, arg_min(attitude_score, day * 1000000 + id) AS first, arg_max(attitude_score, day * 1000000 + id) AS last, arg_max(attitude_score, day * 1000000 + id) - arg_min(attitude_score, day * 1000000 + id) AS shift FROM ({ATT}) GROUP BY user_id", "first last shift")
def shift(spark, d):
    return echo.attitude_shift(attitudes(spark, d))


@query("e12_j17_snapshot_shift", f"WITH h AS ({HISTORY}) SELECT a.user_id, a.attitude AS start, b.attitude AS finish, b.attitude - a.attitude AS shift FROM h a JOIN h b ON a.user_id = b.user_id WHERE a.day = 0 AND b.day = 29", "start finish shift")
def snapshot_shift(spark, d):
    return echo.snapshot_shift(history(spark, d), 0, 29)


LOCAL = f"""WITH f AS ({FINAL}), v AS ({DIV}), nb AS (SELECT node, avg(attitude) AS m FROM ({SYM}) JOIN f ON neighbour = user_id GROUP BY node), c AS (SELECT avg(attitude) FILTER (WHERE attitude > 0) AS p, avg(attitude) FILTER (WHERE attitude < 0) AS n FROM f)
SELECT f.user_id, abs(attitude) AS local_polarization, 1 - abs(attitude - coalesce(m, 0)) / 2 AS local_homophily, 1 - exposure_diversity AS local_low_diversity, abs(attitude - coalesce(CASE WHEN attitude >= 0 THEN n ELSE p END, 0)) AS local_separation FROM f JOIN v ON f.user_id = v.user_id LEFT JOIN nb ON nb.node = f.user_id, c"""
_LOCAL = ["local_polarization", "local_homophily", "local_low_diversity", "local_separation"]


@query("e9_local_metrics", LOCAL, " ".join(_LOCAL))
def local_metrics(spark, d):
    return echo.local_metrics(people(spark, d), pairs(spark, d), snapshot(spark, d))


@query("e9_loading_weights")
def loading_weights(spark, d):
    w = echo.loading_weights(local_metrics(spark, d).na.drop(), _LOCAL, 2)
    return spark.createDataFrame(sorted(w.items()), "metric string, weight double")


_BOTH = f"SELECT 'original' AS attitudes, mean_attitude AS x FROM ({USERS}) UNION ALL SELECT 'propagated', attitude FROM ({FINAL})"


@query("e8_original_propagated", f"SELECT attitudes, {_POLAR} FROM ({MOMENTS.format(by='attitudes,', s=_BOTH, group='GROUP BY attitudes')})", "variance bimodality inter_group_distance")
def original_propagated(spark, d):
    users = echo.user_attitudes(attitudes(spark, d)).join(snapshot(spark, d).withColumnRenamed("attitude", "propagated_attitude"), "user_id", "left")
    return echo.compare_polarization(users)


SUBS = f"""WITH u AS (SELECT user_id, propagated_attitude AS x, exposure_diversity AS v, CASE WHEN user_id % 7 < 5 THEN 's' || user_id % 7 END AS part FROM ({PEOPLE})),
p AS (SELECT part, {_POLAR} FROM ({MOMENTS.format(by='part,', s='SELECT part, x FROM u WHERE part IS NOT NULL', group='GROUP BY part')})),
e AS (SELECT ua.part, ua.x AS xa, ub.x AS xb FROM ({PAIRS}) JOIN u ua ON a = ua.user_id JOIN u ub ON b = ub.user_id WHERE ua.part = ub.part),
h AS (SELECT part, coalesce(CASE WHEN var_pop(xa) > 0 THEN corr(xa, xb) END, 0) AS r, avg(CAST(xa * xb > 0 AS INT)) AS s FROM (SELECT part, xa, xb FROM e UNION ALL SELECT part, xb, xa FROM e) GROUP BY part),
z AS (SELECT part, count(*) AS size, avg(x) AS avg_attitude, avg(v) AS avg_diversity FROM u WHERE part IS NOT NULL GROUP BY part),
y AS (SELECT z.part AS sub_community, size, avg_attitude, avg_diversity, least(1, 0.4 * least(1, variance / 0.5) + 0.3 * least(1, bimodality / 0.7) + 0.3 * least(1, abs(inter_group_distance) / 1.5)) AS polarization, least(1, 0.5 * greatest(0, coalesce(r, 0)) + 0.5 * coalesce(s, 0)) AS homophily, greatest(0, 1 - avg_diversity) AS diversity, 0 AS separation FROM z JOIN p ON p.part = z.part LEFT JOIN h ON h.part = z.part)
SELECT *, 0.3 * polarization + 0.3 * homophily + 0.2 * diversity AS echo_chamber_score FROM y"""


@query("a26_sub_communities", SUBS, "avg_attitude avg_diversity polarization homophily diversity separation echo_chamber_score", 4)
def sub_community_scores(spark, d):
    users = people(spark, d).withColumn("sub_community", F.when(F.col("user_id") % 7 < 5, F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))))
    return echo.sub_community_scores(users, pairs(spark, d))


@query("e14_landscape")
def landscape(spark, d):
    return echo.landscape(local_metrics(spark, d), people(spark, d), _LOCAL)


@query("g10_communities")
def communities(spark, d):
    return graph.communities(nodes(spark, d), pairs(spark, d))


@query("g10_label_propagation")
def label_propagation(spark, d):
    return graph.label_propagation(nodes(spark, d), pairs(spark, d))


@query("g15_sub_communities")
def sub_communities(spark, d):
    within = nodes(spark, d).select(F.col("user_id").alias("node"), (F.col("user_id") % 5).cast("string").alias("part"))
    return graph.communities(nodes(spark, d), pairs(spark, d), within)


@query("g16_community_scores", f"SELECT community, {_POLAR} FROM ({MOMENTS.format(by='community,', s=f'SELECT community, propagated_attitude AS x FROM ({PEOPLE})', group='GROUP BY community')})", "variance bimodality inter_group_distance")
def community_scores(spark, d):
    return echo.polarization(people(spark, d).withColumnRenamed("propagated_attitude", "attitude"), ["community"])


@query("e6_echo_pipeline")
def echo_pipeline(spark, d):
    return echo.run(posts(spark, d)).echo_chamber_metrics


KEYWORDS = rf"""WITH w AS (SELECT user_id, id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(tweet, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS w FROM ({THREADS})),
k AS (SELECT user_id, count(*) AS n FROM w GROUP BY user_id HAVING count(*) >= 3), t AS (SELECT user_id, id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
tf AS (SELECT user_id, id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT user_id, term, df FROM (SELECT user_id, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY user_id, term) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, encode(term)) <= 1000),
x AS (SELECT tf.user_id, tf.id, tf.term, n, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS x FROM tf JOIN df ON df.user_id = tf.user_id AND df.term = tf.term JOIN k ON k.user_id = tf.user_id),
s AS (SELECT x.user_id, x.term, sum(x / norm) / max(n) AS score FROM x JOIN (SELECT user_id, id, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL) USING (user_id, id) GROUP BY x.user_id, x.term)
SELECT user_id, term, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, encode(term)) AS INT) AS rank FROM s QUALIFY rank <= 10"""


@query("e13_community_keywords", KEYWORDS, "score")
def keywords(spark, d):
    return echo.keywords(threads(spark, d), "user_id", "tweet", 1000, 10)


@query("h15_bimodality_vote")
def bimodality_vote(spark, d):
    """One array of all users' attitudes: bounded by users of one analysis, one row."""
    from ..kernels.special import vote

    return snapshot(spark, d).agg(F.array_sort(F.collect_list("attitude")).alias("x")).select(vote("x").alias("v")).select("v.*")


@query("h16_density_curve", f"SELECT CAST(g AS INT) AS g, avg(exp(-pow((-1 + 2 * g / CAST(199 AS DOUBLE) - attitude) / 0.1, 2) / 2)) / (0.1 * sqrt(2 * pi())) AS density FROM range(200) t(g), ({FINAL}) GROUP BY g", "density")
def density_curve(spark, d):
    grid = spark.range(200).select(F.col("id").cast("int").alias("g"), (-1 + 2 * F.col("id") / 199).alias("x"))
    rows = snapshot(spark, d).crossJoin(F.broadcast(grid))
    return rows.groupBy("g").agg((F.avg(F.exp(-F.pow((F.col("x") - F.col("attitude")) / 0.1, 2) / 2)) / (0.1 * F.sqrt(2 * F.pi()))).alias("density"))


CELLS = "(SELECT c_nationkey % 4 AS a, c_mktsegment AS b FROM customer)"
CHI = f"""WITH s AS (SELECT a, b, count(*) AS n FROM {CELLS} GROUP BY ALL), r AS (SELECT a, sum(n) AS ra FROM s GROUP BY a), c AS (SELECT b, sum(n) AS cb FROM s GROUP BY b), t AS (SELECT sum(n) AS t FROM s),
g AS (SELECT coalesce(n, 0) AS n, ra, cb, CAST(t AS DOUBLE) AS t, ra * cb / CAST(t AS DOUBLE) AS e FROM r CROSS JOIN c LEFT JOIN s USING (a, b) CROSS JOIN t), k AS (SELECT (SELECT count(*) FROM r) AS ka, (SELECT count(*) FROM c) AS kb, (SELECT sum(ra * (ra - 1) / CAST(2 AS DOUBLE)) FROM r) AS pa, (SELECT sum(cb * (cb - 1) / CAST(2 AS DOUBLE)) FROM c) AS pb, (SELECT -sum(ra / CAST(t AS DOUBLE) * ln(ra / CAST(t AS DOUBLE))) FROM r, t) AS ha, (SELECT -sum(cb / CAST(t AS DOUBLE) * ln(cb / CAST(t AS DOUBLE))) FROM c, t) AS hb)
SELECT sum(pow(n - e, 2) / e) AS chi2, max((ka - 1) * (kb - 1)) AS dof, (sum(n * (n - 1) / CAST(2 AS DOUBLE)) - max(pa * pb / (t * (t - 1) / 2))) / (max((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))) AS ari, sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (ra * cb)) ELSE 0 END) / max((ha + hb) / 2) AS nmi FROM g, k"""


@query("h8_h10_contingency_tests", CHI, "chi2 ari nmi")
def contingency(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("a"), F.col("c_mktsegment").alias("b"))
    return stats.contingency_tests(rows, "a", "b")


@query("h11_cluster_description", 'SELECT c_nationkey % 4 AS cluster, \'c_acctbal\' AS "column", count(c_acctbal) AS "count", round(avg(c_acctbal), 3) AS mean, round(stddev_samp(c_acctbal), 3) AS std, round(min(c_acctbal), 3) AS min, round(quantile_cont(c_acctbal, 0.25), 3) AS q25, round(quantile_cont(c_acctbal, 0.5), 3) AS q50, round(quantile_cont(c_acctbal, 0.75), 3) AS q75, round(max(c_acctbal), 3) AS max FROM customer GROUP BY 1', "mean std min q25 q50 q75 max", 2)
def cluster_description(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("cluster"), "c_acctbal")
    return stats.describe(rows, ["c_acctbal"], ["cluster"], 3)


@query("u9_scaled", "SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity, (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS l_tax FROM lineitem", "l_quantity l_tax")
def scaled(spark, d):
    return clustering.scale(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


FEAT = f"SELECT user_id AS id, avg(roberta_compound) AS mean_sent, coalesce(stddev_samp(stance_ensemble), 0) AS std_emo, avg(hour) AS mean_hour, avg(reaction_count) AS mean_reactions FROM ({POSTS}) GROUP BY user_id"
_F = ["mean_sent", "std_emo", "mean_hour", "mean_reactions"]


@query("u7_j11_agents", f"SELECT c_custkey AS id, mean_sent, std_emo, mean_hour, mean_reactions FROM customer LEFT JOIN ({FEAT}) f ON c_custkey = f.id", "mean_sent std_emo mean_hour mean_reactions")
def agents(spark, d):
    p = posts(spark, d)
    parts = [p.groupBy("user_id").agg(F.avg("roberta_compound").alias("mean_sent"), F.coalesce(F.stddev_samp("stance_ensemble"), F.lit(0.0)).alias("std_emo")), p.groupBy("user_id").agg(F.avg("hour").alias("mean_hour"), F.avg("reaction_count").alias("mean_reactions"))]
    return clustering.agents(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), parts, zero=())


@query("u10_principal_scores")
def principal(spark, d):
    return clustering.principal(clustering.scale(clustering.matrix(agents(spark, d), _F), _F), _F, share=0.8)


@query("u12_mixture")
def mixture(spark, d):
    return clustering.mixture(principal(spark, d), 4)


@query("u3_u4_density_clusters")
def density_clusters(spark, d):
    return clustering.density_clusters(stances(spark, d), 6, 2, "embedding")


@query("u11_u13_agent_clusters")
def agent_clusters(spark, d):
    return clustering.fit_agents(agents(spark, d), _F)


@query("u14_profile")
def profile(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 4).alias("Agent_Cluster"), F.col("c_mktsegment").alias("gender"))
    return clustering.profile(rows, "gender")["tests"]


@query("u15_trait_shares", "WITH t AS (SELECT c_nationkey % 5 AS cluster, c_mktsegment AS trait, count(*) AS n FROM customer WHERE c_nationkey % 5 <> 4 GROUP BY 1, 2) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE), 3) AS share FROM t")
def trait_shares(spark, d):
    return stats.crosstab(table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("cluster"), F.col("c_mktsegment").alias("trait")).where("cluster <> 4"), "cluster", "trait")
