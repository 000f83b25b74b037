"""Queries: model backends, topic models, and whole stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..backends import models
from ..operators import clustering, coherence, eda, echo, sentiment, topics
from ..sources.driver_tables import table, threads
from ..stored import durable
from .registry import query
from .text import EMOJI_SQL, STOP


@query("x1_lexicon_sentiment")
def lexicon(spark, d):
    return sentiment.add_polarity(threads(spark, d).select("id", F.col("tweet").alias("clean_text"))).drop("clean_text")


@query("x3_x4_x11_sentiment_pipeline")
def pipeline(spark, d):
    return sentiment.run(threads(spark, d).select("id", "tweet"))


@query("x5_embeddings")
def embeddings(spark, d):
    return threads(spark, d).select("id", models.hashed_embedder(64)(F.col("tweet")).alias("v"))


@query("x5_x7_coherence_pipeline")
def coherence_pipeline(spark, d):
    return coherence.run(threads(spark, d), models.hashed_embedder(64), models.token_overlap_matcher, models.overlap_pair_scorer)[1]


@query("x8_x10_stance_pipeline")
def stance_pipeline(spark, d):
    rows = threads(spark, d).select("id", F.col("tweet").alias("clean_text"), "roberta_compound")
    out = echo.estimate_stance(rows, models.hashed_embedder(64, False), models.overlap_pair_scorer, 64)
    return out.select("id", "stance_similarity", "cross_encoder_score", "stance_ensemble")


def prepared(spark, d):
    return topics.prepare(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tweet"), "lang"), STOP)


@query("l3_l4_lda_words")
def lda_words(spark, d):
    return topics.fit_lda(prepared(spark, d)).top_words()


@query("l5_lda_topics")
def lda_topics(spark, d):
    return topics.fit_lda(prepared(spark, d)).assign().select("id", "lda_topic")


@query("l6_perplexity")
def perplexity(spark, d):
    return spark.createDataFrame([(topics.fit_lda(prepared(spark, d)).log_perplexity(),)], "log_perplexity double")


@query("l7_coherence")
def topic_coherence(spark, d):
    rows = durable(prepared(spark, d).select("lang", "tokens"), "prepared")
    return topics.coherence(rows, topics.class_terms(rows, "lang", top=10).select("topic", "term"))


@query("l8_embedding_topics")
def embedding_topics(spark, d):
    rows = threads(spark, d).select("id", "tweet")
    return topics.embedding_topics(topics.prepare(rows, STOP), models.hashed_embedder(64)).select("id", "bertopic_topic", "bertopic_topic_name", "length")


@query("l11_topic_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def topic_counts(spark, d):
    return eda.value_counts(table(spark, d, "documents"), "lang")


@query("l10_j10_topic_drift", "SELECT conv_id * 1000 + turn AS id, text AS tweet, turn AS round, length(text) AS length, CASE WHEN turn % 2 = 0 THEN 'positive' END AS sentiment FROM conversations")
def drift(spark, d):
    rows = threads(spark, d).select("id", "tweet", "round", F.length("tweet").cast("long").alias("length"))
    labels = threads(spark, d).where("round % 2 = 0").select("id", F.lit("positive").alias("roberta_label"))
    return topics.drift(rows, labels)


@query("u2_tweet_clusters")
def tweet_clusters(spark, d):
    return clustering.cluster_texts(threads(spark, d).select("id", "tweet"), models.hashed_embedder(64), 20, 3).select("id", "x", "y", "cluster")


@query("t4_t15_feature_table")
def features(spark, d):
    return clustering.extract_features(threads(spark, d).select("id", "user_id", "tweet"), stop_words=STOP).drop("tweet", "tokens", "clean_tweet", "cleaned_tweet")


@query("a9_a10_user_rates", r"SELECT user_id, avg(len(regexp_extract_all(text, '" + EMOJI_SQL + r"')) / CAST(length(text) AS DOUBLE)) AS mean_emoji_rate, avg(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) / CAST(length(text) AS DOUBLE)) AS mean_punctuation_rate FROM (SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS user_id, text FROM conversations) GROUP BY user_id", "mean_emoji_rate mean_punctuation_rate")
def user_rates(spark, d):
    from ..functions import text

    rows = threads(spark, d).withColumn("emoji_rate", text.emoji_rate(F.col("tweet"))).withColumn("punctuation_rate", text.punctuation_rate(F.col("tweet")))
    return clustering.user_rates(rows)


@query("a8_user_lengths", "SELECT user_id, avg(length(text)) AS mean_length, coalesce(stddev_samp(length(text)), 0) AS std_length FROM (SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS user_id, text FROM conversations) GROUP BY user_id", "mean_length std_length")
def user_lengths(spark, d):
    return clustering.user_lengths(threads(spark, d))
