"""The driver's tables as canonical relations, in Spark and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads of posts, with two deterministic signals."""
    n = F.length("text")
    wide = F.when(F.col("conv_id") % 5 == 0, 100.0).otherwise(800.0)
    signal = ((n * 37) % 201 - 100) / wide + 0.07 * (F.col("conv_id") % 3 - 1) * F.col("turn")
    clip = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    ident = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        ident.alias("id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("round"), F.col("text").alias("tweet"),
        F.when(F.col("turn") == 0, F.lit(-1)).otherwise(ident - 1).cast("long").alias("comment_to"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).cast("long").alias("user_id"),
        F.lit(-1).cast("long").alias("shared_from"), clip(signal).alias("roberta_compound"), clip(((n * 53) % 201 - 100) / 150.0).alias("vader_compound"),
    )


THREADS = """
SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, turn AS round, text AS tweet, CASE WHEN turn = 0 THEN -1 ELSE conv_id * 1000 + turn - 1 END AS comment_to,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS user_id, -1 AS shared_from,
  least(greatest(((length(text) * 37) % 201 - 100) / (CASE WHEN conv_id % 5 = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(800 AS DOUBLE) END) + CAST(0.07 AS DOUBLE) * (conv_id % 3 - 1) * turn, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)) AS roberta_compound,
  least(greatest(((length(text) * 53) % 201 - 100) / CAST(150 AS DOUBLE), CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)) AS vader_compound
FROM conversations"""

EMOTION_STEPS = {"anger": 11, "disgust": 13, "fear": 7, "joy": 5, "neutral": 3, "sadness": 17, "surprise": 19}


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts of users in time, with replies and shares between kept pairs of authors."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.col("event_type").alias("topic"), F.col("value"))
    who = e.select(F.col("id").alias("tid"), F.col("user_id").alias("tu"))
    kept = lambda u: ((F.col("user_id") % 5 == F.col(u) % 5) & (F.col("id") % 4 == 1)) | (F.col("id") % 80 == 1)
    r = who.select(F.col("tid").alias("rid"), F.col("tu").alias("ru"))
    s = who.select(F.col("tid").alias("sid"), F.col("tu").alias("su"))
    rows = e.join(r, F.col("id") - 1 == F.col("rid"), "left").join(s, F.col("id") - 13 == F.col("sid"), "left")
    raw = {k: (F.col("id") * step) % 23 + 1 for k, step in EMOTION_STEPS.items()}
    total = sum(raw.values(), F.lit(0))
    return rows.select(
        "id", "user_id", F.datediff(F.col("ts"), F.lit("2024-01-01")).alias("day"), F.hour("ts").alias("hour"), "topic", F.floor(F.col("id") / 8).cast("long").alias("thread_id"), (F.col("id") % 8).alias("round"),
        (F.col("id") % 7).alias("like"), (F.col("id") % 7 + F.col("id") % 3).alias("reaction_count"),
        F.when((F.col("id") % 8 != 0) & F.coalesce(kept("ru"), F.lit(False)), F.col("id") - 1).otherwise(F.lit(-1)).alias("comment_to"),
        F.when((F.col("id") % 5 == 0) & F.coalesce(kept("su"), F.lit(False)), F.col("id") - 13).otherwise(F.lit(-1)).alias("shared_from"),
        ((F.col("value") - 50) / (F.col("value") + 50)).alias("roberta_compound"), ((F.col("id") * 29) % 201 / 100.0 - 1).alias("stance_ensemble"), "value",
        *((v / total).alias(f"emotion_{k}") for k, v in raw.items()),
    )


_EMOTIONS = ", ".join(f"((e.event_id * {s}) % 23 + 1) / CAST({' + '.join(f'((e.event_id * {x}) % 23 + 1)' for x in EMOTION_STEPS.values())} AS DOUBLE) AS emotion_{k}" for k, s in EMOTION_STEPS.items())
POSTS = f"""
SELECT e.event_id AS id, e.user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) AS INT) AS day, CAST(hour(e.ts) AS INT) AS hour, e.event_type AS topic, CAST(floor(e.event_id / 8) AS BIGINT) AS thread_id, e.event_id % 8 AS round,
  e.event_id % 7 AS "like", e.event_id % 7 + e.event_id % 3 AS reaction_count,
  CASE WHEN e.event_id % 8 <> 0 AND coalesce((e.user_id % 5 = r.user_id % 5 AND e.event_id % 4 = 1) OR (e.event_id % 80 = 1), FALSE) THEN e.event_id - 1 ELSE -1 END AS comment_to,
  CASE WHEN e.event_id % 5 = 0 AND coalesce((e.user_id % 5 = s.user_id % 5 AND e.event_id % 4 = 1) OR (e.event_id % 80 = 1), FALSE) THEN e.event_id - 13 ELSE -1 END AS shared_from,
  (e.value - 50) / (e.value + 50) AS roberta_compound, (e.event_id * 29) % 201 / CAST(100 AS DOUBLE) - 1 AS stance_ensemble, e.value, {_EMOTIONS}
FROM events e LEFT JOIN events r ON e.event_id - 1 = r.event_id LEFT JOIN events s ON e.event_id - 13 = s.event_id"""


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a stance score by label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), ((F.col("label") - 4.5) / 4.5).alias("score"), (F.col("vec_id") % 37).alias("user_id"))


STANCES = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, (label - CAST(4.5 AS DOUBLE)) / CAST(4.5 AS DOUBLE) AS score, vec_id % 37 AS user_id FROM embeddings"
