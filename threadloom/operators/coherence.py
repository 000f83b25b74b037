"""Coherence of replies: pairing, scores by pluggable models, flags, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..schema import keep_present

#: Columns of the result, in order.
COLUMNS = (
    "id", "thread_id", "round", "user_id", "root_id", "root_tweet", "tweet", "cosine_similarity", "bs_precision", "bs_recall", "bs_f1", "cross_encoder_score",
    "flag_low_cosine", "flag_low_bertscore", "flag_low_crossenc", "flag_consensus",
)


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.25
    bertscore: float = 0.85
    cross_encoder: float = 0.50

    @classmethod
    def from_config(cls, config) -> Limits:
        c = config.get("coherence", {})
        return cls(c.get("cosine_low_threshold", 0.25), c.get("bertscore_low_threshold", 0.85), c.get("cross_encoder_low_threshold", 0.5))


def thread_root_pairs(df: DataFrame, text: str = "tweet") -> DataFrame:
    """Replies with the root of their thread. Roots have parent -1; if the whole table has
    none, each thread's first round is its root. Several roots give several pairs."""
    first = F.min("round").over(Window.partitionBy("thread_id"))
    any_root = df.agg((F.count_if(F.col("comment_to") == -1) > 0).alias("_any"))
    rows = df.where("thread_id is not null").withColumn("_first", first).crossJoin(F.broadcast(any_root))
    rows = rows.withColumn("_root", F.when(F.col("_any"), F.coalesce(F.col("comment_to") == -1, F.lit(False))).otherwise(F.col("round") == F.col("_first")))
    roots = rows.where("_root").select("thread_id", F.col("id").alias("root_id"), F.col(text).alias("root_tweet"))
    return rows.where("not _root").drop("_root", "_first", "_any").join(roots, "thread_id")


def direct_parent_pairs(df: DataFrame, text: str = "tweet") -> DataFrame:
    """Replies with the post that they answer; parents that are not in the table give no pair."""
    parents = df.select(F.col("id").alias("root_id"), F.col(text).alias("root_tweet"))
    return df.where("comment_to <> -1").join(parents, F.col("comment_to") == F.col("root_id"))


def pair(df: DataFrame, strategy: str = "thread_root", text: str = "tweet") -> DataFrame:
    if strategy not in ("thread_root", "direct_parent"):
        raise ValueError(f"no pairing strategy {strategy}")
    return (thread_root_pairs if strategy == "thread_root" else direct_parent_pairs)(df, text)


def score(pairs: DataFrame, embedder, matcher, cross_scorer, text: str = "tweet") -> DataFrame:
    """Cosine of embeddings, precision, recall and F1 of token matching, and the cross score squashed to 0..1."""
    m = matcher(F.col(text), F.col("root_tweet"))
    return (
        pairs.withColumn("_m", m)
        .withColumn("cosine_similarity", vectors.cosine(embedder(F.col(text)), embedder(F.col("root_tweet"))))
        .withColumn("bs_precision", F.col("_m.precision"))
        .withColumn("bs_recall", F.col("_m.recall"))
        .withColumn("bs_f1", F.col("_m.f1"))
        .drop("_m")
        .withColumn("cross_encoder_score", scores.sigmoid(cross_scorer(F.col("root_tweet"), F.col(text))))
    )


def flag(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Low flags; two or more make the consensus. Unknown scores raise none."""
    made = {
        "flag_low_cosine": scores.below(F.col("cosine_similarity"), limits.cosine),
        "flag_low_bertscore": scores.below(F.col("bs_f1"), limits.bertscore),
        "flag_low_crossenc": scores.below(F.col("cross_encoder_score"), limits.cross_encoder),
    }
    out = df.withColumns(made)
    return out.withColumn("flag_consensus", sum((F.col(c).cast("int") for c in made), F.lit(0)) >= 2)


def add_composite(df: DataFrame) -> DataFrame:
    return df.withColumn("composite", scores.row_composite(F.col("cosine_similarity"), F.col("bs_f1"), F.col("cross_encoder_score")))


def summarize(df: DataFrame) -> DataFrame:
    """By thread: replies, means, minima, share flagged, composite; least coherent first."""
    names = ("cosine_similarity", "bs_f1", "cross_encoder_score")
    out = df.groupBy("thread_id").agg(
        F.count("id").alias("n_replies"),
        *(F.avg(c).alias(f"mean_{c}") for c in names),
        *(F.min(c).alias(f"min_{c}") for c in names),
        F.avg(F.col("flag_consensus").cast("double")).alias("pct_flagged_consensus"),
    )
    return out.withColumn("composite_coherence", scores.thread_composite(*(F.col(f"mean_{c}") for c in names))).orderBy("composite_coherence", "thread_id")


def run(df: DataFrame, embedder, matcher, cross_scorer, strategy: str = "thread_root", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    rows = keep_present(flag(score(pair(df, strategy), embedder, matcher, cross_scorer), limits), COLUMNS)
    return rows, summarize(rows)


def decay(df: DataFrame, value: str, order: str = "round") -> DataFrame:
    """Mean, deviation and count of a score by round."""
    return df.groupBy(order).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def trend(decayed: DataFrame, order: str = "round", least: int = 3) -> DataFrame:
    """Slope and intercept of the means over rounds; null below three rounds."""
    enough = F.count("mean") >= least
    return decayed.agg(F.when(enough, F.regr_slope("mean", order)).alias("slope"), F.when(enough, F.regr_intercept("mean", order)).alias("intercept"))


def heatmap(df: DataFrame, value: str) -> DataFrame:
    """Long form of the thread by round table over all rounds, with each thread's mean for ordering."""
    cells = df.groupBy("thread_id", "round").agg(F.avg(value).alias("value"))
    return cells.withColumn("row_mean", F.avg("value").over(Window.partitionBy("thread_id")))
