"""Preparation joins and the aggregates behind exploratory figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def join_rounds(posts: DataFrame, rounds: DataFrame) -> DataFrame:
    """Posts with day and hour of their round; the small side is left to the optimizer's size statistics."""
    return posts.join(rounds.select(F.col("id").alias("_r"), "day", "hour"), F.col("round") == F.col("_r")).drop("_r")


def reaction_pivot(reactions: DataFrame, types: tuple[str, ...] = ("like", "dislike")) -> DataFrame:
    """Reactions of each type by post; the types are fixed, so no pass finds them."""
    return reactions.groupBy("post_id").agg(*(F.count_if(F.col("type") == t).alias(t) for t in types))


def add_reactions(posts: DataFrame, pivot: DataFrame) -> DataFrame:
    """Left join; posts without reactions have 0."""
    made = [c for c in pivot.columns if c != "post_id"]
    out = posts.join(pivot, posts["id"] == pivot["post_id"], "left").drop("post_id")
    return out.na.fill(0, made)


def topic_posts(posts: DataFrame, post_topics: DataFrame, interests: DataFrame) -> DataFrame:
    """Full outer join of posts and their topics, a row for each topic."""
    topics = post_topics.select("post_id", "topic_id").join(interests.select(F.col("iid").alias("topic_id"), F.col("interest").alias("topic")), "topic_id")
    return posts.join(topics, posts["id"] == topics["post_id"], "full")


def true_topics(topic_rows: DataFrame) -> DataFrame:
    """``post_id, true_topics`` as a sorted array; rows without a post are left out."""
    return topic_rows.where("post_id is not null").groupBy("post_id").agg(F.array_sort(F.collect_list("topic")).alias("true_topics"))


def post_hashtags(links: DataFrame, tags: DataFrame) -> DataFrame:
    return links.select("post_id", "hashtag_id").join(tags.select(F.col("id").alias("hashtag_id"), "hashtag"), "hashtag_id")


def prepare(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of the analysis from raw ones; lazy."""
    posts = add_reactions(join_rounds(tables["post"], tables["rounds"]), reaction_pivot(tables["reactions"]))
    topics = topic_posts(posts, tables["post_topics"], tables["interests"])
    found = true_topics(topics)
    return {
        "tweets": posts.join(found, posts["id"] == found["post_id"], "left").drop("post_id"),
        "topic_tweets": topics,
        "post_hashtags": post_hashtags(tables["post_hashtags"], tables["hashtags"]),
        "mentions": tables["mentions"],
        "reactions": tables["reactions"],
        "user_demo": tables["user_mgmt"],
    }


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return counts(df, column).orderBy(F.desc("n"), column)


def daily(df: DataFrame) -> DataFrame:
    """Volume and engagement by day in one aggregate."""
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("volume"), F.sum("reaction_count").alias("engagement"))


def spikes(daily_volume: DataFrame, days: int = 3, deviations: float = 3.0) -> DataFrame:
    """Rolling mean and deviation of volume and whether a day is above; days are few, one task orders them."""
    w = Window.orderBy("day").rowsBetween(-(days - 1), 0)
    out = daily_volume.withColumn("rolling_mean", F.avg("volume").over(w)).withColumn("rolling_std", F.coalesce(F.stddev_samp("volume").over(w), F.lit(0.0)))
    return out.withColumn("upper", F.col("rolling_mean") + deviations * F.col("rolling_std")).withColumn("spike", F.col("volume") > F.col("upper"))


def hourly(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Posts for each of 24 hours, 0 where there are none."""
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts(df, "hour"), "hour", "left").na.fill(0, ["n"])


def mean_length(df: DataFrame, text: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.length(text)).alias("mean_length"))


def longest(df: DataFrame, text: str, by: str) -> DataFrame:
    """Longest text by group, longest first."""
    return df.groupBy(by).agg(F.max(F.length(text)).alias("max_length")).orderBy(F.desc("max_length"), by)


def drill_down(df: DataFrame, by: str, order: str) -> DataFrame:
    """All rows of the group with most rows; the first of equals."""
    best = counts(df, by).orderBy(F.desc("n"), by).limit(1).select(F.col(by))
    return df.join(F.broadcast(best), by, "left_semi").orderBy(order)


def joined_text(df: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """A group's texts in order, separated by spaces."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.where(F.col(text).isNotNull()).groupBy(by).agg(F.array_join(pieces, " ").alias(text))


def first_rows(df: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def extremes(df: DataFrame, score: str, key: str, n: int = 25) -> DataFrame:
    """The n lowest and n highest rows, or all if there are no more than twice as many."""
    low = df.orderBy(F.col(score).asc(), key).limit(n)
    high = df.orderBy(F.col(score).desc(), F.col(key).desc()).limit(n)
    return low.unionByName(high).distinct()


def drop_artefact(df: DataFrame, key: str, values: tuple = ()) -> DataFrame:
    """Rows without those that a header left behind: rows whose key is null or one of ``values``, wherever they are."""
    known = F.col(key).isNotNull()
    return df.where(known & ~F.col(key).isin(*values) if values else known)


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two frames for the same keys; a key that one side lacks has nulls there."""
    return left.join(right, key, "full")


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The exact median, interpolated, and how many values it is of, by group."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
