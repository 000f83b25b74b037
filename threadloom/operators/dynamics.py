"""Trajectories within threads: turn features, trends, change points, arcs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, stats
from ..functions.scores import EMOTIONS
from ..kernels import changepoint
from ..schema import require_columns

SIGNALS = ("emotion_valence", "emotion_arousal")


@dataclass(frozen=True)
class Dynamics:
    """Signals and limits of the analysis."""

    signal: str = "roberta_compound"
    secondary: str = "vader_compound"
    emotion_signals: tuple[str, ...] = SIGNALS
    emotions: tuple[str, ...] = EMOTIONS
    min_turns: int = 3
    slope_limit: float = 0.05
    volatility_limit: float = 0.25
    penalty: float = 3.0
    sort: str = "round"

    @classmethod
    def from_config(cls, config) -> Dynamics:
        c = config.get("conversation", {})
        return cls(c.get("signal", cls.signal), c.get("secondary_signal", cls.secondary), min_turns=c.get("min_turns_dynamics", 3), slope_limit=c.get("slope_threshold", 0.05), volatility_limit=c.get("volatility_threshold", 0.25), penalty=float(c.get("changepoint_penalty", 3)))


def order_turns(df: DataFrame, d: Dynamics = Dynamics()) -> DataFrame:
    """Add turn, thread_len and turn_rel; rows without a thread go. Ties order by id, if there is one."""
    require_columns(df, ["thread_id", d.sort, d.signal])
    order = Window.partitionBy("thread_id").orderBy(d.sort, *(["id"] if "id" in df.columns else []))
    out = df.where("thread_id is not null").withColumn("turn", (F.row_number().over(order) - 1).cast("int"))
    out = out.withColumn("thread_len", F.count(F.lit(1)).over(Window.partitionBy("thread_id")).cast("int"))
    return out.withColumn("turn_rel", F.col("turn") / F.greatest(F.col("thread_len") - 1, F.lit(1)))


def turn_features(df: DataFrame, d: Dynamics = Dynamics()) -> DataFrame:
    """Change, rolling mean and deviation of each signal, and agreement of the two; one window, one shuffle."""
    w = Window.partitionBy("thread_id").orderBy("turn")
    near = w.rowsBetween(-2, 0)
    made = {}
    for s in dict.fromkeys([d.signal, d.secondary, *d.emotion_signals]):
        if s in df.columns:
            made[f"{s}_delta"] = F.col(s) - F.lag(s).over(w)
            made[f"{s}_roll3_mean"] = F.avg(s).over(near)
            made[f"{s}_roll3_std"] = F.stddev_samp(s).over(near)
    if {d.signal, d.secondary} <= set(df.columns):
        made["sentiment_agreement"] = F.abs(F.col(d.signal) - F.col(d.secondary))
        made["low_agreement"] = scores.low_agreement(F.col(d.signal), F.col(d.secondary))
    return df.withColumns(made)


def thread_trends(df: DataFrame, d: Dynamics = Dynamics()) -> DataFrame:
    """Per thread: length, mean, deviation, trend, start, end; over the series without nulls, re-indexed from 0."""
    known = df.withColumn("_x", F.col(d.signal).cast("double"))
    w = Window.partitionBy("thread_id").orderBy("turn")
    known = known.withColumn("_k", F.when(F.col("_x").isNotNull(), F.count("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double"))
    x, k = F.col("_x"), F.col("_k")
    out = known.groupBy("thread_id").agg(
        F.max("thread_len").alias("thread_len"), F.avg(x).alias("mean_sentiment"), F.stddev_pop(x).alias("std_sentiment"), stats.slope(x, k).alias("trend_slope"), stats.r_squared(x, k).alias("trend_r2"),
        F.min_by(x, k).alias("sentiment_start"), F.max_by(x, k).alias("sentiment_end"),
    )
    return out.withColumn("sentiment_delta", F.col("sentiment_end") - F.col("sentiment_start")).withColumn("short_thread", F.col("thread_len") < d.min_turns)


def change_points(df: DataFrame, d: Dynamics = Dynamics()) -> DataFrame:
    """``thread_id, changepoint_turns``: exact penalized segmentation of each thread's series.

    Positions count the series without nulls. A thread's values travel as one array,
    so the kernel runs on batches of threads, not on groups.
    """
    series = df.where(F.col(d.signal).isNotNull()).groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col(d.signal).cast("double").alias("x")))), lambda e: e["x"]).alias("series"))
    return series.select("thread_id", changepoint.column(d.penalty)(F.col("series")).alias("changepoint_turns"))


def thread_emotions(df: DataFrame, d: Dynamics = Dynamics()) -> DataFrame | None:
    """Mean of each emotion by thread, the dominant one, and their entropy; None without such columns."""
    names = [e for e in d.emotions if f"emotion_{e}" in df.columns]
    if not names:
        return None
    means = df.groupBy("thread_id").agg(*(F.avg(f"emotion_{e}").alias(f"emotion_{e}_mean") for e in names))
    values = [F.col(f"emotion_{e}_mean") for e in names]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    entropy = F.lit(0.0)
    for v in values:
        p = F.coalesce(v, F.lit(0.0)) / F.nullif(total, F.lit(0.0))
        entropy = entropy - p * F.log(p + 1e-9)
    return means.withColumn("dominant_emotion", scores.first_best(names, values)[0]).withColumn("emotion_entropy", entropy)


def thread_summaries(df: DataFrame, d: Dynamics = Dynamics(), with_changes: bool = True) -> DataFrame:
    """One row for each thread: trend, change points, arc and emotions.

    Threads shorter than ``min_turns`` have no trend, change points or known arc.
    ``with_changes=False`` leaves the change-point kernel out (arcs then know none).
    """
    out = thread_trends(df, d)
    long = ~F.col("short_thread")
    for c in ("trend_slope", "trend_r2"):
        out = out.withColumn(c, F.when(long, F.col(c)))
    if with_changes:
        out = out.join(change_points(df, d), "thread_id", "left").withColumn("changepoint_turns", F.when(long, F.coalesce("changepoint_turns", F.array().cast("array<int>"))))
        out = out.withColumn("n_changepoints", F.size("changepoint_turns")).withColumn("first_changepoint_turn", F.get("changepoint_turns", F.lit(0)))
    n = F.coalesce(F.col("n_changepoints"), F.lit(0)) if with_changes else F.lit(0)
    out = out.withColumn("arc_type", scores.arc_type(F.col("trend_slope"), F.col("std_sentiment"), n, d.slope_limit, d.volatility_limit))
    if (emotions := thread_emotions(df, d)) is not None:
        out = out.join(emotions, "thread_id", "left")
    extra = {f"mean_{s}": F.avg(s) for s in d.emotion_signals if s in df.columns}
    if "low_agreement" in df.columns:
        extra["mean_low_agreement"] = F.avg(F.col("low_agreement").cast("double"))
    if extra:
        out = out.join(df.groupBy("thread_id").agg(*(v.alias(k) for k, v in extra.items())), "thread_id", "left")
    return out


def run(df: DataFrame, d: Dynamics = Dynamics()) -> tuple[DataFrame, DataFrame]:
    """Turn-level features and thread summaries."""
    turns = turn_features(order_turns(df, d), d)
    return turns, thread_summaries(turns, d)


def position_curve(df: DataFrame, signal: str, bins: int = 10) -> DataFrame:
    """Mean and deviation of a signal by relative position in threads of three turns or more."""
    return stats.with_bins(df.where("thread_len >= 3"), "turn_rel", bins).groupBy("bin").agg(F.avg(signal).alias("mean"), F.stddev_samp(signal).alias("std"), F.count(signal).alias("n"))


def arc_emotions(summaries: DataFrame, names=EMOTIONS) -> DataFrame:
    """Mean emotion profile of each arc type."""
    return summaries.groupBy("arc_type").agg(*(F.avg(f"emotion_{e}_mean").alias(e) for e in names if f"emotion_{e}_mean" in summaries.columns))


def change_timing(summaries: DataFrame) -> DataFrame:
    """Relative position of each thread's first change point."""
    return summaries.where("first_changepoint_turn is not null").select("thread_id", (F.col("first_changepoint_turn") / F.greatest(F.col("thread_len") - 1, F.lit(1))).alias("cp_rel"))
