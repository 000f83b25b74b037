"""Scores and labels as columns; NULL stands for every missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of the emotion model, in its order.
EMOTIONS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")
#: Names that sentiment models use, and what they mean.
LABELS = {"label_0": "negative", "label_1": "neutral", "label_2": "positive", "neg": "negative", "neu": "neutral", "pos": "positive", "negative": "negative", "neutral": "neutral", "positive": "positive"}


def polarity_label(compound: Column, limit: float = 0.05) -> Column:
    return F.when(compound >= limit, "positive").when(compound <= -limit, "negative").when(compound.isNotNull(), "neutral")


def normal_label(label: Column) -> Column:
    """A model's label in plain words; unknown ones pass, lower-cased."""
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(label)), F.lower(label))


def first_best(names: Sequence[str], values: Sequence[Column]) -> tuple[Column, Column]:
    """Name and value of the largest; the first of equals; null values never win."""
    options = F.array(*(F.struct(v.cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(zip(names, values, strict=True))))
    best = F.array_max(F.filter(options, lambda x: x["v"].isNotNull()))
    return best["n"], best["v"]


def mean_known(values: Sequence[Column]) -> Column:
    """Mean of those that are not null."""
    known = F.filter(F.array(*(v.cast("double") for v in values)), lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda z, x: z + x) / F.nullif(F.size(known), F.lit(0))


def valence(e: dict[str, Column]) -> Column:
    return e["joy"] - mean_known([e[k] for k in ("sadness", "fear", "disgust", "anger")])


def arousal(e: dict[str, Column]) -> Column:
    return mean_known([e[k] for k in ("anger", "fear", "surprise", "joy")]) - mean_known([e[k] for k in ("sadness", "disgust", "neutral")])


def low_agreement(a: Column, b: Column, limit: float = 0.4) -> Column:
    return F.coalesce(F.abs(a - b) > limit, F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    """Between the limits; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def below(x: Column, limit: float) -> Column:
    return F.coalesce(x < limit, F.lit(False))


def thread_composite(cosine: Column, f1: Column, cross: Column) -> Column:
    """Mean of the three scores, the second rescaled from 0.8 to 1, not clipped."""
    return (cosine + (f1 - 0.8) / 0.2 + cross) / 3


def row_composite(cosine: Column, f1: Column, cross: Column) -> Column:
    """Mean of the three scores, the second rescaled from 0.7 to 1 and clipped."""
    return (cosine + clip((f1 - 0.7) / 0.3, 0.0, 1.0) + cross) / 3


def ensemble(similarity: Column, cross: Column) -> Column:
    return F.coalesce(0.6 * similarity + 0.4 * cross, similarity)


def attitude(stance: Column, sentiment: Column, beta: float = 0.5) -> Column:
    return clip(F.tanh(stance * (1 + beta * F.abs(sentiment))), -1.0, 1.0)


def arc_type(slope: Column, volatility: Column, n_changes: Column, slope_limit: float = 0.05, volatility_limit: float = 0.25) -> Column:
    """The first rule that fits: unknown, chaotic, one change of course, stable, direction."""
    return (
        F.when(slope.isNull() | volatility.isNull(), "unknown")
        .when(volatility > volatility_limit, "chaotic")
        .when((n_changes == 1) & (slope > 0), "V-shape")
        .when(n_changes == 1, "inverted-V")
        .when(F.abs(slope) < slope_limit, "stable")
        .when(slope > 0, "escalating")
        .otherwise("de-escalating")
    )


def band(x: Column) -> Column:
    return F.when(x < 0.3, "LOW").when(x < 0.6, "MODERATE").when(x.isNotNull(), "HIGH")


def connectivity(degree: Column, q1: Column, q3: Column) -> Column:
    """The upper quartile's rule overrides the lower's."""
    return F.when(degree >= q3, "Highly Connected").when(degree <= q1, "Isolated").otherwise("Moderate")


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to -1..1 from given limits; -1 where they are equal."""
    return F.when(x.isNotNull(), F.coalesce(-1 + 2 * (x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(-1.0)))
