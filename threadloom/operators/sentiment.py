"""Sentiment and emotion columns from pluggable models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import models
from ..functions import scores
from ..functions.text import clean_text


def add_polarity(df: DataFrame, text: str = "clean_text", model: models.TextModel = models.lexicon_sentiment) -> DataFrame:
    """Lexicon scores and their label."""
    out = df.withColumn("_s", model(F.col(text)))
    out = out.withColumns({f"vader_{c}": F.col(f"_s.{c}") for c in ("neg", "neu", "pos", "compound")}).drop("_s")
    return out.withColumn("vader_label", scores.polarity_label(F.col("vader_compound")))


def _score_of(classes, label: str):
    return F.try_element_at(F.map_from_entries(F.transform(classes, lambda c: F.struct(scores.normal_label(c["label"]), c["score"]))), F.lit(label))


def _best(classes):
    """The class with the largest score, the first of equals."""
    rows = F.transform(classes, lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("k"), scores.normal_label(c["label"]).alias("label")))
    return F.array_max(rows)


def add_sentiment(df: DataFrame, text: str = "clean_text", model: models.TextModel = models.lexicon_classes) -> DataFrame:
    """Three-class scores, label and compound; null for blank text."""
    out = df.withColumn("_c", model(F.col(text)))
    made = {f"roberta_{short}": _score_of(F.col("_c"), name) for short, name in (("neg", "negative"), ("neu", "neutral"), ("pos", "positive"))}
    out = out.withColumns(made).withColumn("_b", _best(F.col("_c")))
    return out.withColumn("roberta_label", F.col("_b.label")).withColumn("roberta_score", F.col("_b.score")).withColumn("roberta_compound", F.col("roberta_pos") - F.col("roberta_neg")).drop("_c", "_b")


def emotion_columns(df: DataFrame, names=scores.EMOTIONS) -> DataFrame:
    """Label, score, valence and arousal from ``emotion_*`` probabilities."""
    e = {k: F.col(f"emotion_{k}") for k in names}
    label, best = scores.first_best(list(e), list(e.values()))
    return df.withColumns({"emotion_label": label, "emotion_score": best, "emotion_valence": scores.valence(e), "emotion_arousal": scores.arousal(e)})


def add_emotions(df: DataFrame, text: str = "clean_text", model: models.TextModel = models.cue_emotions, names=scores.EMOTIONS) -> DataFrame:
    """Seven probabilities and what follows from them; null for blank text."""
    out = df.withColumn("_c", model(F.col(text)))
    table = F.map_from_entries(F.transform("_c", lambda c: F.struct(F.lower(c["label"]), c["score"])))
    return emotion_columns(out.withColumns({f"emotion_{k}": F.try_element_at(table, F.lit(k)) for k in names}).drop("_c"), names)


def run(df: DataFrame, text: str = "tweet", polarity=models.lexicon_sentiment, sentiment=models.lexicon_classes, emotions=models.cue_emotions) -> DataFrame:
    """Clean text and all sentiment and emotion columns."""
    out = df.withColumn("clean_text", clean_text(F.col(text))).withColumn("is_empty", F.trim("clean_text") == "")
    return add_emotions(add_sentiment(add_polarity(out, model=polarity), model=sentiment), model=emotions)


def agreement_rate(df: DataFrame, a: str = "vader_label", b: str = "roberta_label") -> DataFrame:
    """Share of equal labels among rows that have both, and their number."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))
