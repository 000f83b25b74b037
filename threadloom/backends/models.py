"""Interfaces of the models the analysis calls, and offline defaults.

Every model is a function of columns, so any of them can be replaced: by a built-in
expression as here, or by ``classifier``/``encoder`` around a Python model that is
loaded once in each worker. The defaults are heuristics; they are deterministic and
need no files, and they are not the named pretrained models.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import let, split_words, tokenize
from ..kernels import ship

ship(__name__)

TextModel = Callable[[Column], Column]
PairModel = Callable[[Column, Column], Column]

#: Default word valences of the offline sentiment heuristic, -4 to 4.
VALENCE = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "happy": 2.7, "love": 3.2, "like": 1.5, "best": 3.2, "nice": 1.8, "wonderful": 2.7, "amazing": 2.8, "hope": 1.9, "help": 1.7, "win": 2.8, "agree": 1.5, "safe": 1.9, "trust": 2.3,
    "bad": -2.5, "terrible": -2.1, "awful": -2.0, "sad": -2.1, "hate": -2.7, "worst": -3.1, "angry": -2.3, "fear": -2.2, "wrong": -2.1, "problem": -1.7, "lose": -1.7, "death": -2.9, "threat": -2.4, "disagree": -1.6, "stupid": -2.4, "fail": -2.5,
}
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "absolutely": 0.293, "slightly": -0.293, "barely": -0.293, "somewhat": -0.293}
NEGATIONS = ("not", "no", "never", "none", "neither", "nor", "cannot", "can't", "don't", "doesn't", "isn't", "wasn't", "won't", "without")
NEGATED, DAMPED, NORMALIZER = -0.74, (1.0, 0.95, 0.9), 15.0


def _table(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


#: Further rules of the lexicon method: words in capitals, what "but" takes from before it and gives after it, and question marks.
CAPITALS, BUT, MOST_LOUD, LOUD = 0.733, (0.5, 1.5), 4, 0.292
QUESTIONS = {2: 0.36, 3: 0.54}
MANY_QUESTIONS = 0.96
EDGES = r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$"


def lexicon_sentiment(text: Column, valence: dict | None = None) -> Column:
    """Struct of neg, neu, pos, compound; null for null or empty text. For lexicons of thousands of words see ``lexicon_model``.

    A word's valence grows by capitals (if not all words are), by boosters among up to
    three words before it and is turned by a negation there; "but" halves what is before
    it and adds half to what is after. Exclamation and question marks add to the sum
    ``s``; compound is s / sqrt(s^2 + 15).
    """
    written = F.transform(split_words(text), lambda w: F.regexp_replace(w, EDGES, ""))
    lexicon, boosts = _table(valence or VALENCE), _table(BOOSTERS)
    negations = F.array(*(F.lit(w) for w in NEGATIONS))
    capital = lambda w: (w == F.upper(w)) & (w != F.lower(w))

    def valued(raw: Column, i: Column, all_raw: Column, low: Column, some: Column, at: Column) -> Column:
        base = F.coalesce(F.try_element_at(lexicon, F.get(low, i)), F.lit(0.0))
        sign = F.when(base < 0, -1.0).otherwise(1.0)
        out = base + F.when(some & capital(raw), sign * CAPITALS).otherwise(0.0)
        negated = F.lit(False)
        for k, damp in enumerate(DAMPED):
            before = F.get(low, i - (k + 1))
            out = out + sign * damp * F.coalesce(F.try_element_at(boosts, before), F.lit(0.0))
            negated = negated | F.coalesce(F.array_contains(negations, before), F.lit(False))
        out = F.when(base == 0, F.lit(0.0)).when(negated, out * NEGATED).otherwise(out)
        return out * F.when((at < 0) | (i == at), 1.0).when(i < at, BUT[0]).otherwise(BUT[1])

    def values(raw: Column) -> Column:
        low = F.transform(raw, lambda w: F.lower(w))
        some = F.exists(raw, capital) & ~F.forall(raw, capital)
        facts = F.struct(raw.alias("raw"), low.alias("low"), some.alias("some"), (F.array_position(low, "but").cast("int") - 1).alias("at"))
        return let(facts, lambda f: F.transform(f["raw"], lambda w, i: valued(w, i, f["raw"], f["low"], f["some"], f["at"])))

    def made(vs: Column) -> Column:
        add = lambda keep: F.aggregate(F.filter(vs, keep), F.lit(0.0), lambda z, v: z + v)
        asked = F.regexp_count(text, F.lit(r"\?"))
        questions = F.when(asked > 3, F.lit(MANY_QUESTIONS))
        for n, x in QUESTIONS.items():
            questions = questions.when(asked == n, F.lit(x))
        loud = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_LOUD)) * LOUD + questions.otherwise(0.0)
        total = add(lambda v: F.lit(True))
        total = F.when(total > 0, total + loud).when(total < 0, total - loud).otherwise(total)
        pos, neg = add(lambda v: v > 0) + F.size(F.filter(vs, lambda v: v > 0)), F.size(F.filter(vs, lambda v: v < 0)) - add(lambda v: v < 0)
        pos, neg = F.when(pos > neg, pos + loud).otherwise(pos), F.when(neg > pos, neg + loud).otherwise(neg)
        neu = F.size(F.filter(vs, lambda v: v == 0)).cast("double")
        all_ = F.nullif(pos + neg + neu, F.lit(0.0))
        part = lambda x: F.coalesce(F.round(x / all_, 3), F.lit(0.0))
        return F.struct(part(neg).alias("neg"), part(neu).alias("neu"), part(pos).alias("pos"), F.round(total / F.sqrt(total * total + NORMALIZER), 4).alias("compound"))

    return F.when(F.coalesce(text, F.lit("")) != "", let(let(written, values), made))


def score_words(text: str, valence: dict[str, float]) -> tuple[float, float, float, float]:
    """The rules of ``lexicon_sentiment`` for one text: neg, neu, pos and compound, not rounded."""
    edge = re.compile(r"^[^\w']+|[^\w']+$|^_+|_+$")
    written = [edge.sub("", w) for w in text.split()]
    low = [w.lower() for w in written]
    capital = [w == w.upper() and w != w.lower() for w in written]
    some = any(capital) and not all(capital)
    at = low.index("but") if "but" in low else None
    values = []
    for i, w in enumerate(low):
        base = valence.get(w, 0.0)
        value = 0.0
        if base:
            sign = -1.0 if base < 0 else 1.0
            near = [low[i - k] for k in (1, 2, 3) if i >= k]
            value = base + sign * (CAPITALS * (some and capital[i]) + sum(d * BOOSTERS.get(x, 0.0) for d, x in zip(DAMPED, near, strict=False)))
            value *= NEGATED if set(near) & set(NEGATIONS) else 1.0
            value *= 1.0 if at is None or i == at else BUT[i > at]
        values.append(value)
    asked = text.count("?")
    loud = min(text.count("!"), MOST_LOUD) * LOUD + (MANY_QUESTIONS if asked > 3 else QUESTIONS.get(asked, 0.0))
    total = sum(values)
    total += loud * ((total > 0) - (total < 0))
    pos, neg, neu = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0), sum(v == 0 for v in values)
    pos, neg = pos + loud * (pos > neg), neg + loud * (neg > pos)
    parts = pos + neg + neu or 1.0
    return neg / parts, neu / parts, pos / parts, total / (total * total + NORMALIZER) ** 0.5


def read_lexicon(path: str) -> dict[str, float]:
    """Word valences of a tab-separated lexicon file: word, mean valence, and columns that are ignored."""
    with open(path, encoding="utf-8") as f:
        rows = (line.rstrip("\n").split("\t") for line in f)
        return {r[0].lower(): float(r[1]) for r in rows if len(r) > 1}


def lexicon_model(valence: dict[str, float]) -> TextModel:
    """``lexicon_sentiment`` for lexicons of any size, in Arrow batches: words are looked up by hash, not along a list of the plan."""
    names = ("neg", "neu", "pos", "compound")

    @F.pandas_udf(StructType([StructField(c, DoubleType()) for c in names]))
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = [score_words(t, valence) if isinstance(t, str) and t else (None,) * 4 for t in texts]
        made = pd.DataFrame(rows, columns=names, dtype=float)
        made[["neg", "neu", "pos"]] = made[["neg", "neu", "pos"]].round(3)
        return made.assign(compound=made["compound"].round(4))

    return lambda text: F.when(F.coalesce(text, F.lit("")) != "", scored(text))


def lexicon_classes(text: Column) -> Column:
    """Three-class default: array of ``label, score`` from the lexicon's parts; null for blank text."""

    def rows(s: Column) -> Column:
        total = F.nullif(s["neg"] + s["neu"] + s["pos"], F.lit(0.0))
        return F.array(*(F.struct(F.lit(f"LABEL_{k}").alias("label"), F.coalesce(s[c] / total, F.lit(1 / 3)).alias("score")) for k, c in enumerate(("neg", "neu", "pos"))))

    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", let(lexicon_sentiment(text), rows))


#: Default cue words of the offline emotion heuristic.
EMOTION_CUES = {
    "anger": ("angry", "anger", "hate", "rage", "stupid"), "disgust": ("gross", "disgusting", "awful"), "fear": ("fear", "afraid", "threat", "scared", "death"), "joy": ("happy", "love", "great", "joy", "wonderful"),
    "neutral": (), "sadness": ("sad", "lose", "alone", "cry"), "surprise": ("wow", "surprise", "sudden", "amazing"),
}


def cue_emotions(text: Column) -> Column:
    """Seven-class default: smoothed shares of cue words, neutral by default; null for blank text."""
    tokens = tokenize(F.lower(text))

    def hits(cues: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(*cues))) if cues else F.lit(0)

    weight = {e: hits(c) + (0.5 if e == "neutral" else 0.1) for e, c in EMOTION_CUES.items()}
    total = sum(weight.values(), F.lit(0.0))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.array(*(F.struct(F.lit(e).alias("label"), (w / total).alias("score")) for e, w in weight.items())))


_TOKEN = re.compile(r"\w+|[^\w\s]")


def hashed_embedder(size: int = 64, normalized: bool = True) -> TextModel:
    """Signed hashed bag of words of ``size`` numbers, at length 1 if normalized."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(size)
            for w in _TOKEN.findall((text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            length = float(np.sqrt((v * v).sum()))
            out.append((v / length if normalized and length else v).tolist())
        return pd.Series(out)

    return embed


def _alike(a: list[str], b: list[str]) -> float:
    """Mean over a of the best match in b: 1 for equal tokens, 0.8 and 0.5 for prefixes of 4 and 2, else 0.2."""
    if not a or not b:
        return 0.0
    whole, four, two = set(b), {w[:4] for w in b}, {w[:2] for w in b}
    return sum(1.0 if w in whole else 0.8 if w[:4] in four else 0.5 if w[:2] in two else 0.2 for w in a) / len(a)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("precision", "recall", "f1")]))
def token_overlap_matcher(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Precision, recall and F1 by greedy best matches of tokens."""
    rows = []
    for x, y in zip(candidate, reference, strict=True):
        a, b = _TOKEN.findall((x or "").lower()), _TOKEN.findall((y or "").lower())
        p, r = _alike(a, b), _alike(b, a)
        rows.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def overlap_pair_scorer(first: Column, second: Column) -> Column:
    """Raw pair score: scaled Jaccard similarity of the texts' word sets."""
    a, b = F.array_distinct(tokenize(F.lower(first))), F.array_distinct(tokenize(F.lower(second)))
    return 6 * F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)) - 3


def classifier(load: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = 32) -> TextModel:
    """A column function around a Python classifier loaded once in each worker.

    The model takes a list of texts and returns, for each, its classes as ``label`` and
    ``score``. Blank and null texts are not sent and stay null.
    """

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                for i, classes in zip(part, model([texts.iloc[i] for i in part]), strict=True):
                    out[i] = [{"label": c["label"], "score": float(c["score"])} for c in classes]
            yield pd.Series(out, index=texts.index)

    return classify


def encoder(load: Callable[[], Callable[[list[str]], Sequence]], batch: int = 64) -> TextModel:
    """A column function around a Python sentence encoder loaded once in each worker."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = [t if isinstance(t, str) else "" for t in texts]
            yield pd.Series([[float(x) for x in v] for at in range(0, len(rows), batch) for v in model(rows[at : at + batch])], index=texts.index)

    return encode


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 64) -> PairModel:
    """A column function around a Python pair scorer loaded once in each worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for first, second in batches:
            rows = list(zip(first.fillna(""), second.fillna(""), strict=True))
            yield pd.Series([float(x) for at in range(0, len(rows), batch) for x in model(rows[at : at + batch])], index=first.index)

    return score
