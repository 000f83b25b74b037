"""Operator 7: language by rank-order n-gram profiles.

A profile ranks a language's most frequent 1- to 3-grams of letters, words padded by
a space. A text is given the language whose profile has its most frequent n-grams
least out of place. Counts are summed over all training texts: each task sums its own
first, so what is shuffled is n-grams, not texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, ship

ship(__name__)


@dataclass(frozen=True)
class Profiles:
    """Languages (sorted), and for each n-gram of any profile its rank in each, or ``top`` if it has none."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    top: int


@dataclass(frozen=True)
class Settings:
    #: Ranks in a language's profile, and n-grams of a text that are compared.
    top: int = 400
    text_top: int = 300
    #: A pipeline rejects texts whose score is below this, and those without a language.
    least_score: float = 0.2
    #: Profiles are held by the driver, 12 bytes an n-gram: more languages than ISO 639 lists (7,900) are an error.
    most_languages: int = 10_000


_letters = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def spaced(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points, each word between single spaces; empty without letters."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letter_table()[a]
    if not letter.any():
        return np.empty(0, np.int64)
    after = np.concatenate([[False], letter[:-1]])
    a = np.where(letter, a, 32)[letter | after]
    return np.concatenate([[32], a] if a[-1] == 32 else [[32], a, [32]])


def grams(a: np.ndarray) -> np.ndarray:
    """1- to 3-grams of padded letters as integers; none spans two words."""
    one, two = a[a != 32], a[:-1] << 21 | a[1:]
    three = a[:-2] << 42 | two[1:]
    return np.concatenate([one, two, three[a[1:-1] != 32]]) if len(a) else a


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:top]]


def _counted(batches):
    import pyarrow as pa

    sums: dict[str, list] = {}
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}

    def settle(lang: str) -> None:
        found, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        size[lang] = 0
        if lang in sums:
            old, m = sums[lang]
            both, where = np.unique(np.concatenate([old, found]), return_inverse=True)
            found, n = both, np.bincount(where, np.concatenate([m, n])).astype(np.int64)
        sums[lang] = [found, n]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            waiting.setdefault(lang, []).append(grams(spaced(text.as_py())))
            size[lang] = size.get(lang, 0) + len(waiting[lang][-1])
            if size[lang] > 2_000_000:
                settle(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, (found, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def learn(rows: DataFrame, settings: Settings = Settings()) -> Profiles:
    """Profiles of ``lang, text`` rows; rows with a null language are ignored.

    Only the profiles (``top`` n-grams for each language) come to the driver.
    """
    counts = rows.where("lang is not null").select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # As row_number() <= top, Spark keeps each task's own best before it shuffles.
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counts.withColumn("place", order).where(F.col("place") <= settings.top).groupBy("lang").agg(F.collect_list(F.struct((F.col("place") - 1).alias("rank"), "gram")).alias("p"))
    got = best.limit(settings.most_languages + 1).collect()
    if len(got) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages")
    got = sorted(got, key=lambda r: r["lang"])
    all_grams = np.unique(np.array([x["gram"] for r in got for x in r["p"]], np.int64))
    ranks = np.full((len(got), len(all_grams)), settings.top, np.int32)
    for k, r in enumerate(got):
        for x in r["p"]:
            ranks[k, np.searchsorted(all_grams, x["gram"])] = x["rank"]
    return Profiles(tuple(r["lang"] for r in got), all_grams, ranks, settings.top)


def guess(text: str | None, profiles: Profiles, text_top: int) -> tuple[str, float]:
    """Language and score: 1 less the share of the largest possible out-of-place distance."""
    top = ranked(grams(spaced(text)), text_top)
    if not len(top) or not profiles.languages:
        return "und", 0.0
    at = np.minimum(np.searchsorted(profiles.grams, top), len(profiles.grams) - 1)
    known = profiles.grams[at] == top
    ranks = np.where(known, profiles.ranks[:, at], profiles.top)
    distance = np.where(ranks == profiles.top, profiles.top, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
    best = int(np.argmin(distance))
    return profiles.languages[best], 1.0 - float(distance[best]) / (profiles.top * len(top))


def predictor(profiles: Profiles, settings: Settings = Settings()):
    """A column function: text to a struct of ``lang_pred, score``."""
    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([guess(t, profiles, settings.text_top) for t in text], columns=["lang_pred", "score"])

    return predicted


def held_out(id_column: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """All rows with ``lang_pred`` and ``score``.

    Defined cases: null text or text without letters is ``und`` with score 0, as is any
    text if no language was learned; equal distances go to the first language by code
    point; columns of these names are replaced; no rows give no rows.
    """
    made = packed(docs, text=F.col(text_col)).withColumn("p", predictor(profiles, settings)(F.col("text")))
    return made.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")), F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: texts without a language, or far from every profile, go.

    Null and empty texts and those without letters go; texts of any length are read
    whole; if no row has a language, nothing can be learned and all go; repeated rows
    are judged alike; an empty table stays empty; columns of any name are kept as they are.
    """
    settings = Settings()
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), settings)
    made = packed(docs, text=F.col("text")).withColumn("p", predictor(profiles, settings)(F.col("text")))
    return made.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= settings.least_score)).select("row.*")
