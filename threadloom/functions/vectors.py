"""Vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda z, x: z + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is zero, null if one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def mean_vector(df: DataFrame, vector: str, out: str, by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Mean by dimension: one row, or one for each group. Zeros of ``size`` for an empty input without groups."""
    by = by or []
    flat = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("_k", "_x"))
    means = flat.groupBy(*by, "_k").agg(F.avg("_x").alias("_x"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda e: e["_x"])
    made = means.groupBy(*by).agg(entry.alias(out)) if by else means.agg(entry.alias(out))
    if not by and size:
        made = made.select(F.when(F.size(out) > 0, F.col(out)).otherwise(F.array_repeat(F.lit(0.0), size)).alias(out))
    return made


def mean_pair_cosine(df: DataFrame, by: str, vector: str, out: str = "cosine_similarity") -> DataFrame:
    """Mean cosine of all pairs of a group without forming pairs; 1 for a single vector.

    For unit vectors the sum over pairs follows from the sum of vectors:
    ``(|sum|^2 - m) / (n (n - 1))``, where m counts the vectors that are not zero.
    """
    rows = df.where(F.col(vector).isNotNull()).select(by, unit(F.col(vector)).alias("_u"))
    sums = rows.select(by, F.posexplode("_u").alias("_k", "_x")).groupBy(by, "_k").agg(F.sum("_x").alias("_s")).groupBy(by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(norm(F.col("_u")) > 0, 1).otherwise(0)).alias("_m"))
    n = F.col("_n")
    return counts.join(sums, by, "left").select(by, F.when(n == 1, F.lit(1.0)).otherwise((F.col("_q") - F.col("_m")) / F.nullif(n * (n - 1), F.lit(0))).alias(out))
