"""Statistics as aggregate expressions, guarded against constant and empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as covariance over variance, each by its count, as the SQL engine takes it."""
    known = F.when(y.isNotNull(), x)
    return F.covar_pop(known, y) / F.nullif(F.var_pop(known), F.lit(0.0))


def r_squared(y: Column, x: Column) -> Column:
    """Squared correlation; 0 for a constant series, null below two points."""
    return F.when(F.count(y) < 2, F.lit(None)).when(F.var_pop(y) == 0, F.lit(0.0)).otherwise(F.regr_r2(y, x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    cov = F.sum(a * b) - F.sum(a) * F.sum(b) / n
    va, vb = F.sum(a * a) - F.sum(a) * F.sum(a) / n, F.sum(b * b) - F.sum(b) * F.sum(b) / n
    return F.when((n > 1) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), cov / F.sqrt(va * vb))


def bimodality(x: Column) -> Column:
    """Sarle's coefficient; 0 for three values or fewer, null for constant ones."""
    n = F.count(x)
    small = 3 * (n - 1) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return F.when(n <= 3, F.lit(0.0)).otherwise((F.pow(F.skewness(x), 2) + 1) / (F.kurtosis(x) + small))


def group_distance(x: Column) -> Column:
    """Mean of the positive less mean of the negative; 0 if a side is empty."""
    return F.coalesce(F.avg(F.when(x > 0, x)) - F.avg(F.when(x < 0, x)), F.lit(0.0))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed bins over the data's range, from 0; the minimum is in the first."""
    width = (high - low) / bins
    return F.greatest(F.ceil((x - low) / F.nullif(width, F.lit(0.0))), F.lit(1)).cast("int") - 1


def with_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins over the whole frame's range (one row of limits, broadcast)."""
    limits = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return df.crossJoin(F.broadcast(limits)).withColumn(out, F.when(F.col(column).isNotNull(), F.least(equal_width_bin(F.col(column), F.col("_low"), F.col("_high"), bins), F.lit(bins - 1)))).drop("_low", "_high")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, n`` with left-closed bins over the range; the maximum is in the last."""
    limits = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    x = F.col(column)
    width = F.nullif((F.col("_high") - F.col("_low")) / bins, F.lit(0.0))
    return df.where(x.isNotNull()).crossJoin(F.broadcast(limits)).groupBy(F.coalesce(F.least(F.floor((x - F.col("_low")) / width), F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, in long form, exact."""
    by = by or []
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_c")).select(*by, "_c.column", "_c.x")
    x = F.col("x")
    made = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "q25": F.percentile(x, 0.25), "q50": F.percentile(x, 0.5), "q75": F.percentile(x, 0.75), "max": F.max(x)}
    shown = lambda k, v: (F.round(v, digits) if digits is not None and k != "count" else v).alias(k)
    return long.groupBy(*by, "column").agg(*(shown(k, v) for k, v in made.items()))


def null_audit(df: DataFrame) -> DataFrame:
    """``column, n_null, n_rows`` in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"), F.col("n_rows")) for c in df.columns))).alias("x")).select("x.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` for all ordered pairs, each over its own complete rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n, share`` in long form; ``share`` of the row, to 3 digits."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(a)), 3))


def contingency_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``chi2, dof, ari, nmi`` of two labellings, from their contingency table.

    Yates' correction applies with one degree of freedom. The table's margins come from
    windows over it, so the rows are read once; empty cells enter the statistic
    through the margins' products.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("ra")), cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    grid = rows.crossJoin(cols).join(cells, [a, b], "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0.0)))
    e = F.col("ra") * F.col("cb") / F.col("t")
    d = F.abs(F.col("n") - e)
    pairs = lambda x: x * (x - 1) / 2
    mi = F.when(F.col("n") > 0, F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).otherwise(0.0)
    core = grid.agg(F.sum(d * d / e).alias("plain"), F.sum(F.pow(d - F.least(F.lit(0.5), d), 2) / e).alias("yates"), F.sum(pairs(F.col("n"))).alias("both"), F.sum(mi).alias("mi"), F.first("t").alias("t"))
    share = lambda c: F.col(c) / F.col("t")
    one = lambda f, c, s: f.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias(f"k{s}"), F.sum(pairs(F.col(c))).alias(f"p{s}"), (-F.sum(share(c) * F.log(share(c)))).alias(f"h{s}"))
    out = core.crossJoin(one(rows, "ra", "a")).crossJoin(one(cols, "cb", "b"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    expected = F.col("pa") * F.col("pb") / F.nullif(pairs(F.col("t")), F.lit(0.0))
    ari = (F.col("both") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))
    nmi = F.col("mi") / F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0))
    return out.select(F.when(dof == 0, 0.0).when(dof == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), dof.alias("dof"), F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(nmi, F.lit(1.0)).alias("nmi"))
