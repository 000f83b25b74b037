"""CSV, Parquet and JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """CSV with a header and quoted line breaks; without a schema its types are inferred."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", index: str | None = None) -> str:
    """Write a frame, nested columns as JSON text in CSV, optionally with an id column; returns the path."""
    if index:
        df = df.select(F.monotonically_increasing_id().alias(index), "*")
    if fmt == "csv":
        nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
        df = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return path


def save_twice(df: DataFrame, paths: Sequence[str], fmt: str = "csv") -> list[str]:
    """The same metrics table in several folders."""
    return [save(df, p, fmt) for p in paths]


def as_json_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with ``json``: a key-to-value object over all rows (for small tables, as of communities)."""
    pair = F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    return df.where(F.col(key).isNotNull()).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("json"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whichever file system its scheme names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: Sequence[str], made_by: str) -> str:
    """The first path that exists; FileNotFoundError names the step that makes it."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists; run {made_by} first")
