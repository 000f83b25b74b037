"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage reads what the one before wrote and keeps the columns of ``documents``,
but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import dedup, langid, mixing, packing, quality
from threadloom.llm.common import settled

STAGES = [
    ("quality rules", quality.stage),
    ("language ID", langid.stage),
    ("near-dedup", dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Language profiles, MinHash and packing have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
