"""Canonical relations and the checks that guard operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {"bigint": LongType(), "int": IntegerType(), "string": StringType()}


def _struct(columns: str) -> StructType:
    """A schema from ``name type`` pairs, made without a session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


#: Columns of the canonical tables.
POST = _struct("id bigint, tweet string, user_id bigint, comment_to bigint, thread_id bigint, round bigint, shared_from bigint, reaction_count bigint")
ROUNDS = _struct("id bigint, day int, hour int")
REACTIONS = _struct("id bigint, post_id bigint, user_id bigint, type string")
INTERESTS = _struct("iid bigint, interest string")
POST_TOPICS = _struct("id bigint, post_id bigint, topic_id bigint")
HASHTAGS = _struct("id bigint, hashtag string")
POST_HASHTAGS = _struct("id bigint, post_id bigint, hashtag_id bigint")
USERS = _struct("id bigint, ex string, oe string, co string, ag string, ne string, gender string, leaning string, age int, education_level string")

REQUIRED_TABLES = ("post", "rounds", "interests", "post_topics", "mentions", "reactions", "hashtags", "post_hashtags", "user_mgmt")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column; all later code knows one kind of missing value."""
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns))


def require_columns(df: DataFrame, columns) -> DataFrame:
    """The frame itself, or ValueError naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_tables(tables: dict, names=REQUIRED_TABLES) -> dict:
    """The tables themselves, or ValueError naming those that are missing."""
    missing = sorted(set(names) - set(tables))
    if missing:
        raise ValueError(f"missing required tables: {missing}")
    return tables


def keep_present(df: DataFrame, columns) -> DataFrame:
    """The given columns, in their order, as far as the frame has them."""
    return df.select(*(c for c in columns if c in df.columns))


def fill_zero(df: DataFrame, text_too: bool = False) -> DataFrame:
    """NULL to 0 in numeric columns, and to '0' in text columns if asked for."""
    out = df.na.fill(0)
    return out.na.fill("0") if text_too else out
