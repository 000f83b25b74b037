"""Helpers shared by the operators: durable tables, size-checked joins, words."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import _delete, _own_folders, durable, own_path, shared_folder  # noqa: F401

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"

#: A join side is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 8 << 20

def ship(module_name: str) -> None:
    """Send a module's functions to executors by value, so that they need not have this package."""
    register_pickle_by_value(sys.modules[module_name])


def settled(make, name: str) -> DataFrame:
    """The durable result of ``make()``; the tables that it was made from are deleted."""
    before = len(_own_folders)
    out = durable(make(), name)
    for spark, path in _own_folders[before:-1]:
        _delete(spark, path)
    del _own_folders[before:-1]
    return out


def _value_bytes(name: str, kind: T.DataType) -> Column:
    """Bytes that a column's values take, more or less; nested arrays and structs are measured as JSON would be."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        size = 8 * F.array_size(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(c))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(0)) + 16


def measured_bytes(df: DataFrame) -> int:
    """The bytes of a stored table's values, summed over all rows."""
    size = F.lit(16).cast("long")
    for f in df.schema:
        size = size + _value_bytes(f.name, f.dataType)
    return df.agg(F.sum(size).alias("b")).first()["b"] or 0


def measured_join(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int | None = None) -> DataFrame:
    """Join a stored side: broadcast if its measured bytes are below ``limit``, else by shuffle.

    ``right`` must be cheap to read twice (a ``durable`` table). Beyond the limit, the
    plan is a sort-merge join, whose skewed keys adaptive execution splits.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if measured_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a table's files, or the optimizer's estimate: nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def packed(docs: DataFrame, keep: tuple[str, ...] | None = None, **columns: Column) -> DataFrame:
    """Each row (or its columns ``keep``) as a struct ``row``, beside the columns given: no name of a table clashes with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row"), *(c.alias(n) for n, c in columns.items()))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sql_literal(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
