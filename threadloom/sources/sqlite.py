"""SQLite tables, through JDBC where the driver is installed, else read in blocks.

The fallback is a single reader by nature (SQLite is one local file); it writes
Parquet in blocks, so that memory stays bounded and all later work is distributed.
"""

from __future__ import annotations

import contextlib
import sqlite3
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

BLOCK = 50_000
#: Arrow types by SQLite's column affinity, in the order its documentation tests them.
AFFINITY = (("INT", pa.int64()), ("CHAR", pa.string()), ("CLOB", pa.string()), ("TEXT", pa.string()), ("BLOB", pa.binary()), ("REAL", pa.float64()), ("FLOA", pa.float64()), ("DOUB", pa.float64()))


def _type(declared: str) -> pa.DataType:
    return next((t for word, t in AFFINITY if word in (declared or "").upper()), pa.string())


def _fit(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else str(value)
    if pa.types.is_floating(kind):
        return float(value)
    return int(value) if pa.types.is_integer(kind) else value


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_tables(path: str) -> list[str]:
    """Names of a database's tables."""
    with contextlib.closing(sqlite3.connect(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def table_info(path: str, table: str) -> list[tuple[str, str]]:
    """Columns and declared types of a table."""
    with contextlib.closing(sqlite3.connect(path)) as db:
        return [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]


def read_table(spark: SparkSession, path: str, table: str, folder: str | None = None) -> DataFrame:
    """All rows of a table. ``folder`` takes the Parquet copy; a cluster needs one that driver and executors share."""
    if folder is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("name a folder that driver and executors share")
    columns = table_info(path, table)
    if not columns:
        raise ValueError(f"{path} has no table {table}")
    schema = pa.schema([(name, _type(declared)) for name, declared in columns])
    out = f"{folder or tempfile.mkdtemp()}/{table}.parquet"
    with contextlib.closing(sqlite3.connect(path)) as db, pq.ParquetWriter(out, schema) as writer:
        rows = db.execute(f"SELECT * FROM {_quoted(table)}")
        while block := rows.fetchmany(BLOCK):
            writer.write_table(pa.table([pa.array([_fit(v, f.type) for v in c], f.type) for c, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema))
    return spark.read.parquet(out)


def read_all(spark: SparkSession, path: str, views: bool = False, folder: str | None = None) -> dict[str, DataFrame]:
    """Every table by name, optionally registered as temporary views."""
    found = {name: read_table(spark, path, name, folder) for name in list_tables(path)}
    if views:
        for name, df in found.items():
            df.createOrReplaceTempView(name)
    return found
