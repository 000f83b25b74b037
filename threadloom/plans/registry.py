"""Named queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = DIGITS):
    """Register a function of ``(spark, sf_dir)`` under a name, with its SQL.

    ``rounded`` names floating columns, which both sides round alike (and turn -0 to 0): as the
    SQL engine does, the value is multiplied first and then rounded to a whole number. Rounding the
    decimal digits of a value instead differs where a value is about halfway.
    """
    columns, scale = rounded.split(), float(10**digits)

    def put(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double") * scale, 0) / scale + F.lit(0.0) for c in columns}) if columns else df

        QUERIES[name] = run
        if sql is not None:
            cast = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
            SQL[name] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if columns else sql
        return f

    return put
