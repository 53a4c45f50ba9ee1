"""name -> query and SQL twin; modules of this package fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, without negative zeros; numbers of rows and ranks as longs."""
    kinds = dict(df.dtypes)
    pick = {"double": lambda c: (F.round(F.col(c), 6) + 0.0).alias(c), "int": lambda c: F.col(c).cast("long").alias(c)}
    return df.select([pick[k](c) if (k := kinds[c]) in pick else F.col(c) for c in df.columns])


def r6(*items: str) -> str:
    """SQL select items ``expression AS name`` rounded likewise."""
    out = []
    for item in items:
        expression, _, name = item.rpartition(" AS ")
        out.append(f"round(({expression or name})::DOUBLE, 6) + 0.0 AS {name}")
    return ", ".join(out)
