"""Places and running sums over whole tables, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.store import kept

def earlier(df: DataFrame, value: Column, order: Sequence[str], out: str, ranges: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows (of the same key, which isn't null) that sort before, ascending; 0 for the first.

    Rows are dealt to ranges of key and ``order`` and kept once, so that every use sees the same ranges; whatever
    the columns' type and however long their common beginnings are. Windows run inside a range, and the sums of
    the ranges, ``ranges`` rows at most (None: as many as shuffles have partitions) and one more for each key, are
    added up beside them; so a key of any size is spread over tasks. Rows equal in all of it share a range. Nulls sort first.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.withColumn("__value", value).repartitionByRange(ranges, *key, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*key, "__range").agg(F.sum("__value").alias("__sum")).select(*key, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(base if key else F.broadcast(base), [*key, "__range"])
    return joined.select(*df.columns, (F.col("__base") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).alias(out))


def placed(df: DataFrame, order: Sequence[str], out: str, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: each row's place from 0, in its group or, without a key, in the table."""
    if not key:
        return earlier(df, F.lit(1), order, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def counted(df: DataFrame, out: str, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: the rows of its group or, without a key, of the table."""
    n = F.count(F.lit(1))
    return df.withColumn(out, n.over(Window.partitionBy(*key))) if key else df.crossJoin(F.broadcast(df.agg(n.alias(out))))  # one row


def value_counts(df: DataFrame, column: str, key: Sequence[str] = (), out: str = "n", before: str = "before") -> DataFrame:
    """key, column, ``out`` rows of each value and ``before`` rows of smaller ones."""
    by = df.groupBy(*key, column).agg(F.count(F.lit(1)).alias(out))
    if not key:
        return earlier(by, F.col(out), [column], before)
    w = Window.partitionBy(*key).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return by.withColumn(before, F.coalesce(F.sum(out).over(w), F.lit(0)))
