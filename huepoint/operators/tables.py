"""Small relational helpers: declared columns, restrictions, names, overlaps, banks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint.functions.maths import hashed, uniform


def declared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that there are, in the order declared."""
    return df.select([c for c in columns if c in df.columns])


def restricted(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose value is one of the names, whatever the case; all rows for no names."""
    return df.filter(F.lower(column).isin([n.lower() for n in names])) if names else df


def named(df: DataFrame, id_: str, names: DataFrame, out: str = "name", prefix: str = "part") -> DataFrame:
    """``names(id_, name)``: each row's name, or the prefix with its number."""
    n = names.select(id_, F.col("name").alias("__name"))
    return df.join(n, id_, "left").withColumn(out, F.coalesce("__name", F.concat(F.lit(prefix), F.col(id_).cast("string")))).drop("__name")


def overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of the columns in both."""
    return a.select(*columns).intersect(b.select(*columns))


def assert_disjoint(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> None:
    if rows := overlap(a, b, columns).take(3):
        raise AssertionError(f"in both: {rows}")


def validation_bank(objects: DataFrame, steps: int, strata: int, id_: str = "object_id", seed: int = 0) -> DataFrame:
    """id, stratum, t, noise_seed: a time from each of evenly wide strata for every object, the same in every run."""
    rows = objects.select(id_).distinct().withColumn("stratum", F.explode(F.sequence(F.lit(0), F.lit(strata - 1))))
    width = steps / strata
    return rows.select(id_, "stratum", F.floor((F.col("stratum") + uniform(id_, "stratum", seed=seed)) * width).alias("t"), hashed(id_, "stratum", seed=seed + 1).alias("noise_seed"))


def summary(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n, and mean and population spread of each value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def reindexed(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """A row (or all rows) of each declared value with its ``place``, nulls where ``df`` has none; other values go."""
    kind = df.schema[column].dataType
    declared = F.explode(F.array(*[F.struct(F.lit(v).cast(kind).alias(column), F.lit(i).alias("place")) for i, v in enumerate(order)])).alias("x")
    return df.sparkSession.range(1).select(declared).select("x.*").join(df, column, "left")
