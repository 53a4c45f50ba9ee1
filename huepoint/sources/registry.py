"""Named datasets and where they are looked for."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, dict], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.loaders: dict[str, tuple[Loader, tuple[str, ...]]] = {}

    def add(self, name: str, loader: Loader, categories: Sequence[str] = ()) -> None:
        self.loaders[name] = (loader, tuple(categories))

    def load(self, spark: SparkSession, name: str, **config) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"unknown dataset {name}; known: {', '.join(sorted(self.loaders))}")
        return self.loaders[name][0](spark, config)


def resolve_root(candidates: Sequence[str], variable: str = "HUEPOINT_DATA", default: str = "./data") -> str:
    """The variable's folder, else the first candidate that exists, else the default. URIs of stores count as existing."""
    if os.environ.get(variable):
        return os.environ[variable]
    return next((c for c in candidates if "://" in c or os.path.isdir(c)), default)


def good_and_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows read, and errors of files that couldn't be."""
    return decoded.filter("error is null").drop("error"), decoded.filter("error is not null").select("object_id", "error")


def error_tally(bad: DataFrame) -> DataFrame:
    return bad.groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def large_enough(df: DataFrame, least: int, key: str = "object_id") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("__n", n).filter(F.col("__n") >= least).drop("__n")


def label_remap(df: DataFrame, column: str = "part", key: Sequence[str] = ()) -> DataFrame:
    """Raw labels to 0, 1, 2 ... in order, over all objects of the key; labels are a small table."""
    labels = df.select(*key, column).distinct()
    named = labels.withColumn("__new", (F.dense_rank().over(Window.partitionBy(*key).orderBy(column)) - 1).cast("long"))
    return df.join(named, [*key, column]).withColumn(column, F.col("__new")).drop("__new")


def run_discovery(runs: DataFrame) -> DataFrame:
    """``runs(system, path)``: the first path of each system."""
    return runs.groupBy("system").agg(F.min("path").alias("path"))
