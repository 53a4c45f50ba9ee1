"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huepoint.plans import completion
from huepoint.queries import aggregates, colour, formats, geometry, joins, metrics, scoring, statistics, streams, windows  # noqa: F401  they register
from huepoint.queries._registry import QUERIES, SQL
from huepoint.views import cloud

ORACLE_SQL = SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occlude every object at three difficulties, colour the missing region by simple methods, score and average."""
    return completion.by_difficulty(completion.benchmark(cloud(spark, sf_dir), parts=4))
