"""Result logs as streams: ingest without duplicates, and running means of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from huepoint.sources.textual import RESULT

KEY = ("dataset", "category", "difficulty", "model")


def log_stream(spark: SparkSession, folder: str, schema: str = RESULT) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def deduplicated(stream: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The first record of each key. The keys are the state: a log has one for each benchmark cell and model."""
    return stream.dropDuplicates(list(key))


def ingest(stream: DataFrame, table: str, checkpoint: str, key: Sequence[str] = KEY) -> StreamingQuery:
    """Appends new records to a Parquet table; a batch that is run again is not written twice."""

    def put(batch: DataFrame, epoch: int) -> None:
        # a rerun overwrites the partition of its epoch
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(table)

    return deduplicated(stream, key).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_cells(stream: DataFrame, cell: Sequence[str] = ("category", "difficulty"), value: str = "chamfer_out") -> DataFrame:
    """n and mean so far of each cell (for complete or update mode)."""
    return stream.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
