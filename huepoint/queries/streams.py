"""Streams over the event files, run to their end."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from huepoint.queries._registry import query, r6, six
from huepoint.store import shared_folder
from huepoint.streaming import results


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has put out by its end, from a table in the shared folder; of complete output the last epoch's."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, epoch: int) -> None:
        # a rerun overwrites its epoch
        batch.write.mode("overwrite").parquet(folder + ("/t" if mode == "complete" else f"/t/epoch={epoch}"))

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.parquet(f"{folder}/t").select(*stream.columns)  # without the epochs' own column
    except AnalysisException:  # no batch: no input
        return spark.createDataFrame([], stream.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream's path must not be a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")


@query("stream_running_cells", f"SELECT event_type, count(*) AS n, {r6('avg(value) AS mean')} FROM events GROUP BY 1")
def stream_running_cells(spark, sf_dir):
    return six(_drained(results.running_cells(_events(spark, sf_dir), ("event_type",), "value"), "complete"))


@query("stream_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct_keys(spark, sf_dir):
    return _drained(results.deduplicated(_events(spark, sf_dir).select("user_id", "event_type"), ("user_id", "event_type")), "append")
