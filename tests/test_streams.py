from pyspark.sql import functions as F

from huepoint.queries import streams


def test_streams_leave_their_rows_in_files(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = streams.stream_distinct_keys(spark, str(tmp_path))
    assert got.inputFiles() and got.count() == 1000
    assert [tuple(r) for r in streams.stream_running_cells(spark, str(tmp_path)).select("event_type", "n").collect()] == [("view", 3000)]
    rows.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert streams.stream_distinct_keys(spark, f"{tmp_path}/none").count() == 0


def test_streams_return_their_own_columns(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert streams.stream_distinct_keys(spark, str(tmp_path)).columns == ["user_id", "event_type"]
    assert streams.stream_running_cells(spark, str(tmp_path)).columns == ["event_type", "n", "mean"]
