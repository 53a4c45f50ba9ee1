"""Tables kept once in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver ends; a temporary one only where that is unset in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _FALLBACK.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="huepoint-"))
    folder = f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}"
    atexit.register(removed, spark, folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder is below the checkpoint folder and goes with it
        pass


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what is used again isn't worked out again, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
