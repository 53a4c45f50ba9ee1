"""Reading tables and keeping intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A few rows of the driver. As a list of tuples they would pass through a second set of Python workers, which stays beside Arrow's."""
    return spark.createDataFrame(pa.table(columns))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, local mode)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _FALLBACK.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="huepoint-"))
    folder = f"{base.rstrip('/')}/huepoint-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder is below the checkpoint folder and goes with it
        pass


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot from this share of all rows on, so there are at most so many hot keys.
HOT_KEYS = 10_000


def keyed_join(rows: DataFrame, values: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``values``, one row for each key, ``count`` telling how many rows have it (dropped).

    A key of more than total / HOT_KEYS rows would make one task large. There are at most HOT_KEYS of them, so
    their values are broadcast, which leaves the rows where they are; the others are joined by an exchange. No
    key column may be null. Both frames are read twice.
    """
    hot = F.col(count) > max(1, total // HOT_KEYS)
    known = values.filter(hot).drop(count)
    few = F.broadcast(known)
    return rows.join(few, on).unionByName(rows.join(F.broadcast(known.select(*on)), on, "left_anti").join(values.filter(~hot).drop(count), on))

