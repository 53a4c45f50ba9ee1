"""Files that hold many models as arrays (HDF5), as a data source of Spark.

A file is read in ranges of models, each a partition of its own, whatever the file's size: a range reads its
models' classes and then only the points of the models wanted. Filters on ``class`` and ``model`` are pushed to
the ranges (with ``spark.sql.python.filterPushdown.enabled``); ``read_models`` also limits the models of a class,
by a scan of classes alone that tells which ranges to read at all.

The library is h5py or any module with its ``File`` (option ``library``). A file object of the store's file
system is handed to it, so files can be wherever pyarrow reads.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

MODELS = "path string, model long, class long, name string"
POINTS = f"{MODELS}, point_id long, x double, y double, z double, r double, g double, b double, part long"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
RANGE_BYTES = 64 << 20
BATCH_MODELS = 64  # models whose points are in memory at once


@dataclass
class Range(InputPartition):
    path: str
    part: int
    of: int  # ranges of the file; the number of models is known once it is opened
    models: tuple[int, ...] | None = None


class ModelFiles(DataSource):
    """Options: path (a file or folder), suffix, library, ranges (of a file; by its size if unset), only (JSON {path: models}),
    content (points, or models: classes alone), and the names of the arrays: points, parts, shape, names."""

    @classmethod
    def name(cls) -> str:
        return "model_files"

    def schema(self) -> str:
        return MODELS if self.options.get("content") == "models" else POINTS

    def reader(self, schema) -> DataSourceReader:
        return ModelReader(dict(self.options))


class ModelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, {}

    def option(self, name: str, default: str) -> str:
        return self.options.get(name) or default

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = f.attribute in (("class",), ("model",)) if isinstance(f, (EqualTo, In, IsNotNull)) else False
            if own and isinstance(f, IsNotNull):
                continue  # they never are null
            if own:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        fs, path = pafs.FileSystem.from_uri(self.options["path"] if "://" in self.options["path"] else f"file:{self.options['path']}")
        info = fs.get_file_info(path)
        found = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(self.option("suffix", ".h5"))]
        only = json.loads(self.options["only"]) if "only" in self.options else None
        out = []
        for i in sorted(found, key=lambda i: i.path):
            if only is None:
                n = int(self.option("ranges", str(max(1, -(-i.size // RANGE_BYTES)))))
                out += [Range(i.path, k, n) for k in range(n)]
            elif i.path in only:
                out.append(Range(i.path, 0, 1, tuple(only[i.path])))
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        fs, _ = pafs.FileSystem.from_uri(self.options["path"] if "://" in self.options["path"] else f"file:{self.options['path']}")
        library = importlib.import_module(self.option("library", "h5py"))
        with fs.open_input_file(partition.path) as raw, library.File(raw, "r") as f:
            shape = f[self.option("shape", "shape_label")]
            n = len(shape)
            lo, hi = n * partition.part // partition.of, n * (partition.part + 1) // partition.of
            kinds = np.asarray(shape[lo:hi]).reshape(-1).astype(np.int64)
            rows = np.arange(lo, hi)
            keep = np.ones(len(rows), bool)
            if partition.models is not None:
                keep &= np.isin(rows, partition.models)
            if "class" in self.wanted:
                keep &= np.isin(kinds, list(self.wanted["class"]))
            if "model" in self.wanted:
                keep &= np.isin(rows, list(self.wanted["model"]))
            rows, kinds = rows[keep], kinds[keep]
            for at in range(0, len(rows), BATCH_MODELS):
                yield from self.batch(f, partition.path, rows[at : at + BATCH_MODELS], kinds[at : at + BATCH_MODELS])

    def batch(self, f, path: str, rows: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = self.option("names", "shape_id")
        label = [x.decode() if isinstance(x, bytes) else str(x) for x in f[names][rows]] if names in f else [None] * len(rows)
        own = {"path": pa.array([path] * len(rows), pa.string()), "model": pa.array(rows, pa.int64()), "class": pa.array(kinds, pa.int64()), "name": pa.array(label, pa.string())}
        if self.options.get("content") == "models":
            yield pa.record_batch(own)
            return
        points, part = np.asarray(f[self.option("points", "points")][rows], float), np.asarray(f[self.option("parts", "points_part_labels")][rows])
        m = points.shape[1]
        flat = points.reshape(len(rows) * m, -1)
        # bytes, as the first colour above 1.5 in the batch's models tells; grey without colours
        rgb = flat[:, 3:6] / (255 if flat[:, 3:6].max(initial=0) > 1.5 else 1) if flat.shape[1] > 5 else np.full((len(flat), 3), 0.5)
        at = pa.array(np.repeat(np.arange(len(rows)), m))
        yield pa.record_batch({c: v.take(at) for c, v in own.items()} | {"point_id": pa.array(np.tile(np.arange(m), len(rows)), pa.int64())} | {c: pa.array(flat[:, i]) for i, c in enumerate("xyz")} | {c: pa.array(rgb[:, i]) for i, c in enumerate("rgb")} | {"part": pa.array(part.reshape(-1).astype(np.int64))})


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """All models' points, lazily; filters on class and model reach the files."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ModelFiles)
    reader = spark.read.format("model_files")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def read_models(spark: SparkSession, path: str, class_id: int | None = None, limit: int | None = None, **options) -> DataFrame:
    """The points of the first ``limit`` models (by path and place in it) of a class; None: of all."""
    points = scan(spark, path, **options)
    if class_id is not None:
        points = points.filter(F.col("class") == class_id)
    if limit is None:
        return points
    models = scan(spark, path, **options, content="models")
    models = models if class_id is None else models.filter(F.col("class") == class_id)
    only: dict[str, list[int]] = {}
    for r in models.select("path", "model").orderBy("path", "model").limit(limit).collect():  # ``limit`` rows
        only.setdefault(r["path"], []).append(r["model"])
    return scan(spark, path, **options, only=json.dumps(only))


def from_first(points: DataFrame, first: dict[int, int]) -> DataFrame:
    """Parts counted from the first id of their class (``first``: class -> its lowest part id); other classes stay."""
    shift = F.coalesce(*[F.when(F.col("class") == k, v) for k, v in first.items()], F.lit(0))
    return points.withColumn("part", F.col("part") - shift)
