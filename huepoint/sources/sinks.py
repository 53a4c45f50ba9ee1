"""Tables, logs and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", kind: str = "parquet") -> None:
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def append_results(df: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends the rows whose key the log at ``path`` lacks; returns how many."""
    new = df.dropDuplicates(list(key))
    try:
        new = new.join(df.sparkSession.read.schema(df.schema).json(path).select(*key).distinct(), list(key), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def merged_log(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both logs' distinct records; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True).distinct()


def pending(cells: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells whose key is not in the log."""
    return cells.join(done.select(*key).distinct(), list(key), "left_anti")


def of_signature(checkpoint: DataFrame, config: dict, column: str = "config_hash") -> DataFrame:
    """The rows of a checkpoint that were made with this configuration; those without a signature aren't."""
    return checkpoint.filter(F.col(column) == config_hash(config))


def resumed(cells: DataFrame, checkpoint: DataFrame, key: Sequence[str], config: dict, column: str = "config_hash") -> tuple[DataFrame, DataFrame]:
    """What a checkpoint has of the right signature, and the cells that remain to be done with the signature they will have."""
    done = of_signature(checkpoint, config, column)
    return done, pending(cells, done, key).withColumn(column, F.lit(config_hash(config)))


def overridden(config: dict, flags: dict) -> dict:
    """``config`` with the flags that are set: None and False leave it as it is."""
    return config | {k: v for k, v in flags.items() if v is not None and v is not False}


#: The overlay's colours of the aligned cloud and of the reference.
ALIGNED, REFERENCE = (1.0, 0.0, 0.0), (0.6, 0.6, 0.6)


def overlay(aligned: DataFrame, reference: DataFrame, key: str = "object_id") -> DataFrame:
    """Both clouds of each object as one, each in its colour; part tells them apart (0 aligned, 1 reference). ``ply.write`` makes files of it."""
    own = lambda df, rgb, part: df.select(key, "point_id", "x", "y", "z", *[F.lit(v).alias(c) for v, c in zip(rgb, "rgb")], F.lit(part).cast("long").alias("part"))
    n = reference.groupBy(key).agg(F.max("point_id").alias("__last"))
    shifted = aligned.join(n, key, "left").withColumn("point_id", F.col("point_id") + F.coalesce("__last", F.lit(-1)) + 1)
    return own(reference, REFERENCE, 1).unionByName(own(shifted, ALIGNED, 0))


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes ``content`` to <folder>/<name> from the tasks that hold it; returns name, path, bytes. The folder must be one that all executors share."""
    import pyarrow.fs as pafs

    def put(batches):
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file:{folder}")
        for b in batches:
            rows = []
            for n, data in zip(b[name], b[content]):
                path = f"{base}/{n}"
                fs.create_dir(path.rsplit("/", 1)[0])
                with fs.open_output_stream(path) as out:
                    out.write(bytes(data))
                rows.append((n, path, len(data)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return files.select(name, content).mapInPandas(put, "name string, path string, bytes long")


def markdown(df: DataFrame, digits: int = 3, blank: str = "") -> str:
    """A small table as Markdown."""
    show = lambda v: blank if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[show(v) for v in r] for r in df.collect()]  # a report's table
    return "\n".join(["| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows]])


def best_flags(df: DataFrame, methods: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Adds best_<method>: whether it is the row's least."""
    least = F.least(*methods) if len(methods) > 1 else F.col(methods[0])
    return df.withColumns({f"best_{m}": F.coalesce(F.col(m) <= least + tolerance, F.lit(False)) for m in methods})


def html_report(df: DataFrame, methods: Sequence[str], digits: int = 2) -> str:
    from html import escape

    rows = best_flags(df, methods).collect()  # a report's table
    cell = lambda r, c: f"<td{' class="best"' if c in methods and r[f'best_{c}'] else ''}>{escape(f'{r[c]:.{digits}f}' if isinstance(r[c], float) else '' if r[c] is None else str(r[c]))}</td>"
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(cell(r, c) for c in df.columns) + '</tr>' for r in rows)}</table>"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def manifest(config: dict, **extra) -> str:
    return json.dumps({"config": config, "config_hash": config_hash(config), **extra}, sort_keys=True)


def folder_sizes(files: DataFrame) -> DataFrame:
    """``files(path, length)`` -> folder, files, mb."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / 1e6).alias("mb"))
