"""npz and (where h5py is installed) HDF5 clouds, archives of members."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from huepoint.sources import ply


def npz_points(data: bytes) -> pd.DataFrame:
    """xyz, rgb (0 to 1, or 0 to 255) and part of an npz file."""
    with np.load(io.BytesIO(data)) as z:
        names = set(z.files)
        xyz = z["xyz"] if "xyz" in names else z["points"][:, :3]
        rgb = z["rgb"] if "rgb" in names else z["points"][:, 3:6]
        part = z["part"] if "part" in names else np.zeros(len(xyz), np.int64)
    rgb = rgb.astype(float)
    if len(rgb) and rgb.max() > 1.5:
        rgb = rgb / 255
    return pd.DataFrame({"point_id": np.arange(len(xyz)), **{c: xyz[:, i].astype(float) for i, c in enumerate("xyz")}, **{c: rgb[:, i] for i, c in enumerate("rgb")}, "part": part.astype(np.int64)})


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    return ply.decoded(ply.files(spark, path, "*.npz"), npz_points)


def npz_bytes(pdf: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, xyz=pdf[list("xyz")].to_numpy(np.float32), rgb=pdf[list("rgb")].to_numpy(np.float32), part=pdf["part"].to_numpy(np.int16))
    return out.getvalue()


def npz_encoded(df: DataFrame, key: str = "object_id") -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(lambda k, pdf: pd.DataFrame([{key: k[0], "content": npz_bytes(pdf.sort_values("point_id"))}]), f"{key} {kind}, content binary")


def hdf5_points(data: bytes, points: str = "points", parts: str = "points_part_labels", shape: str = "shape_label", only: int | None = None, limit: int | None = None) -> pd.DataFrame:
    """Many models of one file, of class ``only`` and ``limit`` at most: ``model`` is its row in the file, point_id counts through those read.

    Only the rows wanted are read of the points.
    """
    import h5py  # optional

    with h5py.File(io.BytesIO(data), "r") as f:
        rows = np.arange(len(f[points])) if only is None else np.flatnonzero(f[shape][:] == only)
        rows = rows[:limit]
        xyz, part = f[points][rows], f[parts][rows]
    n, m = xyz.shape[:2]
    flat = xyz.reshape(n * m, -1).astype(float)
    rgb = flat[:, 3:6] / (255 if flat.shape[1] > 5 and n and flat[:, 3:6].max() > 1.5 else 1) if flat.shape[1] > 5 else np.full((n * m, 3), 0.5)
    return pd.DataFrame({"model": np.repeat(rows, m), "point_id": np.arange(n * m), **{c: flat[:, i] for i, c in enumerate("xyz")}, **{c: rgb[:, i] for i, c in enumerate("rgb")}, "part": part.reshape(-1).astype(np.int64)})


def read_hdf5(spark: SparkSession, path: str, **options) -> DataFrame:
    return ply.decoded(ply.files(spark, path, "*.h5"), lambda data: hdf5_points(data, **options), f"{ply.POINTS}, model long")


def members(archives: DataFrame, suffix: str = "") -> DataFrame:
    """object_id (archive), member, size, content of zip and tar files' members that end so; content is left out for suffix ''."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["object_id"], b["content"]):
                data, rows = io.BytesIO(content), []
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        rows = [(i.filename, i.file_size, z.read(i) if suffix else None) for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix)]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        rows = [(i.name, i.size, t.extractfile(i).read() if suffix else None) for i in t if i.isfile() and i.name.endswith(suffix)]
                yield pd.DataFrame([(name, *r) for r in rows], columns=["object_id", "member", "size", "content"])

    return archives.mapInPandas(fn, "object_id string, member string, size long, content binary")
