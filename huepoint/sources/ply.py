"""PLY point clouds: ascii and binary vertex blocks, read and written."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huepoint.functions.maths import stem_of

#: Names of PLY's types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
LABELS = ("label", "part", "seg", "part_label", "scalar_label", "class")
POINTS = "object_id string, point_id long, x double, y double, z double, r double, g double, b double, part long, error string"


class PlyError(ValueError):
    pass


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Columns of the vertex element. Raises PlyError for what it can't read."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise PlyError("no whole PLY header")
    body = data.index(b"\n", end) + 1 if b"\n" in data[end:] else len(data)
    fmt, count, fields, element, before = "", 0, [], "", 0
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            if element == "vertex":
                count = int(w[2])
            elif not count and int(w[2]):
                before = 1
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list":
                raise PlyError("list property of vertices")
            if w[1] not in TYPES:
                raise PlyError(f"type {w[1]}")
            fields.append((w[2], TYPES[w[1]]))
    if before:
        raise PlyError("elements before the vertices")
    if fmt == "ascii":
        rows = data[body:].split()
        if len(rows) < count * len(fields):
            raise PlyError("fewer vertices than announced")
        table = np.array(rows[: count * len(fields)], float).reshape(count, len(fields)) if fields else np.empty((count, 0))
        return {n: table[:, i].astype(t) for i, (n, t) in enumerate(fields)}
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(fmt)
    if not order:
        raise PlyError(f"format {fmt or 'missing'}")
    kind = np.dtype([(n, order + t) for n, t in fields])
    if len(data) - body < count * kind.itemsize:
        raise PlyError("fewer vertices than announced")
    block = np.frombuffer(data, kind, count, body)
    return {n: block[n].astype(block[n].dtype.newbyteorder("=")) for n, _ in fields}


def colours(cols: dict[str, np.ndarray], scale: str = "type", missing: float | None = 0.5) -> np.ndarray:
    """n x 3 in 0 to 1. scale: by integer ``type``, or ``auto`` if any value exceeds 1.5. missing: value, or None to refuse."""
    n = len(next(iter(cols.values()), ()))
    names = next((x for x in (("red", "green", "blue"), ("r", "g", "b")) if all(c in cols for c in x)), None)
    if not names:
        if missing is None:
            raise PlyError("no colours")
        return np.full((n, 3), missing)
    rgb = np.stack([cols[c] for c in names], 1)
    whole = rgb.astype(float)
    if rgb.dtype.kind in "iu" if scale == "type" else len(whole) and whole.max() > 1.5:
        whole /= 255 if rgb.dtype.itemsize == 1 or scale != "type" else np.iinfo(rgb.dtype).max
    return whole


def points(data: bytes, scale: str = "type", missing: float | None = 0.5, labels: Sequence[str] = LABELS) -> pd.DataFrame:
    cols = parse(data)
    if not all(c in cols for c in "xyz"):
        raise PlyError("no coordinates")
    rgb = colours(cols, scale, missing)
    label = next((c for c in labels if c in cols), None)
    return pd.DataFrame({"point_id": np.arange(len(rgb)), **{c: cols[c].astype(float) for c in "xyz"}, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "part": cols[label].astype(np.int64) if label else 0})


def decoded(files: DataFrame, decode, schema: str = POINTS) -> DataFrame:
    """Rows of ``decode(bytes)`` for binary files, with object_id; a file that can't be read gives one row with its error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for object_id, content in zip(b["object_id"], b["content"]):
                try:
                    out = decode(bytes(content)).assign(object_id=object_id, error=None)
                except Exception as e:  # one bad file must not end the job; its error is kept
                    out = pd.DataFrame([{"object_id": object_id, "error": f"{type(e).__name__}: {e}"}])
                yield out.reindex(columns=names)

    return files.mapInPandas(fn, schema)


def files(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    """object_id (the file's name without suffix), path, content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(stem_of(F.col("path")).alias("object_id"), "path", "content")


def read(spark: SparkSession, path: str, scale: str = "type", missing: float | None = 0.5, labels: Sequence[str] = LABELS) -> DataFrame:
    return decoded(files(spark, path, "*.ply"), lambda data: points(data, scale, missing, labels))


def encode(pdf: pd.DataFrame, label: bool = True, big_endian: bool = False) -> bytes:
    """Binary PLY with uchar colours (clipped) and int labels."""
    o = ">" if big_endian else "<"
    kind = np.dtype([*[(c, o + "f4") for c in "xyz"], *[(c, "u1") for c in ("red", "green", "blue")], *([("label", o + "i4")] if label else [])])
    rows = np.empty(len(pdf), kind)
    for c in "xyz":
        rows[c] = pdf[c]
    for c, s in zip(("red", "green", "blue"), "rgb"):
        rows[c] = np.rint(np.clip(pdf[s].to_numpy(float), 0, 1) * 255)
    if label:
        rows["label"] = pdf["part"]
    names = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + ("property int label\n" if label else "")
    return f"ply\nformat binary_{'big' if big_endian else 'little'}_endian 1.0\nelement vertex {len(pdf)}\n{names}end_header\n".encode() + rows.tobytes()


def encoded(df: DataFrame, key: str = "object_id") -> DataFrame:
    """key, content: each object as the bytes of a PLY file."""
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(lambda k, pdf: pd.DataFrame([{key: k[0], "content": encode(pdf.sort_values("point_id"))}]), f"{key} {kind}, content binary")


def write(df: DataFrame, folder: str, key: str = "object_id") -> DataFrame:
    """Writes <folder>/<key>.ply for each object from the tasks that hold them; returns key, path, bytes.

    The folder must be one that all executors share.
    """
    import pyarrow.fs as pafs

    kind = df.schema[key].dataType.simpleString()

    def put(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file:{folder}")
        fs.create_dir(base)
        data = encode(pdf.sort_values("point_id"))
        with fs.open_output_stream(f"{base}/{k[0]}.ply") as out:
            out.write(data)
        return pd.DataFrame([{key: k[0], "path": f"{base}/{k[0]}.ply", "bytes": len(data)}])

    return df.groupBy(key).applyInPandas(put, f"{key} {kind}, path string, bytes long")


def header_of(data: bytes) -> tuple[int, int]:
    """Vertices announced and size of the header, for manifests."""
    end = data.index(b"end_header") + len(b"end_header\n")
    count = next(int(x.split()[2]) for x in data[:end].decode().splitlines() if x.startswith("element vertex"))
    return count, end
