"""Samples and splits: by hash order in Column form, farthest points by object in grouped functions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huepoint.functions.maths import uniform
from huepoint.operators import ordered

KEY, XYZ = ("object_id",), ("x", "y", "z")


def farthest_points(xyz: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Indices in order of choice; ties go to the smallest index."""
    n = min(n, len(xyz))
    chosen = np.empty(n, np.int64)
    if not n:
        return chosen
    chosen[0] = start
    d = ((xyz - xyz[start]) ** 2).sum(1)
    for i in range(1, n):
        chosen[i] = d.argmax()
        np.minimum(d, ((xyz - xyz[chosen[i]]) ** 2).sum(1), out=d)
    return chosen


def _grouped(df: DataFrame, fn, extra: str, key: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + extra
    return df.groupBy(*key).applyInPandas(fn, schema)


def drawn_of(seed: int, *keys: object) -> float:
    """As ``maths.uniform``, of values."""
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16) / (1 << 52)


def fps(df: DataFrame, n: int, key: Sequence[str] = KEY, seed: int | None = None, pad: bool = False) -> DataFrame:
    """n farthest points of each object with ``fps_order``; start: the first by id, or one drawn by seed and key.

    Each choice depends on all before, so an object is one task's work; objects have some thousand points.
    With ``pad`` objects of fewer points repeat theirs in order.
    """

    def pick(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        start = 0 if seed is None else int(drawn_of(seed, *k) * len(pdf))
        order = farthest_points(pdf[list(XYZ)].to_numpy(float), n, start)
        if pad and len(order) < n:
            order = np.resize(order, n)
        return pdf.iloc[order].assign(fps_order=np.arange(len(order), dtype=np.int64))

    return _grouped(df, pick, ", fps_order long", key)


def colour_gradient(xyz: np.ndarray, rgb: np.ndarray, k: int) -> np.ndarray:
    """Distance of each colour to the mean of its k nearest others'."""
    out = np.empty(len(xyz))
    k = min(k, len(xyz) - 1)
    for lo in range(0, len(xyz), 512):
        d = ((xyz[lo : lo + 512, None, :] - xyz[None]) ** 2).sum(2)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        out[lo : lo + 512] = np.linalg.norm(rgb[lo : lo + 512] - rgb[near].mean(1), axis=1) if k else 0
    return out


def colour_aware(df: DataFrame, n: int, colour_share: float, k: int = 16, key: Sequence[str] = KEY, seed: int = 42) -> DataFrame:
    """Farthest points, and a share drawn without replacement by colour gradient (evenly where there is none)."""

    def pick(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        if n >= len(pdf):
            return pdf.assign(by_colour=False)
        drawn = int(n * colour_share)
        xyz, rgb = pdf[list(XYZ)].to_numpy(float), pdf[["r", "g", "b"]].to_numpy(float)
        base = farthest_points(xyz, n - drawn)
        rest = np.setdiff1d(np.arange(len(pdf)), base)
        w = colour_gradient(xyz, rgb, k)[rest]
        w = w if w.sum() > 0 else np.ones(len(rest))
        u = np.random.default_rng([seed, *(zlib.crc32(str(x).encode()) for x in key_)]).random(len(rest))
        with np.errstate(divide="ignore"):
            extra = rest[np.argsort(np.where(w > 0, -np.log(u) / w, np.inf), kind="stable")[:drawn]]  # exponential clocks
        return pdf.iloc[np.concatenate([base, extra])].assign(by_colour=np.arange(n) >= len(base))

    return _grouped(df, pick, ", by_colour boolean", key)


def subsample(df: DataFrame, n: int, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """n rows of each object in hash order, with ``slot``; objects of fewer are drawn with replacement for all slots."""
    w = Window.partitionBy(*key)
    ranked = df.withColumns({"__rank": F.row_number().over(w.orderBy(uniform("point_id", seed=seed), "point_id")), "__n": F.count(F.lit(1)).over(w)})
    enough = ranked.filter((F.col("__n") >= n) & (F.col("__rank") <= n)).withColumn("slot", F.col("__rank") - 1)
    short = ranked.filter(F.col("__n") < n)
    slots = short.select(*key, "__n").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__rank", F.floor(uniform(*key, "slot", seed=seed + 1) * F.col("__n")).cast("int") + 1)
    return enough.unionByName(slots.drop("__n").join(short, [*key, "__rank"]).select(*enough.columns)).drop("__rank", "__n")


def keep_then_pad(df: DataFrame, n: int, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """All rows (the first n by id), then repeats drawn by hash up to n, with ``slot``."""
    w = Window.partitionBy(*key)
    ranked = df.withColumns({"slot": F.row_number().over(w.orderBy("point_id")) - 1, "__n": F.count(F.lit(1)).over(w)})
    slots = ranked.select(*key, "__n").distinct().filter(F.col("__n") < n).withColumn("slot", F.explode(F.sequence(F.col("__n").cast("int"), F.lit(n - 1))))
    extra = slots.withColumn("__pick", F.floor(uniform(*key, "slot", seed=seed) * F.col("__n")).cast("int")).drop("__n")
    source = ranked.drop("__n").withColumnRenamed("slot", "__pick")
    return ranked.filter(F.col("slot") < n).drop("__n").unionByName(extra.join(source, [*key, "__pick"]).drop("__pick"))


def ranked_split(df: DataFrame, order: Sequence[str], share: float, key: Sequence[str] = (), tail: bool = True) -> DataFrame:
    """``df`` with ``held_out``: the last (or first) max(1, floor(n * share)) rows of each group by order."""
    rows = ordered.placed(ordered.counted(df, "__all", key), order, "__at", key)
    n = F.greatest(F.lit(1), F.floor(F.col("__all") * share))
    return rows.withColumn("held_out", F.col("__at") >= F.col("__all") - n if tail else F.col("__at") < n).drop("__all", "__at")


def counted_split(df: DataFrame, id_: str, train: int, validation: int, seed: int | None = None) -> DataFrame:
    """``df(id_, ...)`` with ``split``: the first ``train`` rows by id (with ``seed``: by hash), then ``validation``; the rest goes.

    Both are exact. A table of fewer rows than both together raises an error when it is read; an empty one gives none.
    """
    hashed = df if seed is None else df.withColumn("__u", uniform(id_, seed=seed))
    rows = ordered.placed(ordered.counted(hashed, "__all"), [id_] if seed is None else ["__u", id_], "__at")
    need = train + validation
    enough = F.when(F.col("__all") >= need, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{need} rows are needed, there are "), F.col("__all").cast("string"))).cast("boolean"))
    split = F.when(F.col("__at") < train, "train").otherwise("validation")
    return rows.filter(enough & (F.col("__at") < need)).withColumn("split", split).drop("__all", "__at", "__u")


def chosen(df: DataFrame, n: int, key: str = "object_id", seed: int = 42) -> DataFrame:
    """All rows of n whole objects, the first in hash order (all objects where there are no more)."""
    picks = df.select(key).distinct().orderBy(uniform(key, seed=seed), key).limit(n)
    return df.join(picks, key, "left_semi")


def hash_split(df: DataFrame, id_: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``validation``: a share by hash, whatever else is in the table."""
    return df.withColumn("validation", uniform(id_, seed=seed) < share)


def limited(df: DataFrame, order: Sequence[str], n: int, key: Sequence[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def batches(df: DataFrame, id_: str, size: int, epoch: int, key: Sequence[str] = ()) -> DataFrame:
    """Shuffled batches of an epoch: ``batch`` numbers by hash order."""
    rows = ordered.placed(df.withColumn("__u", uniform(id_, seed=epoch)), ["__u", id_], "__at", key)
    return rows.withColumn("batch", F.floor(F.col("__at") / size)).drop("__u", "__at")
