"""Scalar helpers: rounding, schedules, embeddings, ids and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def half_even(c: Column) -> Column:
    """Rounds halves to the even neighbour."""
    return F.rint(c)


def psnr(mse: Column) -> Column:
    return 10 * F.log10(1 / F.greatest(mse, F.lit(1e-12)))


def one_hot(c: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(c)).cast("int"))


def timestep_embedding(t: str, dim: int) -> Column:
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.col(t) * F.exp(-math.log(10000) * i / half))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def seed_of(*parts: str) -> Column:
    """crc32 of the parts joined by underscores, without the sign bit."""
    return F.crc32(F.concat_ws("_", *[F.col(p).cast("string") for p in parts]).cast("binary")).bitwiseAND(2147483647)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def hashed(*keys: str | Column, seed: int = 0) -> Column:
    """A long of 52 bits, from an MD5 of the seed and the keys, which any SQL engine can follow."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*keys: str | Column, seed: int = 0) -> Column:
    """In [0, 1), a function of the keys and the seed."""
    return hashed(*keys, seed=seed) / F.lit(float(1 << 52))


def dot(row: tuple[float, ...], cols: tuple[str, ...]) -> Column:
    return sum((F.col(c) * float(v) for v, c in zip(row, cols)), F.lit(0.0))
