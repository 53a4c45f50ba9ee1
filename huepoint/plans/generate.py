"""Synthetic labelled clouds as rows: every point is drawn from hashes of the seed, its object and its number.

No object is made as a whole, so objects of any number and size are spread over all tasks, and any SQL engine
can draw the same points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huepoint.functions.maths import uniform

# The chair's parts, each a box: name, centre, size.
PARTS = (
    ("seat", (0.0, 0.90, 0.00), (2.0, 0.15, 2.0)),
    ("back", (0.0, 1.65, -0.93), (2.0, 1.5, 0.15)),
    ("leg_a", (-0.9, 0.45, -0.9), (0.16, 0.9, 0.16)),
    ("leg_b", (0.9, 0.45, -0.9), (0.16, 0.9, 0.16)),
    ("leg_c", (-0.9, 0.45, 0.9), (0.16, 0.9, 0.16)),
    ("leg_d", (0.9, 0.45, 0.9), (0.16, 0.9, 0.16)),
)
# The range of a palette's channels.
DARKEST, LIGHTEST = 0.12, 0.9
# Centres of the three clusters.
CLUSTERS = ((1.4, 0, 0), (-1.4, 0, 0), (0, 1.4, 0))
XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")
POINT, OBJECT = ("object_id", "point_id"), ("object_id", "part")


def _draw(of: Sequence[str], name: str, seed: int) -> Column:
    return uniform(*of, F.lit(name), seed=seed)


def _normal(of: Sequence[str], name: str, seed: int) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - _draw(of, f"{name}1", seed))) * F.cos(2 * math.pi * _draw(of, f"{name}2", seed))


def _of(values: Sequence[float], index: str = "part") -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(index) + 1).cast("int"))


def _pick(u: Column, shares: Sequence[Column | float]) -> Column:
    """The number of the share that u falls into; shares add up to 1."""
    below, out = F.lit(0.0), F.lit(0).cast("long")
    for s in list(shares)[:-1]:
        below = below + s
        out = out + (u >= below).cast("long")
    return out


def _points(spark: SparkSession, count: int, n: int, first: int) -> DataFrame:
    return spark.range(count * n).select((F.floor(F.col("id") / n) + first).cast("long").alias("object_id"), (F.col("id") % n).cast("long").alias("point_id"))


def chairs(spark: SparkSession, count: int, n: int = 8192, seed: int = 0, jitter: float = 0.0, noise: float = 0.03, palette: Sequence[Sequence[float]] | None = None, second: Sequence[Sequence[float]] | None = None, first: int = 0) -> DataFrame:
    """object_id (from ``first``), point_id, xyz, rgb, part: points over the surfaces of a chair's boxes.

    A point takes a part by the parts' areas, a pair of faces by the part's, and a place on one of the two. jitter:
    each object's centres and sizes move by up to this fraction. palette: a colour for each part, or each object
    draws its own. second: a second material's colours, above the middle of each part. noise: spread of the colours.
    """
    areas = [a * b + b * c + a * c for _, _, (a, b, c) in PARTS]
    df = _points(spark, count, n, first).withColumn("part", _pick(_draw(POINT, "part", seed), [a / sum(areas) for a in areas]))
    moved = lambda c, name: 1 + jitter * (2 * _draw(OBJECT, name, seed) - 1) if jitter else F.lit(1.0)
    df = df.withColumns({f"c{x}": _of([p[1][i] for p in PARTS]) * moved(x, f"centre{x}") for i, x in enumerate(XYZ)})
    df = df.withColumns({f"s{x}": _of([p[2][i] for p in PARTS]) * moved(x, f"size{x}") for i, x in enumerate(XYZ)})
    across = [F.col("sy") * F.col("sz"), F.col("sx") * F.col("sz"), F.col("sx") * F.col("sy")]  # of the faces across each axis
    whole = across[0] + across[1] + across[2]
    df = df.withColumn("axis", _pick(_draw(POINT, "axis", seed), [a / whole for a in across]))
    side = F.when(_draw(POINT, "side", seed) < 0.5, -0.5).otherwise(0.5)
    df = df.withColumns({x: F.col(f"c{x}") + F.col(f"s{x}") * F.when(F.col("axis") == i, side).otherwise(_draw(POINT, x, seed) - 0.5) for i, x in enumerate(XYZ)})
    for i, c in enumerate(RGB):
        flat = _of([p[i] for p in palette]) if palette else DARKEST + (LIGHTEST - DARKEST) * _draw(OBJECT, c, seed)
        if second:
            flat = F.when(F.col("y") > F.col("cy"), _of([p[i] for p in second])).otherwise(flat)
        df = df.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), flat + (noise * _normal(POINT, c, seed) if noise else 0.0))))
    return df.select(*POINT, *XYZ, *RGB, "part")


def clusters(spark: SparkSession, count: int, n: int = 8192, seed: int = 0, spread: float = 0.25, first: int = 0) -> DataFrame:
    """object_id, point_id, xyz, rgb, part: three clusters of normal points, each of its own grey."""
    df = _points(spark, count, n, first).withColumn("part", _pick(_draw(POINT, "part", seed), [1 / len(CLUSTERS)] * len(CLUSTERS)))
    df = df.withColumns({x: _of([c[i] for c in CLUSTERS]) + spread * _normal(POINT, x, seed) for i, x in enumerate(XYZ)})
    grey = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 + 0.3 * F.col("part") + 0.02 * _normal(POINT, c, seed)))
    return df.withColumns({c: grey(c) for c in RGB}).select(*POINT, *XYZ, *RGB, "part")


def objects(spark: SparkSession, count: int, n: int = 8192, kind: str = "chair", seed: int = 0, **options) -> DataFrame:
    return {"chair": chairs, "clusters": clusters}[kind](spark, count, n, seed, **options)
