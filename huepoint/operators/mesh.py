"""Meshes to samples: points over surfaces by area, with colours from corners or textures, and labels of faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huepoint.functions.colour import barycentric, texel
from huepoint.functions.maths import uniform
from huepoint.operators import ordered

XYZ, CORNERS, KEY = ("x", "y", "z"), ("a", "b", "c"), ("object_id",)


def face_area() -> Column:
    """Of the triangle ax .. cz."""
    u, v = ([F.col(f"{p}{c}") - F.col(f"a{c}") for c in XYZ] for p in ("b", "c"))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def surface_samples(triangles: DataFrame, n: int, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """``triangles(key, face_id, ax .. cz, ...)`` -> key, point_id, face_id, w_a, w_b, w_c (corners' weights), x, y, z: n points of each surface.

    Faces take points by area: a point draws a place in the running sum of its object's areas. The sums come from
    ranges of faces, so a mesh of any size is spread over the tasks; points meet their face in one of as many
    equal cells of the sum as the mesh has faces. Faces without area get none, and objects without area no points.
    """
    faces = triangles.select(*key, "face_id", *[f"{p}{c}" for p in CORNERS for c in XYZ], face_area().alias("area")).filter("area > 0")
    summed = ordered.earlier(faces, F.col("area"), ["face_id"], "before", key=key).withColumn("after", F.col("before") + F.col("area"))
    whole = summed.groupBy(*key).agg(F.max("after").alias("total"), F.count(F.lit(1)).alias("cells"))
    cell = lambda x: F.least(F.floor(x / F.col("total") * F.col("cells")), F.col("cells") - 1).cast("long")
    held = summed.join(whole, list(key)).withColumn("cell", F.explode(F.sequence(cell(F.col("before")), cell(F.col("after"))))).drop("total", "cells")
    drawn = whole.withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    drawn = drawn.withColumn("at", uniform(*key, "point_id", F.lit("face"), seed=seed) * F.col("total")).withColumn("cell", cell(F.col("at"))).select(*key, "point_id", "cell", "at")
    met = drawn.join(held, [*key, "cell"]).filter("before <= at and at < after")
    u, v = (uniform(*key, "point_id", F.lit(name), seed=seed) for name in ("u", "v"))
    met = met.withColumns({"w_b": F.when(u + v > 1, 1 - u).otherwise(u), "w_c": F.when(u + v > 1, 1 - v).otherwise(v)}).withColumn("w_a", 1 - F.col("w_b") - F.col("w_c"))
    return met.select(*key, "point_id", "face_id", "w_a", "w_b", "w_c", *[on_face(c).alias(c) for c in XYZ])


def on_face(name: str) -> Column:
    """What the corners' a<name>, b<name>, c<name> give at a sample."""
    return barycentric([F.col(f"{p}{name}") for p in CORNERS], [F.col(f"w_{p}") for p in CORNERS])


def with_corners(samples: DataFrame, faces: DataFrame, names: Sequence[str], keep: Sequence[str] = (), key: Sequence[str] = KEY) -> DataFrame:
    """``samples`` with ``names`` from the corners' columns of ``faces`` and the face's own columns ``keep``."""
    own = faces.select(*key, "face_id", *[f"{p}{c}" for p in CORNERS for c in names], *keep)
    return samples.join(own, [*key, "face_id"]).select(*samples.columns, *[on_face(c).alias(c) for c in names], *keep)


def textured(samples: DataFrame, texels: DataFrame, fallback: float = 0.5) -> DataFrame:
    """``samples(texture, u, v, ...)`` with r, g, b of ``texels(texture, width, height, column, row, r, g, b)``; grey where there is no texture."""
    sizes = texels.groupBy("texture").agg(F.first("width").alias("__w"), F.first("height").alias("__h"))
    column, row = texel("u", "v", F.col("__w"), F.col("__h"))
    at = samples.join(sizes, "texture", "left").withColumns({"column": column, "row": row})
    got = at.join(texels.select("texture", "column", "row", "r", "g", "b"), ["texture", "column", "row"], "left")
    return got.select(*samples.columns, *[F.coalesce(c, F.lit(fallback)).alias(c) for c in ("r", "g", "b")])


def labelled(samples: DataFrame, face_parts: DataFrame, other: str = "other", key: Sequence[str] = KEY) -> DataFrame:
    """``samples`` with the part of their face, from ``face_parts(key, face, part)``; faces without one have ``other``."""
    parts = face_parts.select(*key, F.col("face").cast("long").alias("face_id"), "part")
    return samples.join(parts, [*key, "face_id"], "left").withColumn("part", F.coalesce("part", F.lit(other)))
