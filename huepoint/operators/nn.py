"""Nearest-neighbour joins inside objects: by all pairs of an object, or by grid cells.

All strategies give the same rows. ``brute`` is an equi-join on object_id whose pairs are reduced in the same
stage, first to a bound of each point's k-th distance and then to the pairs up to it (``close_pairs``); use it while objects have up to some thousand points. ``cells`` is an index for each object: a grid whose
width comes from the object's own extent and number of points, in which a query point meets the points of the
eight cells nearest to it; what isn't settled within half a width goes on in cells twice as wide, at last to all
pairs. Points and what is settled are kept once, so no round is worked out again, and the pairs of one object are
spread over the tasks. ``grid`` is the same with 27 cells of a width given for all objects. Ties go to the
smallest reference id.

Every operator that looks for neighbours takes the strategy in force: ``with nn.using("cells"): metrics.completion(...)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.store import kept

KEY, XYZ = ("object_id",), ("x", "y", "z")
STRATEGIES = ("brute", "cells", "grid")
_IN_FORCE: ContextVar[str] = ContextVar("strategy", default="brute")


def in_force() -> str:
    return _IN_FORCE.get()


@contextmanager
def using(strategy: str) -> Iterator[None]:
    """Neighbours are looked for by this strategy wherever none is named."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    token = _IN_FORCE.set(strategy)
    try:
        yield
    finally:
        _IN_FORCE.reset(token)


def square_distance(a: str = "q", b: str = "n") -> Column:
    """Of the points whose coordinates begin with the prefixes."""
    d = [F.col(f"{a}_{c}") - F.col(f"{b}_{c}") for c in XYZ]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def side(df: DataFrame, prefix: str, key: Sequence[str]) -> DataFrame:
    return df.select(*key, F.col("point_id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in XYZ])


def pairs(query: DataFrame, ref: DataFrame, key: Sequence[str] = KEY, include_self: bool = True) -> DataFrame:
    """key, q_id, n_id, d2 of all pairs of an object."""
    out = side(query, "q", key).join(side(ref, "n", key), list(key)).withColumn("d2", square_distance())
    return out if include_self else out.filter("q_id <> n_id")


#: Groups of reference points by hash whose least distances bound the k-th; beyond so many neighbours all pairs are ranked.
GROUPS, MANY = 64, 32


def close_pairs(query: DataFrame, ref: DataFrame, k: int, key: Sequence[str] = KEY, include_self: bool = True) -> DataFrame:
    """``pairs`` without those that can't be among the k nearest, so that few are sorted.

    Reference points are dealt to groups by hash, and each query point's least distance to each group is found
    without sorting. The k-th least of them bounds the k-th nearest, as k points are that near; pairs up to the
    bound, equal ones too, are made once more. Where fewer than k groups have points all pairs stay.
    """
    if k > MANY:
        return pairs(query, ref, key, include_self)
    n = min(4 * k, GROUPS)
    met = pairs(query, ref, key, include_self)
    if k == 1:
        bounds = met.groupBy(*key, "q_id").agg(F.min("d2").alias("__bound"))
    else:
        met = met.withColumn("__group", F.pmod(F.xxhash64("n_id"), F.lit(n)))
        least = met.groupBy(*key, "q_id").agg(*[F.min(F.when(F.col("__group") == i, F.col("d2"))).alias(f"__{i}") for i in range(n)])
        bounds = least.select(*key, "q_id", F.array_sort(F.array(*[f"__{i}" for i in range(n)]))[k - 1].alias("__bound"))
    again = side(query, "q", key).join(bounds, [*key, "q_id"]).join(side(ref, "n", key), list(key)).withColumn("d2", square_distance())
    near = again.filter(F.col("__bound").isNull() | (F.col("d2") <= F.col("__bound"))).drop("__bound")
    return near if include_self else near.filter("q_id <> n_id")


def _cell_pairs(query: DataFrame, ref: DataFrame, width: float, key: Sequence[str], include_self: bool) -> DataFrame:
    cell = lambda p, c: F.floor(F.col(f"{p}_{c}") / width)
    r = side(ref, "n", key).withColumns({f"cell_{c}": cell("n", c) for c in XYZ})
    q = side(query, "q", key)
    for c in XYZ:
        q = q.withColumn(f"cell_{c}", F.explode(F.array(*[cell("q", c) + i for i in (-1, 0, 1)])))
    out = q.join(r, [*key, *[f"cell_{c}" for c in XYZ]]).withColumn("d2", square_distance())
    return out if include_self else out.filter("q_id <> n_id")


def _widths(ref: DataFrame, k: int, key: Sequence[str]) -> DataFrame:
    """key, __width: cells within which half a width around a point of an even surface holds some k points of the object."""
    box = ref.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *[(F.max(c) - F.min(c)).alias(f"__{c}") for c in XYZ])
    a, b, c = (F.col(f"__{x}") for x in XYZ)
    # a box's half surface, spread over its points; a line or a point has none
    surface, longest = a * b + b * c + a * c, F.greatest(a, b, c)
    radius = F.greatest(F.sqrt(surface * (2 * (k + 2) / math.pi) / F.col("__n")), longest * (k + 2) / F.col("__n"))
    return box.select(*key, F.when(radius > 0, 2 * radius).otherwise(1.0).alias("__width"))


def _octant_pairs(query: DataFrame, ref: DataFrame, key: Sequence[str], include_self: bool) -> DataFrame:
    """Pairs of points with those of the eight cells nearest to them; both have ``__width``."""
    cell = lambda p, c, half=0.0: F.floor(F.col(f"{p}_{c}") / F.col("__width") + half)
    r = ref.withColumns({f"cell_{c}": cell("n", c) for c in XYZ}).drop("__width")
    q = query
    for c in XYZ:  # the cell itself, and its neighbour on the nearer side
        q = q.withColumn(f"cell_{c}", F.explode(F.array(cell("q", c, -0.5), cell("q", c, -0.5) + 1)))
    out = q.join(r, [*key, *[f"cell_{c}" for c in XYZ]]).withColumn("d2", square_distance())
    return out if include_self else out.filter("q_id <> n_id")


def _by_cells(query: DataFrame, ref: DataFrame, key: Sequence[str], include_self: bool, k: int, best, rounds: int) -> DataFrame:
    refs = kept(side(ref, "n", key).join(_widths(ref, k, key), list(key)))
    wide = refs.select(*key, "__width").distinct()
    left = kept(side(query, "q", key).join(wide, list(key)))
    found = None
    for i in range(rounds):
        scale = F.col("__width") * 2**i
        scaled = [x.withColumn("__width", scale) for x in (left, refs)]
        near = best(_octant_pairs(*scaled, key, include_self)).join(wide, list(key))
        settled = near.groupBy(*key, "q_id").agg(F.count(F.lit(1)).alias("__n"), F.max(F.sqrt("d2") / (scale / 2)).alias("__far"))
        near = kept(near.join(settled, [*key, "q_id"]).filter((F.col("__n") == k) & (F.col("__far") <= 1)).select(*key, "q_id", "n_id", "d2", "rank"))
        found = near if found is None else found.unionByName(near)
        left = kept(left.join(near.select(*key, "q_id").distinct(), [*key, "q_id"], "left_anti"))
        if left.isEmpty():
            return found
    rest = left.drop("__width").join(refs.drop("__width"), list(key)).withColumn("d2", square_distance())
    return found.unionByName(best(rest if include_self else rest.filter("q_id <> n_id")))


def knn(query: DataFrame, ref: DataFrame, k: int = 1, key: Sequence[str] = KEY, include_self: bool = True, strategy: str | None = None, width: float = 0.1, rounds: int = 3) -> DataFrame:
    """key, q_id, n_id, d2, rank (1 to k) of the k nearest; query points of objects with fewer get fewer."""
    order = Window.partitionBy(*key, "q_id").orderBy(F.asc_nulls_last("d2"), "n_id")

    def best(p: DataFrame) -> DataFrame:
        if k == 1:
            got = p.groupBy(*key, "q_id").agg(F.min(F.struct("d2", "n_id")).alias("m"))
            return got.select(*key, "q_id", F.col("m.n_id").alias("n_id"), F.col("m.d2").alias("d2"), F.lit(1).alias("rank"))
        return p.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*key, "q_id", "n_id", "d2", "rank")

    strategy = strategy or _IN_FORCE.get()
    if strategy == "brute":
        return best(close_pairs(query, ref, k, key, include_self))
    if strategy == "cells":
        return _by_cells(query, ref, key, include_self, k, best, rounds)
    found, left = None, query
    for _ in range(rounds):
        near = best(_cell_pairs(left, ref, width, key, include_self))
        done = near.groupBy(*key, "q_id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far")).filter((F.col("n") == k) & (F.col("far") <= width * width)).select(*key, "q_id")
        part = near.join(done, [*key, "q_id"], "left_semi")
        found = part if found is None else found.unionByName(part)
        left = left.join(done.withColumnRenamed("q_id", "point_id"), [*key, "point_id"], "left_anti")
        width *= 3
    return found.unionByName(best(pairs(left, ref, key, include_self)))


def nearest(query: DataFrame, ref: DataFrame, key: Sequence[str] = KEY, strategy: str | None = None, width: float = 0.1) -> DataFrame:
    """key, q_id, n_id, d (distance) of the nearest reference point."""
    return knn(query, ref, 1, key, True, strategy, width).select(*key, "q_id", "n_id", F.sqrt("d2").alias("d"))


def padded(edges: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Neighbour lists of k entries; shorter ones are repeated from their beginning."""
    listed = edges.groupBy(*key, "q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "n_id"))).alias("l"))  # k entries at most
    at = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    return listed.select(*key, "q_id", at, "l").select(*key, "q_id", "rank", F.element_at("l", (F.pmod(F.col("rank") - 1, F.size("l")) + 1).cast("int"))["n_id"].alias("n_id"))


def ball(query: DataFrame, ref: DataFrame, radius: float, samples: int, key: Sequence[str] = KEY, fill_empty: bool = False) -> DataFrame:
    """The first ``samples`` reference points by id within the radius; short lists are filled with their first one.

    Query points without one give no rows, with ``fill_empty`` the object's first reference point.
    """
    inside = _cell_pairs(query, ref, radius, key, True).filter(F.col("d2") <= radius * radius)
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "q_id").orderBy("n_id"))).filter(F.col("rank") <= samples)
    first = ranked.filter("rank = 1").select(*key, "q_id", F.col("n_id").alias("first"))
    if fill_empty:
        lowest = ref.groupBy(*key).agg(F.min("point_id").alias("lowest"))
        every = query.select(*key, F.col("point_id").alias("q_id")).join(lowest, list(key))
        first = every.join(first, [*key, "q_id"], "left").select(*key, "q_id", F.coalesce("first", "lowest").alias("first"))
    slots = first.select(*key, "q_id", "first", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("rank"))
    return slots.join(ranked.select(*key, "q_id", "rank", "n_id"), [*key, "q_id", "rank"], "left").select(*key, "q_id", "rank", F.coalesce("n_id", "first").alias("n_id"))


def subset_mask(cloud: DataFrame, partial: DataFrame, tolerance: float = 1e-5, key: Sequence[str] = KEY) -> DataFrame:
    """``cloud`` with ``visible``: whether a point of the partial cloud lies within the tolerance."""
    hit = _cell_pairs(cloud, partial, tolerance, key, True).filter(F.col("d2") < tolerance * tolerance).select(*key, F.col("q_id").alias("point_id"), F.lit(True).alias("hit")).distinct()
    return cloud.join(hit, [*key, "point_id"], "left").withColumn("visible", F.coalesce("hit", F.lit(False))).drop("hit")


def attach(edges: DataFrame, points: DataFrame, end: str, columns: Sequence[str], prefix: str, key: Sequence[str] = KEY) -> DataFrame:
    """Columns of the points at one end (q_id or n_id) of the edges."""
    return edges.join(points.select(*key, F.col("point_id").alias(end), *[F.col(c).alias(f"{prefix}{c}") for c in columns]), [*key, end])


def to_triangle(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Distance of a point to a triangle: to its plane where the foot is inside, else to the nearest edge."""
    sub = lambda u, v: [x - y for x, y in zip(u, v)]
    dot = lambda u, v: sum((x * y for x, y in zip(u, v)), F.lit(0.0))

    def to_edge(s: Sequence[Column], e: Sequence[Column]) -> Column:
        d, w = sub(e, s), sub(p, s)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot(w, d) / F.nullif(dot(d, d), F.lit(0.0)), F.lit(0.0))))
        r = [x - t * y for x, y in zip(w, d)]
        return F.sqrt(dot(r, r))

    u, v, w = sub(b, a), sub(c, a), sub(p, a)
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    nn, uu, uv, vv, wu, wv = dot(n, n), dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    det = F.nullif(uu * vv - uv * uv, F.lit(0.0))
    s, t = (vv * wu - uv * wv) / det, (uu * wv - uv * wu) / det
    return F.when((s >= 0) & (t >= 0) & (s + t <= 1), F.abs(dot(w, n)) / F.sqrt(nn)).otherwise(F.least(to_edge(a, b), to_edge(b, c), to_edge(c, a)))


def _face_distances(points: DataFrame, triangles: DataFrame, key: Sequence[str]) -> DataFrame:
    p, corner = [F.col(c) for c in XYZ], lambda n: [F.col(f"{n}{c}") for c in XYZ]
    return points.join(triangles, list(key)).withColumn("d", to_triangle(p, corner("a"), corner("b"), corner("c")))


def surface_distance(points: DataFrame, triangles: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``triangles(key, face_id, ax..cz)`` -> key, point_id, d to the nearest face of the object."""
    return _face_distances(points.select(*key, "point_id", *XYZ), triangles, key).groupBy(*key, "point_id").agg(F.min("d").alias("d"))


def to_surface(points: DataFrame, triangles: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``triangles(key, face_id, ax..cz)`` -> key, point_id, face_id, d of the nearest face of the object.

    The least distance comes first, then the lowest of the faces that have it, so that no pairs are sorted.
    """
    least = surface_distance(points, triangles, key).withColumnRenamed("d", "__least")
    again = _face_distances(points.select(*key, "point_id", *XYZ).join(least, [*key, "point_id"]), triangles, key)
    face = F.min(F.when(F.col("d").eqNullSafe(F.col("__least")), F.col("face_id")))
    return again.groupBy(*key, "point_id").agg(face.alias("face_id"), F.min("d").alias("d"))
