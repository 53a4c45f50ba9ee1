"""Frames, crops, alignment and mesh clean-up as windows and joins keyed by object."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.functions.maths import half_even, uniform
from huepoint.operators import nn
from huepoint.store import kept

KEY, XYZ = ("object_id",), ("x", "y", "z")


def centred(df: DataFrame, key: Sequence[str] = KEY, where: Column | None = None) -> DataFrame:
    """Coordinates minus the object's centroid (of the rows that ``where`` holds for)."""
    w = Window.partitionBy(*key)
    mean = lambda c: F.avg(F.col(c) if where is None else F.when(where, F.col(c))).over(w)
    return df.withColumns({f"__c{c}": mean(c) for c in XYZ}).withColumns({c: F.col(c) - F.col(f"__c{c}") for c in XYZ}).drop(*[f"__c{c}" for c in XYZ])


def norm() -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0)))


def scaled(df: DataFrame, scale: Column, key: Sequence[str] = KEY, epsilon: float = 1e-12) -> DataFrame:
    df = df.withColumn("__s", scale.over(Window.partitionBy(*key)) + epsilon)
    return df.withColumns({c: F.col(c) / F.col("__s") for c in XYZ}).drop("__s")


def unit_sphere(df: DataFrame, key: Sequence[str] = KEY, epsilon: float = 1e-12) -> DataFrame:
    return scaled(centred(df, key), F.max(norm()), key, epsilon)


def rms_normalised(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    df = centred(df, key).withColumn("__n", F.pow(norm(), F.lit(2.0)))
    df = df.withColumn("__s", F.sqrt(F.avg("__n").over(Window.partitionBy(*key))))
    return df.withColumns({c: F.col(c) / F.col("__s") for c in XYZ}).drop("__n", "__s")


def partial_frame(df: DataFrame, visible: Column, key: Sequence[str] = KEY, epsilon: float = 1e-9) -> DataFrame:
    """Centre and scale of the visible points alone, applied to all."""
    return scaled(centred(df, key, visible), F.max(F.when(visible, norm())), key, epsilon)


def crop(df: DataFrame, viewpoint: Sequence[Column | float], ratio: Column | float, key: Sequence[str] = KEY) -> DataFrame:
    """``df`` with ``crop_rank`` and ``is_missing``: the round(n * ratio) points nearest to the unit viewpoint go; ties by point_id."""
    v = [F.lit(c) if isinstance(c, (int, float)) else c for c in viewpoint]
    size = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    u = unit_sphere(df.withColumns({f"__o{c}": F.col(c) for c in XYZ}), key)
    d = sum((F.pow(F.col(c) - p / size, F.lit(2.0)) for c, p in zip(XYZ, v)), F.lit(0.0))
    ratio = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    u = u.withColumn("__d", d).withColumns({"crop_rank": F.row_number().over(Window.partitionBy(*key).orderBy("__d", "point_id")), "__n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    u = u.withColumn("is_missing", F.col("crop_rank") <= half_even(F.col("__n") * ratio))
    return u.withColumns({c: F.col(f"__o{c}") for c in XYZ}).drop("__d", "__n", *[f"__o{c}" for c in XYZ])


def zero_padded(cropped: DataFrame) -> DataFrame:
    """As many points as before, the missing ones at the origin."""
    return cropped.withColumns({c: F.when(F.col("is_missing"), 0.0).otherwise(F.col(c)) for c in XYZ})


DIFFICULTIES = (("simple", 0.25), ("moderate", 0.5), ("hard", 0.75))


def sweep(df: DataFrame, views: Sequence[Sequence[float]], difficulties: Sequence[tuple[str, float]] = DIFFICULTIES, key: Sequence[str] = KEY) -> DataFrame:
    """Crops of every object by each difficulty and view; the literal side has their product of rows."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("difficulty"), F.lit(float(r)).alias("ratio"), F.lit(i).alias("view"), *[F.lit(float(p)).alias(f"v{c}") for c, p in zip(XYZ, v)]) for (n, r), (i, v) in itertools.product(difficulties, enumerate(views))]))
    rows = df.withColumn("__g", grid).select("*", "__g.*").drop("__g")
    return crop(rows, [F.col(f"v{c}") for c in XYZ], F.col("ratio"), [*key, "difficulty", "view"]).drop("vx", "vy", "vz")


def seeded_viewpoint(*keys: str | Column, seed: int = 0) -> list[Column]:
    """A normal direction drawn from a hash of the keys; each coordinate by Box and Muller's rule."""
    u = lambda i: uniform(*keys, F.lit(i), seed=seed)
    return [F.sqrt(-2 * F.log(1 - u(2 * i))) * F.cos(2 * math.pi * u(2 * i + 1)) for i in range(3)]


def seeded_sweep(df: DataFrame, views: int, difficulties: Sequence[tuple[str, float]] = DIFFICULTIES, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """Crops of every object by each difficulty and ``views`` viewpoints of its own, the same in every run."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("difficulty"), F.lit(float(r)).alias("ratio"), F.lit(v).alias("view")) for n, r in difficulties for v in range(views)]))
    rows = df.withColumn("__g", grid).select("*", "__g.*").drop("__g")
    drawn = dict(zip(("vx", "vy", "vz"), seeded_viewpoint(*key, "difficulty", "view", seed=seed)))
    return crop(rows.withColumns(drawn), [F.col(c) for c in drawn], F.col("ratio"), [*key, "difficulty", "view"]).drop(*drawn)


def same_view(clouds: Sequence[tuple[str, DataFrame]], ratio: float, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """Crops of one object's clouds of several densities by one viewpoint, which its key alone determines; with ``resolution``, the cloud's name."""
    out = None
    for name, df in clouds:
        one = crop(df, seeded_viewpoint(*key, seed=seed), ratio, key).withColumn("resolution", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def signed_permutations() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """The 48 axis orders with signs, in a fixed order."""
    return [(p, s) for p in itertools.permutations(range(3)) for s in itertools.product((1, -1), repeat=3)]


def is_reflection(p: Sequence[int], s: Sequence[int]) -> bool:
    odd = sum(p[i] > p[j] for i in range(3) for j in range(i + 1, 3)) % 2
    return bool(odd) != (s[0] * s[1] * s[2] < 0)


def transformed(df: DataFrame) -> DataFrame:
    """Each row under all 48 signed permutations, with ``frame`` and ``reflection``."""
    rows = [F.struct(F.lit(i).alias("frame"), F.lit(is_reflection(p, s)).alias("reflection"), *[(F.col(XYZ[p[j]]) * s[j]).alias(XYZ[j]) for j in range(3)]) for i, (p, s) in enumerate(signed_permutations())]
    return df.withColumn("__t", F.explode(F.array(*rows))).drop(*XYZ).select("*", "__t.*").drop("__t")


def in_frame(df: DataFrame) -> DataFrame:
    """Each row under the signed permutation that its ``frame`` numbers."""
    turned = F.array(*[F.struct(*[(F.col(XYZ[p[j]]) * s[j]).alias(XYZ[j]) for j in range(3)]) for p, s in signed_permutations()])
    return df.withColumn("__t", turned[F.col("frame")]).withColumns({c: F.col(f"__t.{c}") for c in XYZ}).drop("__t")


def chamfer(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY, square: bool = False) -> DataFrame:
    """key, chamfer: mean distance of a's points to b plus of b's to a."""
    one = lambda q, r: nn.nearest(q, r, key).groupBy(*key).agg(F.avg(F.col("d") * F.col("d") if square else F.col("d")).alias("m"))
    return one(a, b).withColumnRenamed("m", "m1").join(one(b, a), list(key)).select(*key, (F.col("m1") + F.col("m")).alias("chamfer"))


def alignment(part: DataFrame, ref: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, frame, reflection, chamfer, frame_rank: every signed permutation of part against ref, best first.

    Points meet once, not once for each frame: a pair has 18 squared differences of a signed axis to an axis, and each
    frame's distance adds three of them. A point's least distance in each frame is a column of its own.
    """
    if nn.in_force() != "brute":  # cells differ from frame to frame
        return _alignment_by_cells(part, ref, key)
    p, t = rms_normalised(part, key).select(*key, "point_id", *XYZ), rms_normalised(ref, key).select(*key, "point_id", *XYZ)
    one = lambda q, r, moves: _least_by_frame(q, r, moves, key).groupBy(*key).agg(*[F.avg(F.sqrt(f"f{i}")).alias(f"m{i}") for i in range(48)])
    there, back = one(p, t, "q"), one(t, p, "n").withColumnsRenamed({f"m{i}": f"n{i}" for i in range(48)})
    frames = F.array(*[F.struct(F.lit(i).alias("frame"), F.lit(is_reflection(*f)).alias("reflection"), (F.col(f"m{i}") + F.col(f"n{i}")).alias("chamfer")) for i, f in enumerate(signed_permutations())])
    scores = there.join(back, list(key)).select(*key, F.inline(frames)).select(*key, "frame", "chamfer", "reflection")
    return scores.withColumn("frame_rank", F.row_number().over(Window.partitionBy(*key).orderBy("chamfer", "frame")))


def _alignment_by_cells(part: DataFrame, ref: DataFrame, key: Sequence[str]) -> DataFrame:
    moved = transformed(rms_normalised(part, key))
    frames = moved.select(*key, "frame", "reflection").distinct()
    target = rms_normalised(ref, key).join(frames.select(*key, "frame"), list(key))
    scores = chamfer(moved, target, [*key, "frame"]).join(frames, [*key, "frame"])
    return scores.withColumn("frame_rank", F.row_number().over(Window.partitionBy(*key).orderBy("chamfer", "frame")))


def _least_by_frame(query: DataFrame, ref: DataFrame, moves: str, key: Sequence[str]) -> DataFrame:
    """key, q_id, f0 to f47: each query point's least squared distance to ref in each frame, of those where q or n (``moves``) is turned."""
    stays = "n" if moves == "q" else "q"
    gap = {(i, j, s): (F.col(f"{moves}_{XYZ[i]}") * s - F.col(f"{stays}_{XYZ[j]}")) for i in range(3) for j in range(3) for s in (1, -1)}
    met = nn.side(query, "q", key).join(nn.side(ref, "n", key), list(key))
    met = met.select(*key, "q_id", *[(d * d).alias(f"d{i}{j}{'+' if s > 0 else '-'}") for (i, j, s), d in gap.items()])
    square = lambda p, s: [F.col(f"d{p[j]}{j}{'+' if s[j] > 0 else '-'}") for j in range(3)]
    least = lambda d: F.min(d[0] + d[1] + d[2])
    return met.groupBy(*key, "q_id").agg(*[least(square(p, s)).alias(f"f{i}") for i, (p, s) in enumerate(signed_permutations())])


def leading_frames(part: DataFrame, ref: DataFrame, key: Sequence[str] = KEY, places: int = 1, share: int = 4) -> DataFrame:
    """As ``alignment``, of the frames that can be among an object's best ``places`` alone; their scores and ranks are the same.

    Distances only add up: what one in ``share`` points (by hash) give is a lower bound of a frame's score. The
    frames of the least bounds are scored in full, and a frame whose bound is above the worst of them ends there.
    Two places end few frames, as the second best is seldom much better than the rest.
    """
    moved, target = transformed(rms_normalised(part, key)), rms_normalised(ref, key)
    frames = moved.select(*key, "frame", "reflection").distinct()
    framed = [*key, "frame"]

    def scored(some: DataFrame, probes: bool) -> DataFrame:
        """key, frame, chamfer: of these frames; from probes alone a lower bound."""
        p, t = moved.join(some, framed, "left_semi"), target.join(some.select(*framed), list(key))
        one = lambda q, r: _mean_over(nn.nearest(probed(q) if probes else q, r, framed), q, framed)
        return one(p, t).withColumnRenamed("m", "m1").join(one(t, p), framed).select(*framed, (F.col("m1") + F.col("m")).alias("chamfer"))

    def probed(q: DataFrame) -> DataFrame:
        return q.filter(F.pmod(F.xxhash64("point_id"), F.lit(share)) == 0)

    least = Window.partitionBy(*key).orderBy("bound", "frame")
    bounds = kept(scored(frames.select(*framed), True).withColumnRenamed("chamfer", "bound").withColumn("place", F.row_number().over(least)))
    first = kept(scored(bounds.filter(F.col("place") <= places).select(*framed), False))
    worst = first.groupBy(*key).agg(F.max("chamfer").alias("worst"))
    # sums in another order may differ in the last digits
    open_ = bounds.filter(F.col("place") > places).join(worst, list(key)).filter(F.col("bound") <= F.col("worst") * (1 + 1e-9)).select(*framed)
    scores = first.unionByName(scored(open_, False)).join(frames, framed)
    return scores.withColumn("frame_rank", F.row_number().over(Window.partitionBy(*key).orderBy("chamfer", "frame")))


def _mean_over(near: DataFrame, query: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, m: the sum of distances over the number of all query points; without a distance 0."""
    n = query.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total = near.groupBy(*key).agg(F.sum("d").alias("__d"))
    return n.join(total, list(key), "left").select(*key, (F.coalesce("__d", F.lit(0.0)) / F.col("__n")).alias("m"))


def transferred(part: DataFrame, ref: DataFrame, scores: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``part(..., part)`` and ``alignment``'s scores -> key, point_id of ref, part of the nearest point in the best frame, residual, reflection."""
    best = scores.filter("frame_rank = 1").select(*key, "frame", "reflection", F.col("chamfer").alias("residual"))
    moved = in_frame(rms_normalised(part, key).select(*key, "point_id", *XYZ).join(best.select(*key, "frame"), list(key)))
    near = nn.attach(nn.nearest(rms_normalised(ref, key), moved, key), part, "n_id", ("part",), "", key)
    return near.join(best, list(key)).select(*key, F.col("q_id").alias("point_id"), "part", "residual", "reflection")


def alignment_verdict(scores: DataFrame, key: Sequence[str] = KEY, locked: float = 0.15, margin: float = 1.3) -> DataFrame:
    """key, frame, best, margin (runner-up over best), verdict."""
    best = scores.filter("frame_rank = 1").select(*key, "frame", F.col("chamfer").alias("best"))
    second = scores.filter("frame_rank = 2").select(*key, F.col("chamfer").alias("second"))
    ratio = F.col("second") / F.greatest(F.col("best"), F.lit(1e-12))
    return best.join(second, list(key)).select(*key, "frame", "best", ratio.alias("margin"), F.when((F.col("best") < locked) & (ratio > margin), "locked").otherwise("weak").alias("verdict"))


def frame_verdict(scores: DataFrame, probe: Column) -> DataFrame:
    """Mean over probe objects of each frame: best frame, its mean, and ok, weak or broken against the identity's."""
    mean = scores.filter(probe).groupBy("frame").agg(F.avg("chamfer").alias("mean"))
    ref = mean.filter("frame = 0").select(F.col("mean").alias("ref"))
    best = mean.agg(F.min(F.struct("mean", "frame")).alias("m")).select("m.frame", "m.mean")
    verdict = F.when(F.col("mean") < 0.6 * F.col("ref"), "ok").when(F.col("mean") < F.col("ref"), "weak").otherwise("broken")
    return best.crossJoin(ref).select("frame", "mean", "ref", verdict.alias("verdict"))  # a row on either side


def duplicate_faces(faces: DataFrame, threshold: float = 0.0, key: Sequence[str] = KEY) -> DataFrame:
    """``faces`` with ``drop``: of faces over the same vertices all but the best (ties: lowest id), and those below the threshold."""
    w = Window.partitionBy(*key, F.array_sort(F.array("v0", "v1", "v2"))).orderBy(F.desc("quality"), "face_id")
    return faces.withColumn("drop", (F.row_number().over(w) > 1) | (F.col("quality") < threshold))


def reconciled(faces: DataFrame, mesh: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Faces of a text file that a mesh library kept: file faces in order, matched greedily to mesh faces in order.

    key, face_id, dropped; objects whose mesh faces aren't a subsequence of the file's give no rows, and a face with a
    null vertex matches none. The walk through an object is sequential: Spark sorts, mesh faces first, and a task reads
    its objects as streams. Mesh faces wait in a temporary file of the task, so Python holds two batches, however large
    the object is. Rows are kept once, as only an object's last one tells whether all of it matched.
    """
    corners, side, fails = ["v0", "v1", "v2"], "__side", "__fails"

    def rows(b) -> list[tuple]:
        return list(zip(*(b[c].to_pylist() if b[c].null_count else b[c].to_numpy(zero_copy_only=False).tolist() for c in corners)))

    def waiting(file, first):
        """Mesh faces in order, read back batch by batch."""
        import pyarrow as pa

        file.seek(0)
        for b in pa.ipc.open_stream(file) if first is not None else ():
            yield from (x if None not in x else () for x in rows(b))

    def runs(batches):
        """Pieces of batches, each of one object and one side, and the number of the object."""
        import numpy as np
        import pandas as pd

        last, n = None, -1
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([pd.factorize(b[c].to_pandas(), use_na_sentinel=False)[0] for c in [*key, side]])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                piece = b.slice(i, j - i)
                this = [piece[c][0].as_py() for c in key]
                n += last is None or this != last[0]
                last = (this,)
                yield n, piece

    def walk(batches):
        import itertools
        import tempfile

        import pyarrow as pa

        for _, pieces in itertools.groupby(runs(batches), lambda x: x[0]):
            with tempfile.TemporaryFile() as file:
                sink = want = now = None
                for _, b in pieces:
                    if not b[side][0].as_py():
                        sink = sink or pa.ipc.new_stream(file, b.select(corners).schema)
                        sink.write_batch(b.select(corners))
                        continue
                    if sink is None:  # no mesh face
                        continue
                    if want is None:
                        sink.close()
                        want = waiting(file, sink)
                        now = next(want, None)
                    dropped = []
                    for x in rows(b):
                        same = x == now and None not in x
                        dropped.append(not same)
                        if same:
                            now = next(want, None)
                    yield pa.record_batch([*(b[c] for c in [*key, "face_id"]), pa.array(dropped, pa.bool_()), pa.array([False] * len(dropped), pa.bool_())], names=[*key, "face_id", "dropped", fails])
                    end = b.slice(b.num_rows - 1)
                if now is not None:
                    yield pa.record_batch([*(end[c] for c in [*key, "face_id"]), pa.array([True], pa.bool_()), pa.array([True], pa.bool_())], names=[*key, "face_id", "dropped", fails])

    of = lambda df, n: df.select(*key, "face_id", *corners, F.lit(n).alias(side))
    order = [*key, side, *[F.col(c).asc_nulls_last() for c in ("face_id", *corners)]]
    both = of(mesh, False).unionByName(of(faces, True)).repartition(*key).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faces.select(*key, "face_id").schema) + f", dropped boolean, {fails} boolean"
    walked = kept(both.mapInArrow(walk, schema))
    failed = walked.filter(fails).select(*[F.col(c).alias(f"__{c}") for c in key])
    unmatched = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    return walked.join(failed, unmatched, "left_anti").drop(fails)


def bounding_diagonal(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), F.lit(2.0)) for c in XYZ), F.lit(0.0))).alias("diagonal"))


def interpolated(query: DataFrame, ref: DataFrame, columns: Sequence[str], k: int = 3, key: Sequence[str] = KEY) -> DataFrame:
    """key, point_id, columns: means of the k nearest weighted by inverse distance."""
    e = nn.attach(nn.knn(query, ref, k, key), ref, "n_id", columns, "", key).withColumn("w", 1 / (F.sqrt("d2") + 1e-8))
    return e.groupBy(*key, F.col("q_id").alias("point_id")).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns])


def relative_edges(df: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Edges with offsets and length over the object's mean edge length."""
    e = nn.attach(nn.attach(nn.knn(df, df, k, key, include_self=False), df, "q_id", XYZ, "q_", key), df, "n_id", XYZ, "n_", key)
    mean = F.avg(F.sqrt("d2")).over(Window.partitionBy(*key))
    return e.withColumn("scale", mean).select(*key, "q_id", "n_id", "rank", *[((F.col(f"n_{c}") - F.col(f"q_{c}")) / F.col("scale")).alias(f"d{c}") for c in XYZ], (F.sqrt("d2") / F.col("scale")).alias("length"))


def union_known(visible: DataFrame, completed: DataFrame) -> DataFrame:
    return visible.withColumn("known", F.lit(True)).unionByName(completed.withColumn("known", F.lit(False)), allowMissingColumns=True)


def inpainting_input(visible: DataFrame, completed: DataFrame, drop_part: int | None = None, label: str = "part", key: Sequence[str] = KEY) -> DataFrame:
    """Both clouds in one unit sphere with ``known``; colours of unknown points are 0.

    With ``drop_part`` the points that ``label`` puts into that part are unknown too; let it be the true part, as a
    guess that never names the part would drop nothing. A null label drops nothing.
    """
    both = unit_sphere(union_known(visible, completed), key, 1e-9)
    if drop_part is not None:
        both = both.withColumn("known", F.col("known") & F.coalesce(F.col(label) != drop_part, F.lit(True)))
    return both.withColumns({c: F.when(F.col("known"), F.col(c)).otherwise(0.0) for c in ("r", "g", "b")})
