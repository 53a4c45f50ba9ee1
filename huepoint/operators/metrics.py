"""Geometry and colour metrics of a predicted cloud against a reference, keyed by object."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.functions.colour import with_ciede2000, with_lab
from huepoint.functions.maths import half_even
from huepoint.operators import nn
from huepoint.operators.aggregate import histogram3d, part_means

KEY, RGB, LAB = ("object_id",), ("r", "g", "b"), ("lab_l", "lab_a", "lab_b")

#: Direction of each metric: whether lower or higher values are better, or those near one.
METRICS = {"cd_l1": "lower", "cd_l2": "lower", "fscore": "higher", "de00_sym": "lower", "de00_matched": "lower", "match_rate": "higher", "colour_swd": "lower", "region_de": "lower", "edge_iou": "higher", "psnr": "higher", "consistency_ratio": "target1"}


def _lab_of(side: str) -> list[str]:
    return [f"{side}_{c}" for c in LAB]


def matched(pred: DataFrame, ref: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, q_id, n_id, d, de00: each of pred's points with its nearest of ref. Both need Lab columns."""
    e = nn.nearest(pred, ref, key)
    e = nn.attach(nn.attach(e, pred, "q_id", LAB, "p_", key), ref, "n_id", LAB, "t_", key)
    return with_ciede2000(e, _lab_of("p"), _lab_of("t")).select(*key, "q_id", "n_id", "d", "de00")


def completion(pred: DataFrame, ref: DataFrame, key: Sequence[str] = KEY, tau: float = 0.01, match: float = 0.02, least: int = 8) -> DataFrame:
    """Counts, Chamfer distances, F-score, colour differences both ways, matched share and its difference."""
    p, t = with_lab(pred), with_lab(ref)
    stats = lambda e, s: e.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg("d").alias(f"d_{s}"), F.avg(F.col("d") * F.col("d")).alias(f"dd_{s}"), F.avg((F.col("d") < tau).cast("double")).alias(f"near_{s}"), F.avg("de00").alias(f"de_{s}"), F.avg((F.col("d") < match).cast("double")).alias(f"match_{s}"), F.avg(F.when(F.col("d") < match, F.col("de00"))).alias(f"mde_{s}"), F.sum((F.col("d") < match).cast("int")).alias(f"mn_{s}"))
    j = stats(matched(p, t, key), "p").join(stats(matched(t, p, key), "t"), list(key))
    both = F.col("near_p") + F.col("near_t")
    return j.select(
        *key, F.col("n_p").alias("n_pred"), F.col("n_t").alias("n_ref"), (F.col("d_p") + F.col("d_t")).alias("cd_l1"), (F.col("dd_p") + F.col("dd_t")).alias("cd_l2"),
        F.when(both > 0, 2 * F.col("near_p") * F.col("near_t") / both).otherwise(0.0).alias("fscore"), F.col("de_t").alias("de00_ref2pred"), F.col("de_p").alias("de00_pred2ref"), ((F.col("de_p") + F.col("de_t")) / 2).alias("de00_sym"),
        F.col("match_t").alias("match_rate"), F.when(F.col("mn_t") >= least, F.col("mde_t")).alias("de00_matched"),
    )


def geometry_errors(pred: DataFrame, ref: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Of clouds whose points correspond by id; colours are the reference's.

    mse over coordinates, p2p and p2p_p95 of the distances of corresponding points, cd_l1, cd_l2, and
    coloured_chamfer: mean CIE76 between a point's colour and that of the reference point nearest to its prediction.
    """
    lab = with_lab(ref)
    side = lambda df, s: df.select(*key, "point_id", *[F.col(c).alias(f"{s}_{c}") for c in nn.XYZ])
    gap = side(pred, "q").join(side(ref, "n"), [*key, "point_id"]).withColumn("d2", nn.square_distance())
    own = gap.groupBy(*key).agg((F.avg("d2") / 3).alias("mse"), F.avg(F.sqrt("d2")).alias("p2p"), F.percentile(F.sqrt("d2"), 0.95).alias("p2p_p95"))
    there, back = nn.nearest(pred, ref, key), nn.nearest(ref, pred, key)
    e = nn.attach(nn.attach(there, lab, "q_id", LAB, "p_", key), lab, "n_id", LAB, "t_", key)
    colour = F.sqrt(sum((F.pow(F.col(f"p_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in LAB), F.lit(0.0)))
    one = e.groupBy(*key).agg(F.avg("d").alias("a1"), F.avg(F.col("d") * F.col("d")).alias("a2"), F.avg(colour).alias("coloured_chamfer"))
    two = back.groupBy(*key).agg(F.avg("d").alias("b1"), F.avg(F.col("d") * F.col("d")).alias("b2"))
    return own.join(one, list(key)).join(two, list(key)).select(*key, "mse", "p2p", "p2p_p95", (F.col("a1") + F.col("b1")).alias("cd_l1"), (F.col("a2") + F.col("b2")).alias("cd_l2"), "coloured_chamfer")


def coverage(df: DataFrame, probes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, coverage: mean distance of surface probes to the cloud, over the diagonal of the probes' box."""
    box = probes.groupBy(*key).agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), F.lit(2.0)) for c in nn.XYZ), F.lit(0.0))).alias("diagonal"))
    near = nn.nearest(probes, df, key).groupBy(*key).agg(F.avg("d").alias("d"))
    return near.join(box, list(key)).select(*key, (F.col("d") / F.nullif(F.col("diagonal"), F.lit(0.0))).alias("coverage"))


def part_ceiling(df: DataFrame, least: int = 11, key: Sequence[str] = KEY, profile: str = "spec7") -> DataFrame:
    """key, parts, ceiling: mean over the parts of ``least`` points or more of CIE76 to the part's mean colour."""
    means = [f"m_{c}" for c in RGB]
    g = [*key, "part"]
    j = df.join(df.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"m_{c}") for c in RGB]).filter(F.col("__n") >= least), g)
    j = with_lab(with_lab(j, RGB, _lab_of("t"), profile), means, _lab_of("m"), profile)
    d = F.sqrt(sum((F.pow(F.col(f"m_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in LAB), F.lit(0.0)))
    return j.groupBy(*g).agg(F.avg(d).alias("d")).groupBy(*key).agg(F.count(F.lit(1)).alias("parts"), F.avg("d").alias("ceiling"))


def fully_occluded(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, fully_occluded: whether a part has missing points and no visible one."""
    by = df.groupBy(*key, "part").agg(F.every("is_missing").alias("gone"))
    return by.groupBy(*key).agg(F.some("gone").alias("fully_occluded"))


def part_edges(df: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """key, q_id, n_id: those of the k nearest that are of the point's part; itself where there are none."""
    e = nn.knn(df, df, k, key, include_self=False)
    e = nn.attach(nn.attach(e, df, "q_id", ("part",), "p_", key), df, "n_id", ("part",), "t_", key).filter("p_part = t_part")
    own = df.select(*key, F.col("point_id").alias("q_id"))
    return own.join(e.select(*key, "q_id", "n_id"), [*key, "q_id"], "left").select(*key, "q_id", F.coalesce("n_id", "q_id").alias("n_id"))


def directions(n: int = 64, seed: int = 12345) -> list[list[float]]:
    """n unit vectors of colour space from a seed, for ``sliced_wasserstein``."""
    v = np.random.default_rng(seed).standard_normal((n, 3))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


def sliced_wasserstein(a: DataFrame, b: DataFrame, directions: Sequence[Sequence[float]], columns: Sequence[str] = RGB, key: Sequence[str] = KEY) -> DataFrame:
    """key, swd: mean gap of the sorted projections, at as many evenly spaced ranks as the smaller cloud has points."""
    dirs = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), *[F.lit(float(v)).alias(f"d{j}") for j, v in enumerate(d)]) for i, d in enumerate(directions)])).alias("__d")

    def ranks(df: DataFrame, s: str) -> DataFrame:
        p = df.select(*key, "point_id", *columns, dirs).withColumn("v", sum((F.col(c) * F.col(f"__d.d{j}") for j, c in enumerate(columns)), F.lit(0.0)))
        w = Window.partitionBy(*key, "dir")
        return p.select(*key, F.col("__d.dir").alias("dir"), "v", "point_id").withColumns({"rank": F.row_number().over(w.orderBy("v", "point_id")) - 1, f"n_{s}": F.count(F.lit(1)).over(w)}).select(*key, "dir", "rank", F.col("v").alias(f"v_{s}"), f"n_{s}")

    x, y = ranks(a, "a"), ranks(b, "b")
    sizes = x.select(*key, "dir", "n_a").distinct().join(y.select(*key, "dir", "n_b").distinct(), [*key, "dir"])
    slots = sizes.withColumn("n", F.least("n_a", "n_b")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda n: half_even(F.when(F.col("n") > 1, F.col("i") * (F.col(n) - 1) / (F.col("n") - 1)).otherwise(0.0)).cast("int")
    slots = slots.select(*key, "dir", "i", at("n_a").alias("ra"), at("n_b").alias("rb"))
    j = slots.join(x.select(*key, "dir", F.col("rank").alias("ra"), "v_a"), [*key, "dir", "ra"]).join(y.select(*key, "dir", F.col("rank").alias("rb"), "v_b"), [*key, "dir", "rb"])
    return j.groupBy(*key).agg(F.avg(F.abs(F.col("v_a") - F.col("v_b"))).alias("swd"))


def regions(df: DataFrame, seeds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``df`` with ``cell``: the nearest seed point's id."""
    near = nn.nearest(df, seeds, key).select(*key, F.col("q_id").alias("point_id"), F.col("n_id").alias("cell"))
    return df.join(near, [*key, "point_id"])


def region_difference(pred: DataFrame, ref: DataFrame, seeds: DataFrame, key: Sequence[str] = KEY, least: int = 4) -> DataFrame:
    """key, region_de: unweighted mean CIEDE2000 of the cells' mean Lab, over cells of both; null for few cells."""
    mean = lambda df, s: regions(with_lab(df), seeds, key).groupBy(*key, "cell").agg(*[F.avg(c).alias(f"{s}_{c}") for c in LAB])
    j = with_ciede2000(mean(pred, "p").join(mean(ref, "t"), [*key, "cell"]), _lab_of("p"), _lab_of("t"))
    return j.groupBy(*key).agg(F.count(F.lit(1)).alias("cells"), F.avg("de00").alias("m")).select(*key, "cells", F.when(F.col("cells") >= least, F.col("m")).alias("region_de"))


def region_difference_weighted(pred: DataFrame, ref: DataFrame, seeds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, region_de76: point-weighted mean Lab distance of the cells' mean colours, converted after averaging."""
    cells = regions(ref, seeds, key).select(*key, "point_id", "cell")
    mean = lambda df, s: with_lab(df.join(cells, [*key, "point_id"]).groupBy(*key, "cell").agg(F.count(F.lit(1)).alias(f"{s}_n"), *[F.avg(c).alias(f"{s}_{c}") for c in RGB]), [f"{s}_{c}" for c in RGB], _lab_of(s))
    d = F.sqrt(sum((F.pow(F.col(f"p_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in LAB), F.lit(0.0)))
    return mean(pred, "p").join(mean(ref, "t"), [*key, "cell"]).withColumn("d", d).groupBy(*key).agg((F.sum(F.col("d") * F.col("t_n")) / F.sum("t_n")).alias("region_de76"))


def graph(df: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Edges to the k nearest others with colours, Lab, parts and differences of both ends."""
    columns = (*RGB, *LAB, "part")
    lab = with_lab(df)
    e = nn.attach(nn.attach(nn.knn(df, df, k, key, include_self=False), lab, "q_id", columns, "p_", key), lab, "n_id", columns, "t_", key)
    rgb = F.sqrt(sum((F.pow(F.col(f"p_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in RGB), F.lit(0.0)))
    return with_ciede2000(e, _lab_of("p"), _lab_of("t")).withColumns({"d_rgb": rgb, "same": F.col("p_part") == F.col("t_part")})


def vertices(edges: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, q_id, boundary (a neighbour of another part), strength and contrast (largest difference in RGB and CIEDE2000), rough (mean RGB difference)."""
    return edges.groupBy(*key, "q_id").agg(F.max((~F.col("same")).cast("int")).cast("boolean").alias("boundary"), F.max("d_rgb").alias("strength"), F.max("de00").alias("contrast"), F.avg("d_rgb").alias("rough"))


def above(df: DataFrame, column: str, percentile: float, key: Sequence[str] = KEY) -> Column:
    return F.percentile(column, percentile).over(Window.partitionBy(*key))


def edge_iou(pred: DataFrame, ref: DataFrame, k: int = 8, key: Sequence[str] = KEY, percentile: float = 0.9, shared: bool = False) -> DataFrame:
    """key, edge_iou of the points of strong colour edges.

    Each side above its own percentile of CIEDE2000 contrast (or equal); with ``shared`` both above the reference's of RGB contrast.
    """
    value = "strength" if shared else "contrast"
    side = lambda df, s: vertices(graph(df, k, key), key).withColumn("thr", above(df, value, percentile, key)).select(*key, "q_id", F.col(value).alias(f"{s}_v"), F.col("thr").alias(f"{s}_thr"))
    j = side(pred, "p").join(side(ref, "t"), [*key, "q_id"])
    limit = F.greatest(F.col("t_thr"), F.lit(1e-6))
    p, t = (F.col("p_v") > limit, F.col("t_v") > limit) if shared else (F.col("p_v") >= F.col("p_thr"), F.col("t_v") >= F.col("t_thr"))
    n = lambda c: F.sum(c.cast("int"))
    return j.groupBy(*key).agg((n(p & t) / F.nullif(n(p | t), F.lit(0))).alias("edge_iou"))


def histogram_chi2(pred: DataFrame, ref: DataFrame, bins: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    cells = [*key, *[f"bin_{c}" for c in RGB]]
    h = lambda df, s: histogram3d(df, bins, RGB, key).select(*cells, F.col("share").alias(s))
    j = h(pred, "p").join(h(ref, "t"), cells, "full").fillna(0.0, ["p", "t"])
    return j.groupBy(*key).agg((0.5 * F.sum(F.pow(F.col("p") - F.col("t"), F.lit(2.0)) / (F.col("p") + F.col("t") + 1e-12))).alias("chi2"))


def spreads(df: DataFrame, parts: str = "part", key: Sequence[str] = KEY, least: int = 1) -> DataFrame:
    """Mean distance of Lab to the object's mean (v_global) and to part means (micro, weighted by points, and macro), and n_parts; parts below ``least`` points don't count."""
    lab = with_lab(df)
    spread = lambda g: F.sqrt(sum((F.pow(F.col(c) - F.avg(c).over(Window.partitionBy(*g)), F.lit(2.0)) for c in LAB), F.lit(0.0)))
    d = lab.withColumns({"__g": spread(key), "__p": spread([*key, parts])})
    by = d.groupBy(*key, parts).agg(F.avg("__p").alias("v"), F.count(F.lit(1)).alias("w"), F.sum("__g").alias("g")).withColumn("ok", F.col("w") >= least)
    return by.groupBy(*key).agg((F.sum("g") / F.sum("w")).alias("v_global"), (F.sum(F.when(F.col("ok"), F.col("v") * F.col("w"))) / F.sum(F.when(F.col("ok"), F.col("w")))).alias("micro"), F.avg(F.when(F.col("ok"), F.col("v"))).alias("macro"), F.sum(F.col("ok").cast("long")).alias("n_parts"))


def dispersion(df: DataFrame, parts: str = "part", key: Sequence[str] = KEY, least: int = 1) -> DataFrame:
    """Spread of Lab around part means against the object's: v_global, r_micro (weighted by points), r_macro, n_parts; null spreads below two parts."""
    fine = (F.col("n_parts") >= 2) & (F.col("v_global") >= 1e-9)
    return spreads(df, parts, key, least).select(*key, "v_global", F.when(fine, F.col("micro") / F.col("v_global")).alias("r_micro"), F.when(fine, F.col("macro") / F.col("v_global")).alias("r_macro"), "n_parts")


def headroom(df: DataFrame, parts: int, profile: str = "cie4", key: Sequence[str] = KEY) -> DataFrame:
    """oracle (difference to part means), global_mean, headroom, ratio of each object."""
    whole = df.groupBy(*key).agg(*[F.avg(c).alias(f"w_{c}") for c in RGB])
    j = df.join(part_means(df, parts, key=key).select(*key, "part", *[F.col(c).alias(f"m_{c}") for c in RGB]), [*key, "part"]).join(whole, list(key))
    for s in ("", "m_", "w_"):
        j = with_lab(j, [s + c for c in RGB], [f"{s}lab{i}" for i in range(3)], profile)
    d = lambda s: F.sqrt(sum((F.pow(F.col(f"{s}lab{i}") - F.col(f"lab{i}"), F.lit(2.0)) for i in range(3)), F.lit(0.0)))
    out = j.withColumns({"__o": d("m_"), "__w": d("w_")}).groupBy(*key).agg(F.avg("__o").alias("oracle"), F.avg("__w").alias("global_mean"))
    return out.withColumns({"headroom": F.col("global_mean") - F.col("oracle"), "ratio": F.col("oracle") / F.nullif(F.col("global_mean"), F.lit(0.0))})


def baselines(df: DataFrame, parts: int, key: Sequence[str] = KEY, profile: str = "spec7") -> DataFrame:
    """Differences (CIE76) of simple colourings of the missing region: nearest visible, part mean, part mean of all, global mean; also wrong_part_frac.

    ``df`` has is_missing. Parts without visible points take the visible points' mean.
    """
    visible, missing = df.filter(~F.col("is_missing")), df.filter("is_missing")
    e = nn.nearest(missing, visible, key)
    e = nn.attach(nn.attach(e, missing, "q_id", (*RGB, "part"), "t_", key), visible, "n_id", (*RGB, "part"), "n_", key)
    means = lambda d, s: part_means(d, parts, key=key).select(*key, F.col("part").alias("t_part"), *[F.col(c).alias(f"{s}_{c}") for c in RGB])
    whole = visible.groupBy(*key).agg(*[F.avg(c).alias(f"g_{c}") for c in RGB])
    e = e.join(means(visible, "p"), [*key, "t_part"]).join(means(df, "c"), [*key, "t_part"]).join(whole, list(key))
    for s in "tnpcg":
        e = with_lab(e, [f"{s}_{c}" for c in RGB], _lab_of(s), profile)
    d = lambda s: F.avg(F.sqrt(sum((F.pow(F.col(f"{s}_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in LAB), F.lit(0.0))))
    return e.groupBy(*key).agg(F.count(F.lit(1)).alias("n_missing"), d("n").alias("nn_copy"), d("p").alias("part_mean"), d("c").alias("ceiling"), d("g").alias("global_mean"), F.avg((F.col("n_part") != F.col("t_part")).cast("double")).alias("wrong_part_frac"))


def part_visibility(df: DataFrame, samples: int, key: Sequence[str] = KEY) -> DataFrame:
    """key, worst (least visible share of a part), anchorless (parts without visible points), resamples."""
    by = df.groupBy(*key, "part").agg(F.avg((~F.col("is_missing")).cast("double")).alias("vis"))
    out = by.groupBy(*key).agg(F.min("vis").alias("worst"), F.sum((F.col("vis") == 0).cast("long")).alias("anchorless"))
    return out.withColumn("resamples", F.greatest(F.lit(1), F.least(F.lit(2 * samples), half_even(samples * (1.5 - F.col("worst"))).cast("int"))))


#: The spread of channels below which a cloud counts as uncoloured, and the residual above which an alignment is weak.
LEAST_SPREAD, MOST_RESIDUAL = 0.01, 0.15


def colour_quality(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, n, color_std (population spread of all channels' values together), color_ok."""
    values = df.select(*key, F.explode(F.array(*RGB)).alias("v"))
    out = values.groupBy(*key).agg((F.count(F.lit(1)) / len(RGB)).cast("long").alias("n"), F.stddev_pop("v").alias("color_std"))
    return out.withColumn("color_ok", F.col("color_std") > LEAST_SPREAD)


def weak(residual: str = "residual") -> Column:
    """Whether an alignment's residual is too large to trust."""
    return F.col(residual) > MOST_RESIDUAL


def colour_gradient(df: DataFrame, k: int = 16, key: Sequence[str] = KEY) -> DataFrame:
    """key, point_id, gradient: distance of each colour to the mean of the k nearest others'; 0 for a point alone."""
    e = nn.attach(nn.knn(df, df, k, key, include_self=False), df, "n_id", RGB, "n_", key)
    m = e.groupBy(*key, F.col("q_id").alias("point_id")).agg(*[F.avg(f"n_{c}").alias(f"n_{c}") for c in RGB])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"n_{c}"), F.lit(2.0)) for c in RGB), F.lit(0.0)))
    return df.join(m, [*key, "point_id"], "left").select(*key, "point_id", F.coalesce(d, F.lit(0.0)).alias("gradient"))


def fidelity(df: DataFrame, surface: DataFrame, k: int = 12, key: Sequence[str] = KEY) -> DataFrame:
    """speckle (mean channel spread of the k nearest, itself included), uniformity (variation of nearest distances), p2f (mean distance to the surface)."""
    e = nn.attach(nn.knn(df, df, k, key), df, "n_id", RGB, "n_", key)
    nearest = F.max(F.when(F.col("rank") == 2, F.sqrt("d2")))  # the first is the point itself
    per = e.groupBy(*key, "q_id").agg(((F.stddev_pop("n_r") + F.stddev_pop("n_g") + F.stddev_pop("n_b")) / 3).alias("s"), nearest.alias("d"))
    a = per.groupBy(*key).agg(F.avg("s").alias("speckle"), (F.stddev_pop("d") / (F.avg("d") + 1e-12)).alias("uniformity"), F.count("d").alias("n"))
    c = nn.surface_distance(df, surface, key).groupBy(*key).agg(F.avg("d").alias("p2f"))
    return a.filter("n > 0").drop("n").join(c, list(key))


def pointwise(pred: DataFrame, ref: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """rgb_mae, rgb_mse, psnr, de76, de76_p95, de00 of clouds whose points correspond by id."""
    p, t = with_lab(pred), with_lab(ref)
    s = lambda df, n: df.select(*key, "point_id", *[F.col(c).alias(f"{n}_{c}") for c in (*RGB, *LAB)])
    j = with_ciede2000(s(p, "p").join(s(t, "t"), [*key, "point_id"]), _lab_of("t"), _lab_of("p"))
    err = [F.col(f"p_{c}") - F.col(f"t_{c}") for c in RGB]
    j = j.withColumns({"mae": sum((F.abs(x) for x in err), F.lit(0.0)) / 3, "mse": sum((x * x for x in err), F.lit(0.0)) / 3, "de76": F.sqrt(sum((F.pow(F.col(f"p_{c}") - F.col(f"t_{c}"), F.lit(2.0)) for c in LAB), F.lit(0.0)))})
    out = j.groupBy(*key).agg(F.avg("mae").alias("rgb_mae"), F.avg("mse").alias("rgb_mse"), F.avg("de76").alias("de76"), F.percentile("de76", 0.95).alias("de76_p95"), F.avg("de00").alias("de00"))
    return out.withColumn("psnr", 10 * F.log10(1 / F.greatest("rgb_mse", F.lit(1e-12))))


def squared_error(df: DataFrame, predicted: Sequence[str], wanted: Sequence[str], key: Sequence[str] = ("object_id",)) -> DataFrame:
    """key, mse: mean squared difference of predicted and wanted noise over an object's points and channels."""
    each = sum((F.pow(F.col(p) - F.col(w), F.lit(2.0)) for p, w in zip(predicted, wanted)), F.lit(0.0)) / len(predicted)
    return df.groupBy(*key).agg(F.avg(each).alias("mse"))
