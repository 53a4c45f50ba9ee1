"""The whole benchmark as one plan: occlude, colour the missing region, score, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huepoint import models
from huepoint.operators import geometry, metrics

VIEWPOINT = (0.15, 0.55, -1.0)


def occluded(cloud: DataFrame, views: Sequence[Sequence[float]] = (VIEWPOINT,), difficulties=geometry.DIFFICULTIES) -> DataFrame:
    return geometry.sweep(cloud, views, difficulties)


def manifest(crops: DataFrame) -> DataFrame:
    """A row for each crop: counts of partial and missing points and the ratio."""
    missing = F.sum(F.col("is_missing").cast("long"))
    return crops.groupBy("object_id", "difficulty", "view").agg(F.first("ratio").alias("crop_ratio"), (F.count(F.lit(1)) - missing).alias("n_partial"), missing.alias("n_missing"))


def benchmark(cloud: DataFrame, parts: int, views: Sequence[Sequence[float]] = (VIEWPOINT,), least: int = 4) -> DataFrame:
    """object_id, difficulty, view and the baselines' differences of every crop; crops with fewer visible or missing points are left out."""
    key = ("object_id", "difficulty", "view")
    crops = occluded(cloud, views)
    fine = manifest(crops).filter((F.col("n_partial") >= least) & (F.col("n_missing") >= least)).select(*key)
    return metrics.baselines(crops.join(fine, list(key)), parts, key)


def by_difficulty(scores: DataFrame, methods: Sequence[str] = ("nn_copy", "part_mean", "ceiling")) -> DataFrame:
    order = F.when(F.col("difficulty") == "simple", 0).when(F.col("difficulty") == "moderate", 1).otherwise(2)
    return scores.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in methods]).orderBy(order)


def inpainted(crops: DataFrame, steps: int = 50, samples: int = 2, adaptive: bool = False) -> DataFrame:
    """``crops`` of one difficulty and view with pred_r, pred_g, pred_b from the conditional walk."""
    model = models.Inpainter(models.PartMeanNoise(), steps, 10, samples)
    if adaptive:  # the less is known of an object's worst part, the more often it resamples
        crops = crops.join(metrics.part_visibility(crops, samples).select("object_id", "resamples"), "object_id")
    return models.applied(crops, model, "pred_r double, pred_g double, pred_b double").drop("resamples")
