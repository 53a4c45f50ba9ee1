"""The single entry for scoring a completed cloud, and what it is built of."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huepoint.functions.maths import uniform
from huepoint.operators import geometry, metrics, nn
from huepoint.operators.sampling import farthest_points

KEY, RGB = ("object_id",), ("r", "g", "b")
#: Fixed directions of unit length for colour distances.
DIRECTIONS = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.6, 0.8, 0.0), (0.0, 0.6, 0.8), (0.8, 0.0, 0.6), (0.6, -0.8, 0.0), (0.0, 0.6, -0.8))


def equalised(pred: DataFrame, ref: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Each prediction thinned by farthest points to its reference's size; smaller ones stay."""
    sized = pred.join(ref.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), list(key))
    columns = pred.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pred.schema)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        n = int(pdf["__n"].iloc[0])
        return (pdf if len(pdf) <= n else pdf.iloc[farthest_points(pdf[["x", "y", "z"]].to_numpy(float), n)])[columns]

    return sized.groupBy(*key).applyInPandas(thin, schema)


def scrambled(df: DataFrame, key: Sequence[str] = KEY, seed: int = 0) -> DataFrame:
    """The same places with the object's colours dealt anew by hash order."""
    w = Window.partitionBy(*key)
    place = df.drop(*RGB).withColumn("__k", F.row_number().over(w.orderBy("point_id")))
    colour = df.select(*key, *RGB, F.row_number().over(w.orderBy(uniform("point_id", seed=seed), "point_id")).alias("__k"))
    return place.join(colour, [*key, "__k"]).select(*df.columns)


def region_chance(pred: DataFrame, ref: DataFrame, seeds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """region_de76, that of scrambled colours, and their ratio (null where chance is at most 1)."""
    own = metrics.region_difference_weighted(pred, ref, seeds, key)
    chance = metrics.region_difference_weighted(scrambled(ref, key), ref, seeds, key).withColumnRenamed("region_de76", "chance")
    return own.join(chance, list(key)).withColumn("norm", F.when(F.col("chance") > 1, F.col("region_de76") / F.col("chance")))


def composite_loss(pred: DataFrame, ref: DataFrame, weight: float = 0.5, key: Sequence[str] = KEY) -> DataFrame:
    """Chamfer distance plus weighted mean absolute colour difference to the nearest reference point."""
    e = nn.attach(nn.attach(nn.nearest(pred, ref, key), pred, "q_id", RGB, "p_", key), ref, "n_id", RGB, "t_", key)
    colour = e.groupBy(*key).agg(F.avg(sum((F.abs(F.col(f"p_{c}") - F.col(f"t_{c}")) for c in RGB), F.lit(0.0)) / 3).alias("colour"))
    return geometry.chamfer(pred, ref, key).join(colour, list(key)).select(*key, "chamfer", "colour", (F.col("chamfer") + weight * F.col("colour")).alias("loss"))


def score(pred: DataFrame, ref: DataFrame, seeds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Equalise, then all metrics with the counts that they depend on."""
    p = equalised(pred, ref, key)
    out = metrics.completion(p, ref, key).join(metrics.sliced_wasserstein(p, ref, DIRECTIONS, RGB, key).withColumnRenamed("swd", "colour_swd"), list(key))
    return out.join(metrics.region_difference(p, ref, seeds, key).drop("cells"), list(key), "left")
