"""Noise schedules and the time-travel walk, as small tables; forward and backward steps as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cosine(spark: SparkSession, steps: int, s: float = 0.008) -> DataFrame:
    """t, beta."""
    f = lambda t: F.pow(F.cos((t / steps + s) / (1 + s) * (math.pi / 2)), F.lit(2.0))
    return spark.range(steps).select(F.col("id").alias("t"), F.greatest(F.least(1 - f(F.col("id") + 1) / f(F.col("id")), F.lit(0.999)), F.lit(1e-8)).alias("beta"))


def linear(spark: SparkSession, steps: int, lo: float = 1e-4, hi: float = 0.02) -> DataFrame:
    return spark.range(steps).select(F.col("id").alias("t"), (F.lit(lo) + (hi - lo) * F.col("id") / max(1, steps - 1)).alias("beta"))


def products(betas: DataFrame) -> DataFrame:
    """Adds alpha, abar (running product), abar_prev and the posterior's variance and weights; a schedule has some hundred rows."""
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s = betas.withColumn("alpha", 1 - F.col("beta")).withColumn("abar", F.exp(F.sum(F.log("alpha")).over(w)))
    s = s.withColumn("abar_prev", F.lag("abar", 1, 1.0).over(Window.orderBy("t")))
    rest = 1 - F.col("abar")
    return s.withColumns({"post_var": F.col("beta") * (1 - F.col("abar_prev")) / rest, "post_x0": F.col("beta") * F.sqrt("abar_prev") / rest, "post_xt": (1 - F.col("abar_prev")) * F.sqrt("alpha") / rest})


def noised(x: Column, noise: Column) -> Column:
    return F.sqrt("abar") * x + F.sqrt(1 - F.col("abar")) * noise


def denoised(eps: Column, xt: Column, noise: Column) -> tuple[Column, Column]:
    """One step back and the clean estimate."""
    x0 = F.greatest(F.least((xt - F.sqrt(1 - F.col("abar")) * eps) / F.sqrt("abar"), F.lit(1.0)), F.lit(-1.0))
    return F.col("post_x0") * x0 + F.col("post_xt") * xt + F.when(F.col("t") == 0, 0.0).otherwise(F.sqrt("post_var") * noise), x0


def jumped(x: Column, noise: Column) -> Column:
    return F.sqrt("alpha") * x + F.sqrt("beta") * noise


def walk_times(spark: SparkSession, steps: int, length: int, samples: int) -> DataFrame:
    """step, t: a countdown of ``steps`` times in which each multiple of ``length`` is followed by detours.

    A detour climbs ``length`` steps and comes down again; there are ``samples`` - 1 of them, and none at the
    multiples within ``length`` of the beginning. The last time is -1.
    """
    t, far = F.col("id"), F.col("id") + length
    detour = F.concat(F.sequence(t + 1, far), F.sequence(far - 1, t, F.lit(-1).cast("long")))
    stays = F.array(t)
    times = F.when((t % length == 0) & (t < steps - length), F.concat(stays, F.flatten(F.array_repeat(detour, samples - 1)))).otherwise(stays)
    blocks = spark.range(-1, steps).select("id", times.alias("times")).withColumn("size", F.size("times"))
    before = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each time of the schedule
    return blocks.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))).select("first", F.posexplode("times").alias("at", "t")).select((F.col("first") + F.col("at")).alias("step"), "t")


def walk(steps: int, length: int = 10, samples: int = 5) -> list[int]:
    """The times of ``walk_times`` for a task's own use."""
    detours = {m: samples - 1 for m in range(0, max(0, steps - length), length)}
    return [x for t in range(steps - 1, -1, -1) for x in (t, *([*range(t + 1, t + length), *range(t + length, t - 1, -1)] * detours.get(t, 0)))] + [-1]


def walk_steps(spark: SparkSession, steps: int, length: int = 10, samples: int = 5) -> DataFrame:
    """step, t, next_t, kind (denoise or jump)."""
    s = walk_times(spark, steps, length, samples).withColumn("next_t", F.lead("t").over(Window.orderBy("step"))).filter("next_t is not null")
    return s.withColumn("kind", F.when(F.col("next_t") < F.col("t"), "denoise").otherwise("jump"))


def ema(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """Last value of s = decay * s + (1 - decay) * v, from the first value, over each key's series."""
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("l"))
    return listed.select(key, F.aggregate(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), F.col("l")[0][value], lambda s, v: decay * s + (1 - decay) * v[value]).alias("ema"))
