"""Grouped tables, part means, histograms, classification reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.operators import ordered
from huepoint.store import kept

KEY, RGB = ("object_id",), ("r", "g", "b")


def grid_means(df: DataFrame, keys: Sequence[str], means: Sequence[str], firsts: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in firsts], *[F.avg(c).alias(c) for c in means])


def percentiles(df: DataFrame, value: str, points: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """keys and a column for each of ``points``: exact, interpolated, as ``F.percentile``; a group of any size is spread over tasks by ranges of value."""
    counts = kept(df.select(F.struct(*keys).alias("__key"), F.col(value).cast("double").alias("__v")).groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("__n")))  # a struct is no null
    sizes = counts.groupBy("__key").agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))), F.lit(0)).alias("__all"))
    at = ordered.earlier(counts.dropna(subset=["__v"]), F.col("__n"), ["__v"], "__before", key=["__key"]).join(F.broadcast(sizes), "__key")  # a row of each group
    spot = {n: (F.col("__all") - 1) * F.lit(float(p)) for n, p in points.items()}
    holds = lambda i: (F.col("__before") <= i) & (i < F.col("__before") + F.col("__n"))
    ends = {f"{n}_{e}": F.max(F.when(holds(f(x)), F.col("__v"))) for n, x in spot.items() for e, f in (("lo", F.floor), ("hi", F.ceil))}
    found = sizes.join(at.groupBy("__key").agg(*[c.alias(n) for n, c in ends.items()]), "__key", "left")
    between = lambda n: F.when(F.col(f"{n}_lo") == F.col(f"{n}_hi"), F.col(f"{n}_lo")).otherwise((F.ceil(spot[n]) - spot[n]) * F.col(f"{n}_lo") + (spot[n] - F.floor(spot[n])) * F.col(f"{n}_hi"))
    return found.select("__key.*", *[between(n).alias(n) for n in points])


def two_stage_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean of the inner groups' means."""
    return df.groupBy(*{*inner, *outer}).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias(value), F.count(F.lit(1)).alias("n"))


def part_means(df: DataFrame, parts: int, where: Column | None = None, columns: Sequence[str] = RGB, key: Sequence[str] = KEY) -> DataFrame:
    """key, part (0 to parts - 1), n, columns: means of the part's rows that ``where`` holds for, the object's where it has none."""
    own = df if where is None else df.filter(where)
    whole = own.groupBy(*key).agg(*[F.avg(c).alias(f"all_{c}") for c in columns])
    by = own.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    domain = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return domain.join(by, [*key, "part"], "left").select(*key, "part", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(c, f"all_{c}").alias(c) for c in columns])


def pooled(df: DataFrame, columns: Sequence[str] = RGB, key: Sequence[str] = (*KEY, "part"), how: str = "avg") -> DataFrame:
    """Each row with its group's mean (or max) of the columns, as pool_<column>."""
    w = Window.partitionBy(*key)
    return df.withColumns({f"pool_{c}": getattr(F, how)(c).over(w) for c in columns})


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))


def histogram3d(df: DataFrame, bins: int = 8, columns: Sequence[str] = RGB, key: Sequence[str] = KEY) -> DataFrame:
    """key, three bins, share of the object's rows."""
    named = [F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).alias(f"bin_{c}") for c in columns]
    counts = df.groupBy(*key, *named).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def bincount(df: DataFrame, column: str, length: int, key: Sequence[str] = KEY) -> DataFrame:
    counts = df.groupBy(*key, column).agg(F.count(F.lit(1)).alias("n"))
    domain = df.select(*key).distinct().withColumn(column, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    return domain.join(counts, [*key, column], "left").select(*key, column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def most_common(df: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """The k most frequent values (ties: smallest) with counts, the rest summed as ``other``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(k).select(column).withColumn("__top", F.lit(True))
    return counts.join(top, column, "left").groupBy(F.when(F.col("__top"), F.col(column).cast("string")).otherwise(other).alias(column)).agg(F.sum("n").alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """A row for each true class with the share predicted as each class."""
    table = df.groupBy(truth).pivot(predicted, list(classes)).count()
    total = sum((F.coalesce(F.col(str(c)), F.lit(0)) for c in classes), F.lit(0))
    return table.select(truth, *[(F.coalesce(F.col(str(c)), F.lit(0)) / total).alias(f"p{c}") for c in classes])


def accuracy(df: DataFrame, truth: str, predicted: str, key: Sequence[str] = KEY) -> DataFrame:
    """One row: objects, points, the share of right points of all (``by_point``) and the mean of each object's share (``by_object``)."""
    each = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(truth) == F.col(predicted), 1).otherwise(0)).alias("right"))
    return each.agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("points"), (F.sum("right") / F.sum("n")).alias("by_point"), F.avg(F.col("right") / F.col("n")).alias("by_object"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1, error_rate."""
    both = F.explode(F.array_distinct(F.array(truth, predicted))).alias("class")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.select(both, truth, predicted).groupBy("class").agg(one(F.col(truth) == F.col("class")).alias("support"), one(F.col(predicted) == F.col("class")).alias("chosen"), one((F.col(truth) == F.col("class")) & (F.col(predicted) == F.col("class"))).alias("hits"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    c = c.withColumns({"precision": ratio("hits", "chosen"), "recall": ratio("hits", "support")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.select("class", "support", "precision", "recall", f1.alias("f1"), (1 - F.col("recall")).alias("error_rate"))


def roc_auc(df: DataFrame, label: str, score: str, key: Sequence[str] = ()) -> DataFrame:
    """Area under the curve from counts by score, ties shared; nulls where a class is missing."""
    by = df.groupBy(*key, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    inner = list(key)
    if not key:  # ranges of scores: each adds up its own pairs, and their sums make the pairs across
        inner = ["__range"]
        by = by.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), score).withColumn("__range", F.spark_partition_id())
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*inner).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = by.withColumn("below", below).groupBy(*inner).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    if not key:
        before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
        part = part.withColumn("area", F.col("area") + F.col("p") * before).agg(*[F.sum(c).alias(c) for c in ("area", "p", "n")])
    return part.select(*key, (F.col("area") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def win_ledger(df: DataFrame, baseline: str, methods: Sequence[str]) -> DataFrame:
    """method, wins: cells in which it is below the baseline."""
    stack = F.expr("stack({}, {}) as (method, value)".format(len(methods), ", ".join(f"'{m}', `{m}`" for m in methods)))
    return df.select(F.col(baseline).alias("base"), stack).groupBy("method").agg(F.sum(F.when(F.col("value") < F.col("base"), 1).otherwise(0)).alias("wins"), F.count("value").alias("cells"))


def margin_bins(df: DataFrame, baseline: str, ceiling: str, method: str, edges: tuple[float, float] = (8.0, 2.0)) -> DataFrame:
    """How far the ceiling is below the baseline, in bins, with cells, wins and mean gap of the method."""
    room = F.col(baseline) - F.col(ceiling)
    bin_ = F.when(room > edges[0], "wide").when(room >= edges[1], "narrow").otherwise("none")
    gap = F.col(method) - F.col(baseline)
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.when(gap < 0, 1).otherwise(0)).alias("wins"), F.avg(gap).alias("mean_gap"))


def overall_and_by(df: DataFrame, over: str, by: str, value: str) -> DataFrame:
    """Means by ``over`` alone (``by`` null) and by both, in one pass."""
    return df.groupingSets([[over], [over, by]], over, by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """channel, lo, hi, mean, std (population) of each column."""
    stack = F.expr("stack({}, {}) as (channel, value)".format(len(columns), ", ".join(f"'{c}', `{c}`" for c in columns)))
    return df.select(stack).groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
