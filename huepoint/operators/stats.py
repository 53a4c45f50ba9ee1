"""Paired statistics: improvements, bootstrap intervals, signed ranks, correlations, gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huepoint.functions.maths import uniform
from huepoint.operators import ordered
from huepoint.store import kept


def paired(df: DataFrame, base: str, other: str, obj: str = "obj", method: str = "method", value: str = "metric", key: Sequence[str] = ()) -> DataFrame:
    """key, obj, a, b: means of the two methods for objects that have both."""
    m = df.groupBy(*key, obj).agg(F.avg(F.when(F.col(method) == base, F.col(value))).alias("a"), F.avg(F.when(F.col(method) == other, F.col(value))).alias("b"))
    return m.dropna(subset=["a", "b"])


def _sign(direction: str) -> float:
    return -1.0 if direction == "lower" else 1.0


def improvement(pairs: DataFrame, direction: str = "lower", key: Sequence[str] = (), least: int = 5) -> DataFrame:
    """n, baseline, conditioned, improvement (percent of the baseline, or absolute where that is about zero), scale, win_rate."""
    sign, a = _sign(direction), F.avg("a")
    rel = F.abs(a) > 1e-12
    diff = sign * (F.avg("b") - a)
    out = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), a.alias("baseline"), F.avg("b").alias("conditioned"), F.when(rel, diff * 100 / F.abs(a)).otherwise(diff).alias("improvement"), F.when(rel, "%").otherwise("abs").alias("scale"), F.avg((sign * (F.col("b") - F.col("a")) > 0).cast("double")).alias("win_rate"))
    return out.filter(F.col("n") >= least)


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    end = np.append(first[1:], len(s))
    out = np.empty(len(x))
    out[order] = np.repeat((first + 1 + end) / 2, end - first)
    return out


def wilcoxon(a: np.ndarray, b: np.ndarray, exact_up_to: int = 25) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact for few untied differences, else normal with tie correction; nan without differences."""
    d = (a - b)[a != b]
    n = len(d)
    if not n:
        return math.nan, math.nan
    r = average_ranks(np.abs(d))
    up, down = r[d > 0].sum(), r[d < 0].sum()
    w = min(up, down)
    if n <= exact_up_to and len(np.unique(np.abs(d))) == n and n == len(a):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + np.concatenate([ways[:-i]])
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum()))
    _, ties = np.unique(np.abs(d), return_counts=True)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ((ties**3 - ties).sum()) / 2) / 24)
    z = (w - n * (n + 1) / 4) / spread if spread else 0.0
    return float(w), float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


#: How often a pair counts in a draw at most; more has a probability of 1e-12.
MOST_TIMES = 14
#: Poisson's distribution of mean 1: the probability of at most 0, 1, 2 ... times.
AT_MOST = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(MOST_TIMES)]


def resampled(pairs: DataFrame, key: Sequence[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """key, draw, a, b: means of pairs drawn with replacement (``pairs(key, obj, a, b)``).

    Each pair counts in each draw as often as a Poisson number of mean 1 says, from a hash of draw and obj: the
    bootstrap for data in parts, whose draws have as many pairs as the key on average, not exactly. No pair needs a
    place among the others, so tasks weigh the pairs that they have and send a sum for each key and draw. Keys with
    the same objects draw alike; a draw without any pair has no row.
    """
    each = pairs.select(*key, "a", "b", "obj", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = uniform("draw", "obj", seed=seed)
    times = F.aggregate(F.array(*[F.lit(p) for p in AT_MOST]), F.struct(u.alias("u"), F.lit(0).alias("n")), lambda s, p: F.struct(s["u"].alias("u"), (s["n"] + (s["u"] >= p).cast("int")).alias("n")), lambda s: s["n"])
    weighed = each.withColumn("__n", times).filter("__n > 0")
    mean = lambda c: (F.sum(F.col(c) * F.col("__n")) / F.sum("__n")).alias(c)
    return weighed.groupBy(*key, "draw").agg(mean("a"), mean("b"))


#: The interval's percentiles, and the draws that it needs at least.
PERCENTILES, LEAST_DRAWS = (0.025, 0.975), 20


def bootstrap_interval(pairs: DataFrame, key: Sequence[str], direction: str = "lower", draws: int = 2000, seed: int = 0, fixed: bool = False) -> DataFrame:
    """key, ci_lo, ci_hi of the improvement: each draw in percent of its own baseline, or with ``fixed`` all of the sample's.

    Where the sample's baseline is about zero the improvement is absolute; draws without a baseline give none.
    """
    sample = pairs.groupBy(*key).agg(F.abs(F.avg("a")).alias("base"))
    drawn = resampled(pairs, key, draws, seed).join(sample, list(key))
    unit = F.when(F.col("base") <= 1e-12, F.lit(1.0)).otherwise(100 / F.nullif(F.col("base") if fixed else F.abs("a"), F.lit(0.0)))
    each = drawn.select(*key, (_sign(direction) * (F.col("b") - F.col("a")) * unit).alias("x")).filter("x is not null and not isnan(x)")
    enough = F.count(F.lit(1)) >= LEAST_DRAWS
    return each.groupBy(*key).agg(*[F.when(enough, F.percentile("x", p)).alias(name) for p, name in zip(PERCENTILES, ("ci_lo", "ci_hi"))])


#: Fixed value: the pairs that a signed-rank p needs; fewer have none.
LEAST_SIGNED = 6

SIGNED = "n long, statistic double, wilcoxon_p double"


def compared(pairs: DataFrame, key: Sequence[str], direction: str = "lower", draws: int = 2000, least: int = 5, fixed: bool = False) -> DataFrame:
    """Interval, signed-rank test and verdict for each key of ``least`` pairs or more; a key's signed ranks fit one task."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = wilcoxon(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float))
        p = p if len(pdf) >= LEAST_SIGNED else math.nan
        return pd.DataFrame([[*k, len(pdf), w, p]], columns=[*key, "n", "statistic", "wilcoxon_p"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*key).schema)
    ranks = pairs.groupBy(*key).applyInPandas(one, f"{schema}, {SIGNED}").filter(F.col("n") >= least)
    out = ranks.join(bootstrap_interval(pairs, key, direction, draws, fixed=fixed), list(key), "left")
    return out.select(*key, "n", "ci_lo", "ci_hi", "statistic", "wilcoxon_p", verdict(words=("helps", "hurts", "unresolved")).alias("verdict"))


def verdict(lo: str = "ci_lo", hi: str = "ci_hi", words: Sequence[str] = ("helps", "hurts", "unresolved")) -> Column:
    return F.when(F.col(lo) > 0, words[0]).when(F.col(hi) < 0, words[1]).otherwise(words[2])


def vote(results: DataFrame, key: Sequence[str], least: int = 2) -> DataFrame:
    """key, helps, hurts, outcome of the metrics' verdicts: a side needs ``least`` and a majority."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    out = results.groupBy(*key).agg(n("helps").alias("helps"), n("hurts").alias("hurts"))
    return out.withColumn("outcome", F.when((F.col("helps") >= least) & (F.col("helps") > F.col("hurts")), "helps").when((F.col("hurts") >= least) & (F.col("hurts") > F.col("helps")), "hurts").otherwise("unresolved"))


def ranked(df: DataFrame, column: str, out: str, key: Sequence[str] = ()) -> DataFrame:
    """Adds average ranks (ties share their mean)."""
    if key:
        return df.withColumn(out, F.rank().over(Window.partitionBy(*key).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, column)) - 1) / 2)
    df = kept(df)  # values that are worked out again may differ in their last digits, and not meet
    by = ordered.value_counts(df, column, out="__n", before="__b").select(F.col(column).alias("__v"), (F.col("__b") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(by, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def correlations(df: DataFrame, x: str, y: str, key: Sequence[str] = ()) -> DataFrame:
    """n, pearson, spearman."""
    r = ranked(ranked(df.dropna(subset=[x, y]), x, "__rx", key), y, "__ry", key)
    return r.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n (all rows), pearson of the rows with both; NaN where a side is constant or NaN, null without rows."""
    m = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    both = lambda c: F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), c)
    # a constant side has no correlation, and ANSI mode no quotient
    got = m.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop(both(F.col("x"))).alias("sx"), F.stddev_pop(both(F.col("y"))).alias("sy"))
    spread = F.col("sx") * F.col("sy")
    return got.select("n", F.when(spread == 0, F.lit(float("nan"))).otherwise(F.col("c") / spread).alias("pearson"))


def with_p(df: DataFrame, correlation: str, n: str, out: str) -> DataFrame:
    """``df(correlation, n)`` with the correlation's two-sided p; null below three rows or without a correlation."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(x, int(m)) if x == x and m == m else math.nan for x, m in zip(r.astype(float), n.astype(float))], dtype=float)

    return df.withColumn(out, F.nanvl(p(correlation, n), F.lit(None).cast("double")))


def bars(df: DataFrame, value: str, key: Sequence[str], obj: str = "obj", draws: int = 2000, seed: int = 0, least: int = 3) -> DataFrame:
    """key, n, mean of the objects' means, and how far its bootstrap interval reaches below and above; keys of ``least`` objects or more."""
    per = df.groupBy(*key, F.col(obj).alias("obj")).agg(F.avg(value).alias("a")).dropna(subset=["a"]).withColumn("b", F.lit(0.0))
    mean = per.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean")).filter(F.col("n") >= least)
    lo, hi = (F.percentile("a", p) for p in PERCENTILES)
    ends = resampled(per, key, draws, seed).groupBy(*key).agg(lo.alias("__lo"), hi.alias("__hi"))
    return mean.join(ends, list(key)).select(*key, "n", "mean", (F.col("mean") - F.col("__lo")).alias("below"), (F.col("__hi") - F.col("mean")).alias("above"))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t, from the continued fraction of the incomplete beta function."""
    if n < 3 or not -1 < r < 1:
        return 0.0 if abs(r) == 1 and n > 2 else math.nan
    df = n - 2
    return incomplete_beta(df / 2, 0.5, 1 - r * r)


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 300):  # modified Lentz
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def linear_fit(df: DataFrame, x: str, y: str, key: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def gated(results: DataFrame, column: str) -> DataFrame:
    """``results`` only if all its rows agree on the column, else no rows."""
    one = results.agg(F.countDistinct(column).alias("__kinds")).filter("__kinds = 1")
    return results.crossJoin(F.broadcast(one)).drop("__kinds")  # one row at most


def config_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(name, value)`` tables: names whose values differ or that one side lacks."""
    j = a.select("name", F.col("value").alias("left")).join(b.select("name", F.col("value").alias("right")), "name", "full")
    return j.filter(~F.col("left").eqNullSafe(F.col("right")))


def relative_improvement(df: DataFrame, key: Sequence[str], base: str, other: str, direction: str = "lower") -> DataFrame:
    """Mean of ratios and ratio of means of two columns' improvement, in percent."""
    s = _sign(direction)
    return df.groupBy(*key).agg(F.avg(s * 100 * (F.col(other) - F.col(base)) / F.nullif(F.abs(F.col(base)), F.lit(0.0))).alias("mean_of_ratios"), (s * 100 * (F.avg(other) - F.avg(base)) / F.nullif(F.abs(F.avg(base)), F.lit(0.0))).alias("ratio_of_means"))


def agreement(df: DataFrame, metrics: dict[str, str], base: str, other: str, method: str = "method") -> DataFrame:
    """metric, favours: which method each metric's mean prefers by its direction."""
    stack = F.expr("stack({}, {}) as (metric, sign, value)".format(len(metrics), ", ".join(f"'{m}', {_sign(d)}D, cast(`{m}` as double)" for m, d in metrics.items())))
    g = df.select(F.col(method).alias("__m"), stack).groupBy("metric", "sign").agg(F.avg(F.when(F.col("__m") == base, F.col("value"))).alias("a"), F.avg(F.when(F.col("__m") == other, F.col("value"))).alias("b"))
    gain = F.col("sign") * (F.col("b") - F.col("a"))
    return g.select("metric", F.when(gain > 0, other).when(gain < 0, base).otherwise("neither").alias("favours"))
