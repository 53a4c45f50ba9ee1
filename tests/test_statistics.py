import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huepoint.operators import aggregate as A
from huepoint.operators import sampling as S
from huepoint.operators import schedules
from huepoint.operators import stats as X

# Published mean colour errors of 27 cells: nearest copy, part mean, plain walk, part walk, with true parts, ceiling.
CELLS = """19.94 25.38 27.59 21.88 13.37 5.07|21.63 28.55 31.65 23.46 13.66 5.30|28.45 32.24 34.57 28.35 21.57 5.45|19.64 20.32 30.27 24.80 24.38 20.01|23.05 21.68 33.68 27.62 27.91 20.16|23.34 23.23 36.64 34.69 31.89 19.99
18.15 15.43 28.45 22.25 22.17 14.17|21.63 19.79 30.48 25.38 25.67 16.74|18.23 19.95 33.48 27.84 28.29 17.29|19.19 17.66 20.31 14.90 15.16 15.37|23.93 21.96 26.93 19.95 19.58 18.38|19.71 21.24 27.63 22.70 21.26 18.32
29.62 34.59 48.74 40.53 39.94 31.72|29.73 34.90 51.17 44.26 44.08 31.08|34.88 35.54 51.15 48.82 47.58 31.39|11.82 14.09 59.53 35.54 38.21 11.74|11.67 13.81 64.97 44.67 45.73 11.47|12.92 14.75 80.83 46.43 49.93 11.34
20.33 18.56 37.90 29.51 30.13 16.65|22.62 20.60 41.30 32.92 33.23 17.47|23.03 22.03 42.03 36.84 36.99 17.54|31.12 34.96 50.53 57.71 58.11 32.61|31.99 35.34 47.99 62.22 62.21 32.37|36.96 35.42 48.44 62.14 62.19 32.60
7.77 10.52 21.15 17.20 18.86 8.24|11.07 9.58 33.52 20.73 21.41 8.33|9.92 9.51 39.51 24.95 27.17 7.58"""


def cells(spark):
    rows = [tuple(map(float, c.split())) for line in CELLS.splitlines() for c in line.split("|")]
    return spark.createDataFrame(rows, "nn double, part_mean double, plain double, walk double, walk_true double, ceiling double")


def test_published_ledger(spark):
    df = cells(spark)
    assert df.count() == 27
    assert {r.method: r.wins for r in A.win_ledger(df, "nn", ["plain", "part_mean", "walk_true", "walk"]).collect()} == {"plain": 0, "part_mean": 12, "walk_true": 5, "walk": 3}
    bins = {r["bin"]: (r.cells, r.wins, round(r.mean_gap, 2)) for r in A.margin_bins(df, "nn", "ceiling", "walk_true").collect()}
    assert bins == {"wide": (3, 3, -7.14), "narrow": (13, 2, 8.69), "none": (11, 0, 18.80)}
    r = df.select((F.col("ceiling") - F.col("nn")).alias("x"), (F.col("walk_true") - F.col("nn")).alias("y"))
    assert X.correlations(r, "x", "y").first().pearson == pytest.approx(0.6065, abs=1e-4)


def test_wilcoxon_exact_by_enumeration():
    r = np.random.default_rng(1)
    for n in (5, 8):
        d = r.normal(0.4, 1, n)
        ranks = X.average_ranks(np.abs(d))
        w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
        all_ = [sum(x for x, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        p = min(1.0, 2 * sum(x <= w for x in all_) / len(all_))
        assert X.wilcoxon(d, np.zeros(n)) == pytest.approx((w, p))
    assert X.wilcoxon(np.ones(4), np.ones(4))[1] is not None and math.isnan(X.wilcoxon(np.ones(4), np.ones(4))[1])


def test_wilcoxon_normal_by_sampling():
    r = np.random.default_rng(2)
    d = np.round(r.normal(0.25, 1, 40), 1)
    d = d[d != 0]
    w, p = X.wilcoxon(d, np.zeros(len(d)))
    ranks = X.average_ranks(np.abs(d))
    draws = (r.random((40_000, len(d))) < 0.5) @ ranks
    mid = ranks.sum() / 2
    assert p == pytest.approx((np.abs(draws - mid) >= abs(w - mid)).mean(), abs=0.02)


def test_correlation_p_is_that_of_student():
    assert X.correlation_p(0.5, 12) == pytest.approx(0.0979, abs=2e-4)
    assert X.correlation_p(0.0, 10) == pytest.approx(1.0) and math.isnan(X.correlation_p(0.3, 2))


def test_bootstrap_and_verdicts(spark):
    r = np.random.default_rng(3)
    a = r.normal(10, 1, 30)
    pdf = pd.concat([pd.DataFrame({"k": k, "obj": range(30), "a": a, "b": a + shift + r.normal(0, 0.1, 30)}) for k, shift in (("better", -1.0), ("worse", 1.0))] + [pd.DataFrame({"k": "same", "obj": range(30), "a": a, "b": a + r.normal(0, 1, 30)}), pd.DataFrame({"k": "few", "obj": range(3), "a": 1.0, "b": 2.0})])
    for fixed in (False, True):
        got = {x.k: x for x in X.compared(spark.createDataFrame(pdf), ("k",), draws=400, fixed=fixed).collect()}
        assert {k: x.verdict for k, x in got.items() if k != "same"} == {"better": "helps", "worse": "hurts"} and "few" not in got
        assert got["better"].ci_lo < 10.1 < got["better"].ci_hi + 0.6 and got["better"].wilcoxon_p < 1e-4
    zero = pd.DataFrame({"k": "z", "obj": range(6), "a": 0.0, "b": 1.0})
    i = X.improvement(spark.createDataFrame(zero), key=("k",)).first()
    assert (i.scale, i.improvement) == ("abs", -1.0)


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 5.0), (4.0, 1.0), (None, 2.0)], "x double, y double")
    rx, ry = X.average_ranks(np.array([1, 2, 2, 4.0])), X.average_ranks(np.array([3, 3, 5, 1.0]))
    r = X.correlations(df, "x", "y").first()
    assert r.n == 4 and r.spearman == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_farthest_points_by_definition():
    p = np.random.default_rng(4).random((60, 3))
    got = S.farthest_points(p, 12)
    for i in range(1, 12):
        d = np.min(np.linalg.norm(p[:, None] - p[got[:i]][None], axis=2), axis=1)
        assert d[got[i]] == pytest.approx(d.max())
    assert len(set(got.tolist())) == 12 and len(S.farthest_points(p[:3], 9)) == 3


def points(spark, sizes):
    r = np.random.default_rng(5)
    rows = [(o, i, *map(float, r.random(6)), int(r.integers(3))) for o, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double, r double, g double, b double, part long")


def test_samples_have_their_sizes_and_repeat(spark):
    df = points(spark, (20, 7, 1))
    for fn in (lambda d: S.subsample(d, 10, seed=2), lambda d: S.keep_then_pad(d, 10, seed=2), lambda d: S.fps(d, 10, pad=True).withColumnRenamed("fps_order", "slot")):
        a, b = (sorted((x.object_id, x.slot, x.point_id) for x in fn(d).collect()) for d in (df, df.repartition(5)))
        assert a == b and [(x[0], x[1]) for x in a] == [(o, i) for o in range(3) for i in range(10)]
    c = S.colour_aware(df, 6, 0.5, 3).groupBy("object_id").agg(F.countDistinct("point_id").alias("n"), F.sum(F.col("by_colour").cast("int")).alias("m")).orderBy("object_id").collect()
    assert [(x.n, x.m) for x in c] == [(6, 3), (6, 3), (1, 0)]


def test_splits(spark):
    df = points(spark, (20, 3))
    held = S.ranked_split(df, ("point_id",), 0.25, ("object_id",)).filter("held_out").collect()
    assert sorted((x.object_id, x.point_id) for x in held) == [(0, 15), (0, 16), (0, 17), (0, 18), (0, 19), (1, 2)]


def test_schedule_and_walk(spark):
    s = schedules.products(schedules.cosine(spark, 50)).orderBy("t").toPandas()
    assert (s.abar.diff().dropna() <= 0).all() and s.abar.to_numpy() == pytest.approx(np.cumprod(1 - s.beta.to_numpy())) and s.abar_prev[0] == 1
    w = schedules.walk(40, 10, 3)
    assert w[0] == 39 and w[-1] == -1 and all(abs(a - b) == 1 for a, b in zip(w, w[1:])) and w.count(0) == 3
    assert sum(b > a for a, b in zip(w, w[1:])) == 2 * 10 * 3
    for args in ((40, 10, 3), (37, 5, 2), (8, 10, 4), (12, 3, 1)):
        assert [x.t for x in schedules.walk_times(spark, *args).orderBy("step").collect()] == schedules.walk(*args)


def test_bootstrap_means_spread_as_the_mean_does(spark):
    """Against the standard error, and over keys of a size that would not fit one task's matrix of draws."""
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": "x", "obj": range(400), "a": 10.0, "b": 10 + r.normal(0, 2, 400)})
    got = X.resampled(spark.createDataFrame(pdf), ("k",), 300).toPandas()
    assert len(got) == 300 and got.b.mean() == pytest.approx(pdf.b.mean(), abs=0.03) and got.b.std() == pytest.approx(2 / 20, rel=0.2)
    i = X.bootstrap_interval(spark.createDataFrame(pdf.assign(a=0.0)), ("k",), "higher", 300).first()
    assert i.ci_lo == pytest.approx(pdf.b.mean() - 0.196, abs=0.05) and i.ci_hi == pytest.approx(pdf.b.mean() + 0.196, abs=0.05)
    none = X.bootstrap_interval(spark.createDataFrame(pdf), ("k",), draws=10).first()
    assert none.ci_lo is None and none.ci_hi is None


def test_aggregates_without_rows(spark):
    df = points(spark, (4,)).limit(0)
    assert A.part_means(df, 3).count() == 0 and A.histogram3d(df).count() == 0 and A.roc_auc(df, "part", "x").first().auc is None


def test_part_means_fall_back(spark):
    got = {x.part: (x.n, x.r) for x in A.part_means(points(spark, (30,)).filter("part <> 1"), 4).collect()}
    whole = points(spark, (30,)).filter("part <> 1").agg(F.avg("r")).first()[0]
    assert got[1] == (0, pytest.approx(whole)) and got[3] == (0, pytest.approx(whole)) and got[0][0] > 0
