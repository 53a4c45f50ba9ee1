import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from huepoint import models
from huepoint.operators import aggregate as A
from huepoint.operators import geometry as G
from huepoint.operators import metrics as M
from huepoint.operators import nn, ordered, sampling, stats
from huepoint.operators.schedules import walk
from huepoint.plans import completion
from huepoint.sources import textual


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_running_sums_equal_a_plain_loop(spark, ranges):
    rng = np.random.default_rng(1)
    rows = [(int(v) if v else None, i, int(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(-5, 5, 500)))]
    got = ordered.earlier(spark.createDataFrame(rows, "v int, i int, w int").repartition(5), F.col("w"), ["v", "i"], "before", ranges)
    want, total = {}, 0
    for v, i, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i], total = total, total + w
    assert {r.i: r.before for r in got.collect()} == want and got.columns == ["v", "i", "w", "before"]


def test_strings_keep_their_order(spark):
    names = ["", "a", "ab", "abcdefg", "abcdefh", "b", "é", "zz", None, "A", "object_10", "object_9"]
    got = ordered.placed(spark.createDataFrame([(n,) for n in names], "n string"), ["n"], "at")
    rows = sorted(got.collect(), key=lambda r: r["at"])
    assert [r.n for r in rows] == [None, *sorted((n for n in names if n is not None), key=lambda s: s.encode())]
    assert [r["at"] for r in rows] == list(range(len(names)))


def test_empty_tables_give_empty_results(spark):
    df = spark.createDataFrame([], "object_id long, v double")
    assert ordered.placed(df, ["v"], "at").count() == 0 and stats.ranked(df, "v", "r").count() == 0
    assert sampling.counted_split(df, "object_id", 2, 1).count() == 0 and sampling.ranked_split(df, ("v",), 0.5).count() == 0


def test_one_value_is_one_rank(spark):
    df = spark.createDataFrame([(2.0,)] * 4 + [(None,)], "v double")
    assert sorted(r.r for r in stats.ranked(df, "v", "r").collect()) == [1.0, 3.5, 3.5, 3.5, 3.5]
    assert A.roc_auc(spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "t int, s double"), "t", "s").first().auc == 0.5


@pytest.mark.parametrize("seed", [None, 7])
def test_counted_split_is_exact_or_fails(spark, seed):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in sampling.counted_split(df, "k", 60, 20, seed).collect()}
    assert sorted(got.values()) == ["train"] * 60 + ["validation"] * 20
    assert seed is not None or all((s == "train") == (k < 60) for k, s in got.items())
    with pytest.raises(Exception, match="101 rows are needed, there are 100"):
        sampling.counted_split(df, "k", 100, 1, seed).collect()


def test_correlation_p_of_table(spark):
    df = spark.createDataFrame([(0.5, 10), (1.0, 5), (None, 5), (0.3, 2)], "r double, n long")
    got = [r.p for r in stats.with_p(df, "r", "n", "p").collect()]
    assert got[0] == pytest.approx(0.141, abs=1e-3) and got[1:] == [0.0, None, None]  # 0.141: tables of Student's t, 8 degrees


def test_few_pairs_have_no_p(spark):
    df = spark.createDataFrame([("k", i, float(i), float(i * i)) for i in range(2, 7)], "k string, obj int, a double, b double")
    assert stats.compared(df, ["k"], draws=50).first().wilcoxon_p is None
    assert stats.compared(df.unionByName(df.withColumn("obj", F.col("obj") + 10)), ["k"], draws=50).first().wilcoxon_p is not None


def test_bars_hold_the_mean(spark):
    df = spark.createDataFrame([(m, o, float(o + i)) for m in "ab" for o in range(9) for i in (0, 2)] + [("c", 0, 1.0)], "m string, obj int, v double")
    got = {r.m: r for r in stats.bars(df, "v", ["m"], draws=200).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 9 and got["a"].mean == pytest.approx(5) and 0 < got["a"].below < 4 and 0 < got["a"].above < 4


def points(spark, rows):
    return spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double, r double, g double, b double, part long")


def test_balls_without_points(spark):
    ref = points(spark, [(0, 4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0), (0, 2, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)])
    query = points(spark, [(0, 9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0), (0, 8, 9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0), (1, 7, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)])
    assert {(r.q_id, r.n_id) for r in nn.ball(query, ref, 1.0, 2).collect()} == {(9, 4)}
    assert {(r.q_id, r.n_id) for r in nn.ball(query, ref, 1.0, 2, fill_empty=True).collect()} == {(9, 4), (8, 2)}


def test_labels_move_with_the_best_frame(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(40, 3)) * (1, 2, 3)
    ref = points(spark, [(0, i, *map(float, p), 0.0, 0.0, 0.0, 0) for i, p in enumerate(xyz)])
    turned = points(spark, [(0, i, float(p[1]), float(-p[0]), float(p[2]), 0.0, 0.0, 0.0, i % 5) for i, p in enumerate(xyz)])
    got = G.transferred(turned, ref, G.alignment(turned, ref)).collect()
    assert len(got) == 40 and all(r.part == r.point_id % 5 and r.residual < 1e-9 and not r.reflection for r in got)


def test_dropped_parts_are_unknown(spark):
    a = points(spark, [(0, i, float(i), 0.0, 1.0, 0.5, 0.5, 0.5, p) for i, p in enumerate((0, 1, None))])
    b = points(spark, [(0, 9, 2.0, 1.0, 0.0, 0.7, 0.7, 0.7, 0)])
    got = {r.point_id: (r.known, r.r) for r in G.inpainting_input(a, b, drop_part=1).collect()}
    assert got == {0: (True, 0.5), 1: (False, 0.0), 2: (True, 0.5), 9: (False, 0.0)}


def test_errors_of_the_same_cloud_are_zero(spark):
    c = points(spark, [(0, i, float(i), float(i % 3), 0.0, i / 9, 0.2, 0.9, i % 2) for i in range(9)])
    r = M.geometry_errors(c, c).first()
    assert [r.mse, r.p2p, r.p2p_p95, r.cd_l1, r.cd_l2, r.coloured_chamfer] == [0.0] * 6
    assert M.coverage(c, c).first().coverage == 0.0 and M.part_ceiling(c, 5).first().parts == 1
    assert not M.fully_occluded(c.withColumn("is_missing", F.col("point_id") == 0)).first().fully_occluded
    assert M.fully_occluded(c.withColumn("is_missing", F.col("part") == 1)).first().fully_occluded


def test_lonely_points_are_their_own_neighbours(spark):
    c = points(spark, [(0, i, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, int(i == 2)) for i in range(4)])
    assert {(r.q_id, r.n_id) for r in M.part_edges(c, 1).collect()} == {(0, 1), (1, 0), (2, 2), (3, 3)}


def test_last_written_mask_wins(spark):
    masks = spark.createDataFrame([("m", 1, 0, [0, 1]), ("m", 2, 1, [1, 2]), ("m", 3, 2, [2])], "model_id string, mask_id int, position int, faces array<int>")
    parts = spark.createDataFrame([("m", 1, "seat", 5), ("m", 2, "leg", 0)], "model_id string, mask_id int, name string, depth int")
    got = lambda **k: {r.face: r.part for r in textual.face_parts(masks, parts, **k).collect()}
    assert got() == {0: "seat", 1: "seat", 2: "leg"} and got(order=("position",)) == {0: "seat", 1: "leg", 2: "other"}


def test_hidden_parts_are_resampled_more(spark):
    rows = [(0, i, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, p, m) for i, (p, m) in enumerate([(0, False), (0, False), (1, True), (1, False)])] + [(1, i, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, p, m) for i, (p, m) in enumerate([(0, False), (0, False), (1, True), (1, True)])]
    crops = spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double, r double, g double, b double, part long, is_missing boolean")
    assert {r.object_id: r.resamples for r in M.part_visibility(crops, 4).collect()} == {0: 4, 1: 6}
    walks = []

    class Spy(models.PartMeanNoise):
        def estimate(self, x, abar, *rest):
            walks.append(abar)
            return super().estimate(x, abar, *rest)

    for n in (4, 6):
        walks.clear()
        models.Inpainter(Spy(), 20, 10, 4).predict(crops.filter("object_id = 1").toPandas().assign(resamples=n))
        times = walk(20, 10, n)
        assert len(walks) == sum(b <= a for a, b in zip(times, times[1:]))
    assert completion.inpainted(crops, 4, 2, adaptive=True).columns == [*crops.columns, "pred_r", "pred_g", "pred_b"]


def test_views_do_not_depend_on_density(spark):
    rng = np.random.default_rng(5)
    dense = points(spark, [(0, i, *map(float, p), 0.0, 0.0, 0.0, 0) for i, p in enumerate(rng.normal(size=(400, 3)))])
    got = G.same_view((("dense", dense), ("half", dense.filter("point_id < 200"))), 0.5).filter("is_missing").collect()
    cut = {k: {r.point_id for r in rows} for k, rows in itertools.groupby(sorted(got, key=lambda r: r.resolution), lambda r: r.resolution)}
    assert len(cut["dense"]) == 200 and len(cut["half"]) == 100 and len(cut["half"] & cut["dense"]) > 90
