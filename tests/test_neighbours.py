import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huepoint.operators import geometry as G
from huepoint.operators import metrics as M
from huepoint.operators import nn
from huepoint.plans.generate import chairs, clusters, objects

XYZ = ["x", "y", "z"]


def clouds(n, seed, objects_=2):
    r = np.random.default_rng(seed)
    out = []
    for o in range(objects_):
        p = r.random((n, 3))
        p[: n // 4] = np.round(p[: n // 4], 1)  # ties and equal points
        out.append(pd.DataFrame({"object_id": o, "point_id": np.arange(n), **{c: p[:, i] for i, c in enumerate(XYZ)}, **{c: r.random(n) for c in "rgb"}, "part": r.integers(0, 3, n)}))
    return pd.concat(out, ignore_index=True)


def reference(q, r, k, self_=True):
    rows = []
    for o, a in q.groupby("object_id"):
        b = r[r.object_id == o]
        d = ((a[XYZ].to_numpy()[:, None] - b[XYZ].to_numpy()[None]) ** 2).sum(2)
        for i, p in enumerate(a.point_id):
            order = sorted((d[i, j], n) for j, n in enumerate(b.point_id) if self_ or n != p)
            rows += [(o, p, n, rank + 1) for rank, (_, n) in enumerate(order[:k])]
    return sorted(rows)


@pytest.mark.parametrize("strategy,width", [("brute", 0), ("grid", 0.05), ("grid", 0.4)])
@pytest.mark.parametrize("k,self_", [(1, True), (4, True), (3, False)])
def test_knn_equals_all_pairs(spark, strategy, width, k, self_):
    a, b = clouds(60, 1), clouds(50, 2)
    got = nn.knn(spark.createDataFrame(a), spark.createDataFrame(b), k, include_self=self_, strategy=strategy, width=width or 0.1)
    assert sorted((r.object_id, r.q_id, r.n_id, r["rank"]) for r in got.collect()) == reference(a, b, k, self_)


def test_objects_without_partners_and_empty_clouds(spark):
    a, b = spark.createDataFrame(clouds(5, 1)), spark.createDataFrame(clouds(5, 2)).filter("object_id = 0")
    assert nn.nearest(a, b).count() == 5 and nn.nearest(a.limit(0), b).count() == 0 and nn.nearest(a, b.limit(0), strategy="grid").count() == 0


def test_padding_repeats_from_the_start(spark):
    a = spark.createDataFrame(clouds(3, 1, 1))
    rows = nn.padded(nn.knn(a, a, 5, include_self=False), 5).filter("q_id = 0").orderBy("rank").collect()
    ids = [r.n_id for r in rows]
    assert len(ids) == 5 and ids[2:4] == ids[:2] and ids[4] == ids[0]


def test_subset_mask(spark):
    a = clouds(40, 3, 1)
    part = a.sample(15, random_state=1).assign(point_id=lambda d: d.point_id + 1000)
    got = nn.subset_mask(spark.createDataFrame(a), spark.createDataFrame(part), 1e-6).filter("visible").count()
    near = (np.abs(a[XYZ].to_numpy()[:, None] - part[XYZ].to_numpy()[None]).max(2) == 0).any(1).sum()
    assert got == near >= 15


def test_triangle_distances(spark):
    p = spark.createDataFrame([(0, 0, 0.2, 0.2, 3.0), (0, 1, -1.0, 0.0, 0.0), (0, 2, 2.0, 2.0, 0.0)], "object_id long, point_id long, x double, y double, z double")
    t = spark.createDataFrame([(0, 9, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0, 10, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)], "object_id long, face_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    got = [r.d for r in nn.to_surface(p, t).orderBy("point_id").collect()]
    assert got == pytest.approx([3, 1, np.sqrt(4.5)])


def test_crop_splits_each_object(spark):
    df = spark.createDataFrame(clouds(25, 4))
    for ratio, missing in ((0.5, 12), (0.0, 0), (1.0, 25)):
        rows = G.crop(df, (0.3, -1.0, 0.2), ratio).groupBy("object_id").agg(F.sum(F.col("is_missing").cast("int")).alias("m"), F.count(F.lit(1)).alias("n")).collect()
        assert all((r.m, r.n) == (missing, 25) for r in rows)


def test_normalisation_is_free_of_place_and_size(spark):
    a = clouds(30, 5)
    b = a.assign(**{c: 7 * a[c] - 3 for c in XYZ})
    for fn in (G.unit_sphere, G.rms_normalised):
        x, y = (fn(spark.createDataFrame(d)).orderBy("object_id", "point_id").toPandas()[XYZ].to_numpy() for d in (a, b))
        assert x == pytest.approx(y, abs=1e-9)
    assert np.linalg.norm(G.unit_sphere(spark.createDataFrame(a)).toPandas()[XYZ].to_numpy(), axis=1).max() <= 1 + 1e-9


def test_alignment_finds_the_frame(spark):
    c = chairs(spark, 2, 200, seed=1).toPandas()
    perm, sign = G.signed_permutations()[13]
    moved = c.assign(**{f"n{j}": c[XYZ[perm[j]]] * sign[j] for j in range(3)})
    moved = moved.drop(columns=XYZ).rename(columns={f"n{j}": XYZ[j] for j in range(3)})
    best = G.alignment(spark.createDataFrame(c), spark.createDataFrame(moved)).filter("frame_rank = 1").collect()
    assert len(best) == 2 and all(r.chamfer < 1e-6 for r in best) and any(r.frame == 13 for r in best)
    assert len(set(G.signed_permutations())) == 48 and sum(G.is_reflection(*x) for x in G.signed_permutations()) == 24


def test_duplicate_and_reconciled_faces(spark):
    f = spark.createDataFrame([(0, 0, 1, 2, 3, 0.5), (0, 1, 3, 1, 2, 0.9), (0, 2, 2, 3, 1, 0.9), (0, 3, 1, 2, 4, 0.1), (1, 0, 1, 2, 3, 0.7)], "object_id long, face_id long, v0 long, v1 long, v2 long, quality double")
    assert [r.face_id for r in G.duplicate_faces(f, 0.2).filter("drop").orderBy("face_id").collect()] == [0, 2, 3]
    got = G.reconciled(f, f.filter("face_id <> 1")).filter("dropped").collect()
    assert [(r.object_id, r.face_id) for r in got] == [(0, 1)]
    assert G.reconciled(f, f.filter("object_id = 1").withColumn("v0", F.lit(9).cast("long"))).count() == 0


def test_metrics_of_truth_against_itself_are_perfect(spark):
    c = spark.createDataFrame(clouds(40, 6))
    r = M.completion(c, c).collect()
    assert all(x.cd_l1 == 0 and x.fscore == 1 and x.de00_sym == pytest.approx(0, abs=1e-9) and x.match_rate == 1 for x in r)
    assert all(x.swd == 0 for x in M.sliced_wasserstein(c, c, [(1, 0, 0), (0, 0.6, 0.8)]).collect())
    assert all(x.edge_iou == 1 for x in M.edge_iou(c, c).collect())
    assert all(x.chi2 == 0 for x in M.histogram_chi2(c, c).collect())


def test_shuffled_colours_move_colour_metrics_alone(spark):
    a = clouds(50, 7)
    b = a.copy()
    b[list("rgb")] = b.groupby("object_id")[list("rgb")].transform(lambda s: s.sample(frac=1, random_state=3).to_numpy())
    x, y, t = spark.createDataFrame(a), spark.createDataFrame(b), spark.createDataFrame(clouds(50, 8))
    one, two = (M.completion(d, t).orderBy("object_id").collect() for d in (x, y))
    assert all(p.cd_l1 == pytest.approx(q.cd_l1) and abs(p.de00_sym - q.de00_sym) > 1e-6 for p, q in zip(one, two))
    assert all(r.swd == pytest.approx(0, abs=1e-12) for r in M.sliced_wasserstein(x, y, [(1, 0, 0)]).collect())


def test_same_part_edges_never_cross(spark):
    g = M.graph(spark.createDataFrame(clouds(40, 9)), 5)
    assert g.filter("same and p_part <> t_part").isEmpty() and g.filter("q_id = n_id").isEmpty()


def test_generated_chairs_have_less_part_spread_than_whole(spark):
    d = M.dispersion(objects(spark, 2, 300)).collect()
    assert all(r.n_parts == 6 and r.r_micro < 0.5 for r in d)
    assert clusters(spark, 1, 50).count() == 50


@pytest.mark.parametrize("k, include_self", [(1, True), (4, False), (7, True)])
def test_cells_give_the_rows_of_all_pairs(spark, k, include_self):
    """Surfaces, a volume, a line, one place only, fewer points than k, and queries far from all points."""
    from huepoint.plans.generate import chairs

    rng = np.random.default_rng(k)
    shapes = {1: rng.normal(size=(150, 3)), 2: np.column_stack([np.arange(60), np.zeros(60), np.zeros(60)]), 3: np.zeros((20, 3)), 4: rng.random((3, 3)), 5: np.round(rng.random((80, 3)) * 4) / 4, 6: rng.random((50, 3)) * [100, 1, 0.01]}
    rows = [(o, i, *map(float, p), 0.5, 0.5, 0.5, 0) for o, points in shapes.items() for i, p in enumerate(points)]
    ref = chairs(spark, 1, 500).unionByName(spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double, r double, g double, b double, part long"))
    query = ref.filter("point_id % 3 = 0").withColumn("x", F.when(F.col("point_id") % 4 == 0, F.col("x") + 3).otherwise(F.col("x")))
    got, want = (sorted(map(tuple, nn.knn(query, ref, k, include_self=include_self, strategy=s).collect())) for s in ("cells", "brute"))
    assert got == want and len(got) > 250


def test_metrics_take_the_strategy_in_force(spark):
    a, b = spark.createDataFrame(clouds(90, 3)), spark.createDataFrame(clouds(80, 4))
    measure = {"completion": lambda: M.completion(a, b), "edge_iou": lambda: M.edge_iou(a, b), "chamfer": lambda: G.chamfer(a, b), "graph": lambda: M.graph(a, 5)}
    for name, fn in measure.items():
        want = sorted(map(tuple, fn().collect()), key=str)
        with nn.using("cells"):
            got = sorted(map(tuple, fn().collect()), key=str)
        assert len(got) == len(want) and all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for r, s in zip(got, want) for x, y in zip(r, s)), name
    with pytest.raises(ValueError), nn.using("guess"):
        pass


def test_leading_frames_are_those_of_the_whole_search(spark):
    c = chairs(spark, 3, 160, seed=4).toPandas()
    perm, sign = G.signed_permutations()[29]
    moved = c.assign(**{f"n{j}": c[XYZ[perm[j]]] * sign[j] for j in range(3)})
    moved = spark.createDataFrame(moved.drop(columns=XYZ).rename(columns={f"n{j}": XYZ[j] for j in range(3)}))
    part = spark.createDataFrame(c)
    whole = {(r.object_id, r.frame): r for r in G.alignment(part, moved).collect()}
    for places in (1, 2):
        lead = G.leading_frames(part, moved, places=places).collect()
        for r in lead:
            assert r.chamfer == pytest.approx(whole[r.object_id, r.frame].chamfer, abs=1e-12) and r.reflection == whole[r.object_id, r.frame].reflection
        best = lambda rows: {(r.object_id, r.frame_rank, round(r.chamfer, 9)) for r in rows if r.frame_rank <= places}  # noqa: B023, E731
        assert best(lead) == best(whole.values()) and len(best(lead)) == 3 * places
        assert places == 2 or len(lead) <= len(whole) / 8


def test_reconciled_faces_hold_no_object_in_python(spark):
    """Every object against a plain walk: repeated faces, nulls, absent sides; no grouped function that takes an object whole."""
    r = np.random.default_rng(5)
    rows = pd.DataFrame({"object_id": r.integers(0, 6, 3000), "face_id": r.permutation(3000), **{f"v{i}": r.integers(0, 3, 3000) for i in range(3)}})
    mesh = rows[(r.random(3000) < 0.8) & (rows.object_id != 4)].copy()
    mesh["face_id"] = mesh.face_id * 10 + 7  # numbers of its own
    mesh.loc[mesh.index[mesh.object_id == 2][:1], "v0"] = 99
    want = set()
    for o, a in rows.groupby("object_id"):
        a, b = a.sort_values("face_id"), mesh[mesh.object_id == o].sort_values("face_id")[["v0", "v1", "v2"]].values.tolist()
        at, found = 0, []
        for f, *v in a[["face_id", "v0", "v1", "v2"]].values.tolist():
            same = at < len(b) and v == b[at]
            at += same
            found.append((o, f, not same))
        want |= set(found) if b and at == len(b) else set()
    got = G.reconciled(spark.createDataFrame(rows), spark.createDataFrame(mesh)).collect()
    assert {(x.object_id, x.face_id, x.dropped) for x in got} == want and len(got) == len(want) and {o for o, *_ in want} == {0, 1, 3, 5}

    nulls = spark.createDataFrame([(None, 0, 1, 2, 3), (None, 1, None, 2, 3), (None, 2, 4, 5, 6), (1, 0, None, 2, 3)], "object_id long, face_id long, v0 long, v1 long, v2 long")
    got = G.reconciled(nulls, nulls.filter("v0 is not null or object_id = 1")).collect()
    assert sorted((x.object_id, x.face_id, x.dropped) for x in got) == [(None, 0, False), (None, 1, True), (None, 2, False)]

    plan = G.reconciled(spark.createDataFrame(rows), spark.createDataFrame(mesh))._jdf.queryExecution().toString()
    assert "CoGroups" not in plan


def test_points_without_a_place_are_no_neighbours(spark):
    """As in SQL, where nulls sort last."""
    rows = [(0, i, float(i), 0.0, 0.0) for i in range(40)] + [(0, 90, None, 0.0, 0.0)]
    ref = spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double")
    q = ref.filter("point_id = 3")
    assert [r.n_id for r in nn.knn(q, ref).collect()] == [3]
    assert [r.n_id for r in nn.knn(q, ref, 3).orderBy("rank").collect()] == [3, 2, 4]


@pytest.mark.parametrize("k", [1, 3, 12])
def test_few_pairs_are_ranked(spark, k):
    a = spark.createDataFrame(clouds(300, 8, 1))
    assert nn.close_pairs(a, a, k).count() < 300 * (2 * k + 2)
    assert nn.close_pairs(a.limit(2), a.limit(2), k).count() >= 2


def test_points_meet_once_in_all_frames(spark):
    """No row for each frame before the scores, which are those of the frames one by one; cells give the same."""
    a, b = clouds(40, 3, 2), clouds(50, 4, 2)
    part, ref = spark.createDataFrame(a), spark.createDataFrame(b)
    scores = G.alignment(part, ref)
    assert "Generate explode" not in scores._jdf.queryExecution().toString()
    got = {(r.object_id, r.frame): (r.chamfer, r.reflection, r.frame_rank) for r in scores.collect()}
    with nn.using("cells"):
        other = {(r.object_id, r.frame): (r.chamfer, r.reflection, r.frame_rank) for r in G.alignment(part, ref).collect()}
    assert len(got) == 96 and got.keys() == other.keys() and all(x[0] == pytest.approx(other[i][0], abs=1e-12) and x[1] == other[i][1] for i, x in got.items())
    turned = {tuple(r.asDict()[c] for c in ("object_id", "point_id", "frame", *XYZ)) for r in G.transformed(part).collect()}
    frames = part.crossJoin(spark.range(48).select(F.col("id").cast("int").alias("frame")))
    assert {tuple(r.asDict()[c] for c in ("object_id", "point_id", "frame", *XYZ)) for r in G.in_frame(frames).collect()} == turned
