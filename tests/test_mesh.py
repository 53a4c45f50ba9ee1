import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from huepoint.operators import mesh, ordered
from huepoint.plans import generate
from huepoint.sources import images, textual


def png(rows, grey=False):
    """A PNG of rows of (r, g, b) or of grey values."""
    raw = b"".join(b"\0" + (bytes(r) if grey else b"".join(bytes(p) for p in r)) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


OBJ = """mtllib lib/plate.mtl
v 0 0 0
v 2 0 0
v 2 2 0
v 0 2 0
vt 0 0
vt 1 0
vt 1 1
vt 0 1
usemtl quarters
f 1/1 2/2 3/3 4/4
v 5 5 5
v 6 5 5
v 5 6 5
usemtl plain
f -3 -2 -1
"""
MTL = "newmtl plain\nKd 1 1 1\nnewmtl quarters\nKd 1 1 1\nmap_Kd images/quarters.png\n"
QUARTERS = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (51, 102, 204)]]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "plate.obj").write_text(OBJ)
    (tmp_path / "plate.mtl").write_text(MTL)
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "quarters.png").write_bytes(png(QUARTERS))
    (tmp_path / "images" / "grey.png").write_bytes(png([[0, 51, 255]], grey=True))
    (tmp_path / "images" / "broken.png").write_bytes(b"no image")
    return str(tmp_path)


def test_images_are_texels(spark, folder):
    got = {(r.texture, r.column, r.row): (r.width, r.height, round(r.r * 255), round(r.g * 255), round(r.b * 255)) for r in images.read_texels(spark, f"{folder}/images").collect()}
    assert got == {("quarters.png", x, y): (2, 2, *QUARTERS[y][x]) for x in (0, 1) for y in (0, 1)} | {("grey.png", x, 0): (3, 1, v, v, v) for x, v in enumerate((0, 51, 255))}


def test_meshes_with_their_textures(spark, folder):
    rows = textual.read_textured_meshes(spark, folder).orderBy("face_id").collect()
    assert [(r.object_id, r.face_id, r.material, r.texture) for r in rows] == [("plate", 0, "quarters", "quarters.png"), ("plate", 1, "quarters", "quarters.png"), ("plate", 2, "plain", None)]
    assert (rows[1].ax, rows[1].bx, rows[1].cx, rows[1].cy, rows[1].cu, rows[1].cv) == (0, 2, 0, 2, 0, 1) and (rows[2].ax, rows[2].bx, rows[2].cy, rows[2].au) == (5, 6, 6, None)


def test_object_materials_and_image_give_each_point_its_colour_and_part(spark, folder):
    faces = textual.read_textured_meshes(spark, folder)
    s = mesh.with_corners(mesh.surface_samples(faces, 400), faces, ("u", "v"), ("texture",))
    parts = spark.createDataFrame([("plate", 0, "lower"), ("plate", 1, "upper")], "object_id string, face int, part string")
    got = mesh.labelled(mesh.textured(s, images.read_texels(spark, f"{folder}/images")), parts).collect()
    assert len(got) == 400 and len({r.point_id for r in got}) == 400
    for r in got:
        if r.texture is None:
            assert (r.r, r.part, r.z) == (0.5, "other", pytest.approx(5))
            continue
        assert (r.u, r.v, r.z) == (pytest.approx(r.x / 2), pytest.approx(r.y / 2), 0) and r.part == ("lower" if r.face_id == 0 else "upper")
        assert [round(255 * c) for c in (r.r, r.g, r.b)] == list(QUARTERS[0 if r.v > 0.5 else 1][1 if r.u >= 0.5 else 0])
    share = sum(r.texture is not None for r in got) / 400
    assert share == pytest.approx(4 / 4.5, abs=0.05)  # by area


def test_samples_follow_area_over_many_faces_and_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(o, f, *map(float, rng.normal(size=9))) for o in (1, 2) for f in range(200)] + [(2, 200, *[1.0] * 9), (3, 0, *[0.0] * 9)]
    t = spark.createDataFrame(rows, "object_id long, face_id long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    got = mesh.surface_samples(t, 3000).groupBy("object_id", "face_id").count().collect()
    area = {(r.object_id, r.face_id): r.a for r in t.withColumn("a", mesh.face_area()).collect()}
    for o in (1, 2):
        mine = {r.face_id: r["count"] for r in got if r.object_id == o}
        total = sum(a for (x, _), a in area.items() if x == o)
        assert sum(mine.values()) == 3000 and 200 not in mine
        assert sum((mine.get(f, 0) - 3000 * a / total) ** 2 / (3000 * a / total) for (x, f), a in area.items() if x == o and a) < 280  # chi square of 199
    assert not [r for r in got if r.object_id == 3]
    assert mesh.surface_samples(t.limit(0), 5).count() == 0


@pytest.mark.parametrize("ranges", [1, 5])
def test_running_sums_by_key(spark, ranges):
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(w)) for i, (k, w) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 400), rng.integers(-5, 5, 400)))]
    got = {r.i: r.before for r in ordered.earlier(spark.createDataFrame(rows, "k int, i int, w int").repartition(7), F.col("w"), ["i"], "before", ranges, ["k"]).collect()}
    total = {}
    for k, i, w in rows:
        assert got[i] == total.get(k, 0)
        total[k] = total.get(k, 0) + w


def test_chairs_by_their_definition(spark):
    n = 4000
    p = generate.chairs(spark, 2, n, seed=5, noise=0.0).toPandas()
    area = np.array([a * b + b * c + a * c for _, _, (a, b, c) in generate.PARTS])
    for _, o in p.groupby("object_id"):
        assert len(o) == n and o.groupby("part")[["r", "g", "b"]].nunique().to_numpy().max() == 1
        assert o.part.value_counts(normalize=True).sort_index().to_numpy() == pytest.approx(area / area.sum(), abs=0.03)
        for k, q in o.groupby("part"):
            _, centre, size = generate.PARTS[k]
            x = np.abs(q[["x", "y", "z"]].to_numpy() - centre) / np.array(size)
            assert (x <= 0.5 + 1e-9).all() and (np.isclose(x, 0.5).any(axis=1)).all()
    assert p.groupby("part").r.nunique().min() == 2  # each object has its own palette
    again = generate.chairs(spark, 2, n, seed=5, noise=0.0).repartition(3).toPandas()
    assert again.sort_values(["object_id", "point_id"])[["x", "r"]].to_numpy() == pytest.approx(p.sort_values(["object_id", "point_id"])[["x", "r"]].to_numpy())


def test_jitter_palette_and_second_material(spark):
    low, high = [(0.1 * i, 0.5, 0.5) for i in range(6)], [(0.1 * i, 0.0, 1.0) for i in range(6)]
    p = generate.chairs(spark, 3, 1500, jitter=0.1, noise=0.0, palette=low, second=high).toPandas()
    for (o, k), q in p.groupby(["object_id", "part"]):
        middle = (q.y.max() + q.y.min()) / 2
        assert set(q.g) <= {0.0, 0.5} and (q[q.g == 0.0].y.min() >= middle - 0.05) and (q[q.g == 0.5].y.max() <= middle + 0.05) and q.r.nunique() == 1
    seat = p[p.part == 0].groupby("object_id").x.max()
    assert seat.nunique() == 3 and (np.abs(seat - 1) <= 0.21).all()
    noisy = generate.chairs(spark, 1, 1500, noise=0.02, palette=low).toPandas()
    assert (noisy[noisy.part == 5].r - 0.5).std() == pytest.approx(0.02, rel=0.3)
