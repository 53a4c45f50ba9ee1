import numpy as np
import pytest
from pyspark.sql import functions as F

from huepoint.sources import model_files as MF
from huepoint.sources.registry import label_remap

LIB = {"library": "tests.support.standin_h5"}


@pytest.fixture
def folder(tmp_path):
    """Two files of 10 and 7 models of 5 points, classes 0 to 2; one model's colours are bytes."""
    rng = np.random.default_rng(3)
    for name, m in (("a", 10), ("b", 7)):
        points = rng.random((m, 5, 6)).astype(np.float32)
        points[..., 3:] *= 255
        np.savez(tmp_path / f"{name}.npz", points=points, points_part_labels=rng.integers(3, 9, (m, 5)).astype(np.uint16), shape_label=(np.arange(m) % 3).astype(np.uint8), shape_id=np.array([f"{name}{i}".encode() for i in range(m)]), log=np.array(str(tmp_path / f"{name}.log")))
        (tmp_path / f"{name}.npz").rename(tmp_path / f"{name}.h5")
    return tmp_path


def reads(folder):
    """Rows read of each array."""
    out = {}
    for log in folder.glob("*.log"):
        for line in log.read_text().splitlines():
            name, n = line.split()
            out[name] = out.get(name, 0) + int(n)
        log.unlink()
    return out


def test_all_models(spark, folder):
    got = MF.scan(spark, str(folder), **LIB, ranges="3")
    assert got.rdd.getNumPartitions() == 6
    p = got.toPandas()
    assert len(p) == 85 and sorted(p.name.unique()) == sorted([f"a{i}" for i in range(10)] + [f"b{i}" for i in range(7)])
    with np.load(folder / "b.h5") as z:
        one = p[p.name == "b4"].sort_values("point_id")
        assert one[["x", "y", "z"]].to_numpy() == pytest.approx(z["points"][4, :, :3]) and one[["r", "g", "b"]].to_numpy() == pytest.approx(z["points"][4, :, 3:] / 255)
        assert one.part.tolist() == z["points_part_labels"][4].tolist() and set(one["class"]) == {1} and set(one.model) == {4}


def test_filters_reach_the_files(spark, folder):
    reads(folder)
    pushed = MF.scan(spark, str(folder), **LIB, ranges="2").filter("class = 1 and x > 0.5")
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "class" not in plan.split("Filter")[1].split("\n")[0]  # only the filter on x is left for Spark
    rows = sorted(map(tuple, pushed.collect()))
    seen = reads(folder)
    assert seen["points"] == 5 and seen["shape_label"] == 17  # classes of all models, points of five
    unpushed = MF.scan(spark, str(folder), **LIB).filter("abs(class) = 1 and x > 0.5")
    assert sorted(map(tuple, unpushed.collect())) == rows and len(rows) > 0
    assert reads(folder)["points"] == 17
    assert MF.scan(spark, str(folder), **LIB).filter("class in (0, 2) and model = 3").select("name").distinct().count() == 2
    assert MF.scan(spark, str(folder), **LIB).filter("class = 1 and class = 2").count() == 0


def test_limit_reads_only_its_models(spark, folder):
    all_ = MF.read_models(spark, str(folder), 0, **LIB)
    assert all_.select("name").distinct().count() == 7
    reads(folder)
    got = MF.read_models(spark, str(folder), 0, limit=5, **LIB)
    rows = got.collect()
    assert sorted({r.name for r in rows}) == ["a0", "a3", "a6", "a9", "b0"] and len(rows) == 25
    assert reads(folder)["points"] == 5
    want = [tuple(r) for r in all_.collect() if r.name in {"a0", "a3", "a6", "a9", "b0"}]
    assert sorted(map(tuple, rows)) == sorted(want)
    assert MF.read_models(spark, str(folder), 7, limit=5, **LIB).count() == 0


def test_other_layouts_and_local_labels(spark, tmp_path):
    rng = np.random.default_rng(1)
    np.savez(tmp_path / "x.npz", data=rng.random((4, 3, 3)), seg=np.array([[12, 13, 14]] * 4), label=np.array([[2], [2], [5], [2]]))
    (tmp_path / "x.npz").rename(tmp_path / "x.h5")
    own = {"points": "data", "parts": "seg", "shape": "label"}
    got = MF.from_first(MF.read_models(spark, f"file://{tmp_path}/x.h5", 2, **LIB, **own), {2: 12, 5: 40})
    rows = got.collect()
    assert len(rows) == 9 and {r.part for r in rows} == {0, 1, 2} and {r.r for r in rows} == {0.5} and rows[0].name is None
    local = label_remap(MF.scan(spark, f"{tmp_path}/x.h5", **LIB, **own), "part", ["class"])
    assert {r.part for r in local.select("part").distinct().collect()} == {0, 1, 2}
    assert MF.scan(spark, f"{tmp_path}/x.h5", **LIB, **own, content="models").columns == ["path", "model", "class", "name"]
    (tmp_path / "empty").mkdir()
    assert MF.scan(spark, f"{tmp_path}/empty", **LIB).select(F.count("x")).first()[0] == 0
