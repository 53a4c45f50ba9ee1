import json

import numpy as np
import pandas as pd

from huepoint.operators import metrics as M
from huepoint.sources import arrays, loaders, ply, registry, sinks, textual

CLOUD = "object_id string, point_id long, x double, y double, z double, r double, g double, b double, part long"


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    xyz, rgb = rng.normal(size=(n, 3)).astype(np.float32), rng.random((n, 3))
    return pd.DataFrame({"point_id": np.arange(n), **{c: xyz[:, i].astype(float) for i, c in enumerate("xyz")}, **{c: rgb[:, i] for i, c in enumerate("rgb")}, "part": np.arange(n) % 3})


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data) if isinstance(data, bytes) else path.write_text(data)


def test_whole_and_partial_clouds(spark, tmp_path):
    for i, keep in enumerate((60, 95, 3, None)):
        c = cloud(100, i)
        put(tmp_path / "whole/s" / f"m{i}.npz", arrays.npz_bytes(c))
        if keep:
            put(tmp_path / "partial/simple/s" / f"m{i}.ply", ply.encode(c.iloc[:keep]))
    put(tmp_path / "whole/s/bad.npz", b"no archive")
    put(tmp_path / "partial/simple/s/bad.ply", b"no cloud")
    got = loaders.whole_and_partial(spark, f"{tmp_path}/whole", f"{tmp_path}/partial/simple").collect()
    assert {r.object_id for r in got} == {"m0"} and len(got) == 100 and all(r.is_missing == (r.point_id >= 60) for r in got)
    every = loaders.whole_and_partial(spark, f"{tmp_path}/whole", f"{tmp_path}/partial/simple", least=3, limit=3)
    assert {r.object_id for r in every.select("object_id").distinct().collect()} == {"m0", "m1"}  # bad, m0, m1 are the first three files
    reg = registry.Registry()
    reg.add("own", lambda s, config: loaders.whole_and_partial(s, **config), ["chair"])
    assert reg.load(spark, "own", whole=f"{tmp_path}/whole", partial=f"{tmp_path}/partial/simple").count() == 100


def test_clouds_of_a_category(spark, tmp_path):
    plain = b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"
    for name, data in (("Toy_Chairs/a/one.ply", ply.encode(cloud(40, 1))), ("Toy_Chairs/two.ply", ply.encode(cloud(20, 2))), ("Toy_Chairs/grey.ply", plain), ("lamp/chair.ply", ply.encode(cloud(40, 3))), ("armchair/three.ply", ply.encode(cloud(40, 4))), ("armchair/bad.ply", b"ply\n")):
        put(tmp_path / "chairs_root" / name, data)
    names = lambda **k: sorted(r.object_id for r in loaders.of_category(spark, f"{tmp_path}/chairs_root", "CHAIR", least=30, **k).select("object_id").distinct().collect())
    assert names() == ["one", "three"]
    assert names(limit=3) == ["one"]  # one, grey and two come first by path


def test_a_broken_shard_is_kept_apart(spark, tmp_path):
    good = {"model_id": "m1", "hierarchyList": [{"name": "Chair", "children": [{"name": "leg"}]}], "masks": {}}
    put(tmp_path / "000-001/m1.json", json.dumps(good, indent=1))
    put(tmp_path / "000-001/deep/m2.json", json.dumps(good | {"model_id": "m2"}))
    put(tmp_path / "000-002/cut.json", json.dumps(good)[:40])
    put(tmp_path / "000-002/rootless.json", json.dumps({"model_id": "m3", "hierarchyList": []}))
    put(tmp_path / "000-002/nameless.json", json.dumps({"hierarchyList": [{"name": "Lamp"}]}))
    put(tmp_path / "000-003/m4.json", json.dumps(good | {"model_id": "m4", "hierarchyList": [{"name": "Lamp"}]}))
    rows, bad = loaders.metadata_shards(spark, str(tmp_path))
    index = {r["name"]: [(m.model_id, m.kind) for m in r.models] for r in textual.model_index(rows).collect()}
    assert index == {"Chair": [("m1", "000-001"), ("m2", "deep")], "Lamp": [("m4", "000-003")]}
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()} == {("cut.json", "not JSON"), ("rootless.json", "no root"), ("nameless.json", "no model_id")}


def test_runs_are_folders_with_both_files(spark, tmp_path):
    def run(name, system, table=True, manifest=None):
        put(tmp_path / name / "run_manifest.json", manifest or json.dumps({"system": system}))
        if table:
            put(tmp_path / name / "tables/eval_raw.csv", "a\n1\n")

    run("one/b", "x")
    run("one/a", "y", table=False)
    run("one/c", "z", manifest="{")
    run("two/a", "x")
    run("two/b", "y")
    run("two/c", "y")
    put(tmp_path / "two/d/tables/eval_raw.csv", "a\n")
    got = {r.system: r for r in loaders.runs(spark, [f"{tmp_path}/one", f"{tmp_path}/two"]).collect()}
    assert {s: r.folder.split(str(tmp_path))[1] for s, r in got.items()} == {"x": "/one/b", "y": "/two/b"}
    assert got["x"].manifest.endswith("/one/b/run_manifest.json") and got["x"].table.endswith("/one/b/tables/eval_raw.csv")


def test_overlay_round_trip(spark, tmp_path):
    a, b = cloud(5, 1).assign(object_id="o"), cloud(7, 2).assign(object_id="o")
    both = sinks.overlay(spark.createDataFrame(a[[c.split()[0] for c in CLOUD.split(", ")]], CLOUD), spark.createDataFrame(b[[c.split()[0] for c in CLOUD.split(", ")]], CLOUD))
    assert ply.write(both, f"file://{tmp_path}/out").count() == 1
    got = ply.points((tmp_path / "out" / "o.ply").read_bytes())
    red, grey = got[got.part == 0], got[got.part == 1]
    assert red[list("xyz")].to_numpy().tolist() == a[list("xyz")].to_numpy().tolist() and grey[list("xyz")].to_numpy().tolist() == b[list("xyz")].to_numpy().tolist()
    assert set(map(tuple, red[list("rgb")].round(6).to_numpy())) == {sinks.ALIGNED} and set(map(tuple, grey[list("rgb")].round(6).to_numpy())) == {sinks.REFERENCE}


def test_a_mixed_checkpoint_gives_the_rows_of_the_right_signature(spark):
    config, other = {"steps": 50, "seed": 1}, {"steps": 25, "seed": 1}
    rows = [(i, sinks.config_hash(config if i % 3 else other) if i != 4 else None) for i in range(6)]
    done, left = sinks.resumed(spark.range(8).toDF("cell"), spark.createDataFrame(rows, "cell long, config_hash string"), ["cell"], config)
    assert sorted(r.cell for r in done.collect()) == [1, 2, 5]
    assert sorted((r.cell, r.config_hash) for r in left.collect()) == [(i, sinks.config_hash(config)) for i in (0, 3, 4, 6, 7)]
    assert sinks.overridden(config, {"steps": 10, "seed": None, "fast": False, "tag": "x"}) == {"steps": 10, "seed": 1, "tag": "x"}


def test_objects_without_all_label_files_are_for_testing(spark):
    points = spark.createDataFrame([(o, i) for o, n in (("a", 5), ("b", 5), ("c", 5), ("small", 2)) for i in range(n)], "object_id string, point_id long")
    mask = lambda *objects: spark.createDataFrame([(o, i, 1) for o in objects for i in range(2)], "object_id string, point_id long, on int")
    train, test = textual.with_and_without_labels(points, [("wing", mask("a", "b", "small")), ("body", mask("a", "small"))], least=3)
    ids = lambda df: sorted(r.object_id for r in df.select("object_id").distinct().collect())
    assert (ids(train), ids(test)) == (["a"], ["b", "c"])


def test_quality_and_gradient(spark):
    rows = [(o, i, float(i), 0.0, 0.0, *( [0.5] * 3 if o == 0 else [0.1 * i, 0.5, 0.2]), 0) for o in (0, 1) for i in range(6)] + [(2, 0, 0.0, 0.0, 0.0, 0.5, 0.2, 0.1, 0)]
    df = spark.createDataFrame(rows, "object_id long, point_id long, x double, y double, z double, r double, g double, b double, part long")
    got = {r.object_id: r for r in M.colour_quality(df).collect()}
    assert not got[0].color_ok and got[1].color_ok and got[1].n == 6
    assert abs(got[1].color_std - np.std([[0.1 * i, 0.5, 0.2] for i in range(6)])) < 1e-12
    g = {(r.object_id, r.point_id): r.gradient for r in M.colour_gradient(df, 2).collect()}
    from huepoint.operators.sampling import colour_gradient

    xyz, rgb = np.array([[i, 0, 0] for i in range(6)], float), np.array([[0.1 * i, 0.5, 0.2] for i in range(6)])
    assert np.allclose([g[1, i] for i in range(6)], colour_gradient(xyz, rgb, 2)) and g[2, 0] == 0 and g[0, 3] == 0
