import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from huepoint import models
from huepoint.operators.geometry import crop
from huepoint.plans import completion
from huepoint.operators.mesh import surface_samples
from huepoint.plans.generate import chairs, clusters, objects
from huepoint.sources import arrays, ply, registry, sinks, textual
from huepoint.streaming import results


@pytest.fixture(scope="module")
def cloud(spark):
    return chairs(spark, 1, 50, seed=3, first=3).orderBy("point_id").toPandas()


def test_ply_variants(cloud):
    for big in (False, True):
        got = ply.points(ply.encode(cloud, big_endian=big))
        assert got[list("xyz")].to_numpy() == pytest.approx(cloud[list("xyz")].to_numpy(), abs=1e-6)
        assert got[list("rgb")].to_numpy() == pytest.approx(cloud[list("rgb")].to_numpy(), abs=1 / 255) and (got.part == cloud.part).all()
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nproperty float r\nproperty float g\nproperty float b\nproperty int seg\nend_header\n0 1 2 0.5 0.25 1 7\n3 4 5 1 1 1 8\n"
    got = ply.points(text)
    assert got.x.tolist() == [0, 3] and got.r.tolist() == [0.5, 1] and got.part.tolist() == [7, 8]
    plain = b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"
    assert ply.points(plain).r[0] == 0.5 and ply.points(plain, missing=0.0).g[0] == 0
    with pytest.raises(ply.PlyError):
        ply.points(plain, missing=None)


@pytest.mark.parametrize("data", [b"", b"ply\nformat ascii 1.0\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\nxx", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n1 2\n", b"ply\nformat odd 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n"])
def test_bad_ply(data):
    with pytest.raises(ply.PlyError):
        ply.points(data)


def test_files_with_errors_kept_apart(spark, tmp_path, cloud):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.ply").write_bytes(ply.encode(cloud))
    (tmp_path / "bad.ply").write_bytes(b"ply\nnonsense")
    (tmp_path / "c.npz").write_bytes(arrays.npz_bytes(cloud))
    good, bad = registry.good_and_bad(ply.read(spark, str(tmp_path)))
    assert good.count() == 50 and [r.object_id for r in bad.collect()] == ["bad"] and registry.error_tally(bad).first().kind == "PlyError"
    assert arrays.read_npz(spark, str(tmp_path)).filter("error is null").count() == 50
    out = ply.write(good, f"file://{tmp_path}/out").collect()
    assert [r.object_id for r in out] == ["good"] and ply.header_of((tmp_path / "out" / "good.ply").read_bytes())[0] == 50


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.txt", "abc")
        z.writestr("two.bin", "x")
    got = arrays.members(ply.files(spark, str(tmp_path), "*.zip"), ".txt").collect()
    assert [(r.object_id, r.member, r.size, bytes(r.content)) for r in got] == [("z", "d/one.txt", 3, b"abc")]


def test_text_points_and_pairs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 3 0 0 1 4\n\n 5 6 7\nbad\n")
    got = textual.read_part_points(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.part) for r in got] == [(1.0, 4), (5.0, 0)]
    (tmp_path / "p.pts").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "p.seg").write_text("2\n3\n")
    (tmp_path / "lone.pts").write_text("1 2 3\n")
    assert sorted((r.object_id, r.x, r.part) for r in textual.read_point_label_pairs(spark, str(tmp_path)).collect()) == [("p", 1.0, 2), ("p", 4.0, 3)]


def test_merged_labels(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "object_id long, point_id long")
    m = lambda *on: spark.createDataFrame([(0, i, v) for i, v in enumerate(on)], "object_id long, point_id long, `on` int")
    assert [r.label for r in textual.merged_labels(p, [("leg", m(1, 1, 0)), ("seat", m(0, 1, 0))]).orderBy("point_id").collect()] == ["leg", "seat", "none"]


def test_obj_and_textures(spark, tmp_path):
    (tmp_path / "a.obj").write_text("mtllib lib/m.mtl\nv 0 0 0\nf 1/1/1 2/2 3\nf 3 2 1\n")
    (tmp_path / "m.mtl").write_text("newmtl x\n map_Kd tex image.png \n")
    assert [(r.face_id, r.v0, r.v2) for r in textual.read_obj_faces(spark, str(tmp_path)).orderBy("face_id").collect()] == [(0, 0, 2), (1, 2, 0)]
    got = textual.textures(textual._lines(spark, str(tmp_path), "*.obj"), textual._lines(spark, str(tmp_path), "*.mtl")).first()
    assert (got.object_id, got.library, got.texture) == ("a", "m", "tex image.png")


def test_result_logs_and_append(spark, tmp_path):
    row = lambda m, v: json.dumps({"dataset": "d", "category": "c", "difficulty": "hard", "model": m, "chamfer_out": v})
    (tmp_path / "results.jsonl").write_text(row("a", 1.0) + "\n{broken\n" + row("b", 2.0) + "\n")
    (tmp_path / "results_x1.jsonl").write_text(row("a", 3.0) + "\n")
    got = textual.read_results(spark, str(tmp_path) + "/*.jsonl")
    assert sorted((r.tag, r.model) for r in got.collect()) == [("base", "a"), ("base", "b"), ("x1", "a")]
    log, key = f"{tmp_path}/log", ["model", "tag"]
    assert sinks.append_results(got, log, key) == 3 and sinks.append_results(got, log, key) == 0
    assert spark.read.json(log).count() == 3
    assert "| a |" in sinks.markdown(got.select("model").orderBy("model")) and 'class="best"' in sinks.html_report(got.select("chamfer_out"), ["chamfer_out"])
    assert sinks.config_hash({"a": 1, "b": 2}) == sinks.config_hash({"b": 2, "a": 1})


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda m, v: json.dumps({"dataset": "d", "category": "c", "difficulty": "hard", "model": m, "chamfer_out": v})
    (src / "1.json").write_text(row("a", 1.0) + "\n" + row("a", 9.0) + "\n" + row("b", 3.0) + "\n")
    run = lambda: results.ingest(results.log_stream(spark, str(src)), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    run()
    (src / "2.json").write_text(row("a", 5.0) + "\n" + row("c", 7.0) + "\n")
    run()
    assert sorted(r.model for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["a", "b", "c"]
    q = results.running_cells(results.log_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("cells").first()) == ("c", "hard", 5, 5.0)


def test_hierarchy_and_faces(spark):
    tree = json.dumps([{"name": "chair", "maskId": 1, "children": [{"name": "leg", "maskId": 2, "children": []}, {"name": "seat"}]}])
    h = textual.hierarchy(spark.createDataFrame([("m", tree)], "model_id string, tree string"))
    assert sorted((r.path, r.mask_id, r.depth) for r in h.collect()) == [("chair", 1, 0), ("chair/leg", 2, 1), ("chair/seat", None, 1)]
    masks = spark.createDataFrame([("m", 1, [0, 1, 2]), ("m", 2, [2]), ("m", 9, [5])], "model_id string, mask_id int, faces array<int>")
    assert sorted((r.face, r.part) for r in textual.face_parts(masks, h).collect()) == [(0, "chair"), (1, "chair"), (2, "leg"), (5, "other")]


def test_registry(spark, tmp_path, monkeypatch):
    r = registry.Registry()
    r.add("toy", lambda s, cfg: s.range(cfg["n"]))
    assert r.load(spark, "toy", n=3).count() == 3
    with pytest.raises(KeyError):
        r.load(spark, "other")
    assert registry.resolve_root([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path) and registry.resolve_root([]) == "./data"
    monkeypatch.setenv("HUEPOINT_DATA", "/x")
    assert registry.resolve_root([str(tmp_path)]) == "/x"


def test_segmenter_learns_clusters(spark):
    train, test = (clusters(spark, 1, 600, seed=s).toPandas() for s in (1, 2))
    m = models.CentroidSegmenter.fitted(train, 3)
    assert (m.predict(test).part.to_numpy() == test.part.to_numpy()).mean() > 0.9


def test_inpainting_keeps_the_known_and_beats_grey(spark):
    crops = crop(objects(spark, 2, 300), completion.VIEWPOINT, 0.3)
    out = completion.inpainted(crops, steps=30).toPandas()
    pred, true = out[[f"pred_{c}" for c in "rgb"]].to_numpy(), out[list("rgb")].to_numpy()
    known = ~out.is_missing.to_numpy()
    assert np.abs(pred[known] - true[known]).max() < 1e-6 and ((pred >= 0) & (pred <= 1)).all()
    anchored = out[~out.is_missing].groupby("object_id").part.unique().explode().reset_index().assign(a=True)
    miss = out[out.is_missing].merge(anchored, on=["object_id", "part"])
    err = np.abs(miss[[f"pred_{c}" for c in "rgb"]].to_numpy() - miss[list("rgb")].to_numpy()).mean()
    assert err < np.abs(0.5 - miss[list("rgb")].to_numpy()).mean()


def test_benchmark_plan(spark):
    got = {r.difficulty: r for r in completion.by_difficulty(completion.benchmark(objects(spark, 3, 200), 6)).collect()}
    assert list(got) == ["simple", "moderate", "hard"] and all(r.n == 3 and r.ceiling <= r.part_mean + 1e-9 for r in got.values())


def test_hidden_column_is_not_read(spark):
    df = objects(spark, 2, 40)
    from huepoint.operators.nn import nearest

    assert models.reads_only(df, lambda d: nearest(d, d), "r", F.lit(0.0))


def test_surface_samples_lie_on_the_surface(spark):
    t = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "object_id long, face_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    p = surface_samples(t, 100).toPandas()
    assert (p.z == 1).all() and (p.x + p.y <= 1 + 1e-12).all() and len(p) == 100


def test_csv_with_its_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,v\na,1.5\nb,\nc,bad\n")
    from huepoint.sources import textual

    got = textual.csv_table(spark, f"{tmp_path}/t.csv", "name string, v double")
    assert got.dtypes == [("name", "string"), ("v", "double")] and sorted((r.name, r.v) for r in got.collect()) == [("a", 1.5), ("b", None), ("c", None)]
