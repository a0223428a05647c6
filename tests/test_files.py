"""Writing and importing whole files; gates of view pairs."""

import numpy as np
import pytest

from vantage.operators import estimators as E
from vantage.operators import images as I
from vantage.sources import files as X
from vantage.sources import records, scenes
from vantage.sources import images as P


def test_files(spark, tmp_path):
    v = np.random.default_rng(0).integers(0, 256, (60, 80, 3)).astype(np.uint8)
    src = tmp_path / "pictures"
    src.mkdir()
    (src / "b.png").write_bytes(records.encode_png(v))
    (src / "a.ppm").write_bytes(P.encode(v[:40]))
    (src / "c.txt").write_text("no picture")
    old = tmp_path / "scene" / "views" / "view_0004.mve"
    old.mkdir(parents=True)
    (old / "meta.ini").write_text("[view]\nid = 4\nname = old\n")
    scene = scenes.read_views(spark, str(tmp_path / "scene")).first()["scene"]
    made = X.import_images(spark, str(src), scene, scenes.read_views(spark, str(tmp_path / "scene")), max_pixels=2000, thumbnail=16)
    out = X.write_files(made, str(tmp_path / "scene")).collect()
    assert len(out) == 6 and all(r["bytes"] > 0 for r in out)
    views = {r["id"]: r["name"] for r in scenes.read_views(spark, str(tmp_path / "scene")).collect()}
    assert views == {4: "old", 5: "a", 6: "b"}
    big = records.decode_png((tmp_path / "scene" / "views" / "view_0006.mve" / "original.png").read_bytes())
    assert big.shape == (30, 40, 3) and np.array_equal(big, I.half_size(v))
    assert records.decode_png((tmp_path / "scene" / "views" / "view_0005.mve" / "thumbnail.png").read_bytes()).shape == (16, 16, 3)
    assert not list((tmp_path / "scene").glob("**/*.new"))


def test_formats_by_name(spark, tmp_path):
    for name, v in (("a.png", np.ones((2, 2, 4), np.uint8)), ("a.tif", np.ones((2, 2, 1), np.uint16)), ("a.pfm", np.ones((2, 2, 3), np.float32)), ("a.mvei", np.ones((2, 2, 7)))):
        (tmp_path / name).write_bytes(X.encode_image(v, name))
    got = {r["path"].rsplit("/", 1)[1]: (r["channels"], r["type"]) for r in records.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (4, "uint8"), "a.tif": (1, "uint16"), "a.pfm": (3, "float32"), "a.mvei": (7, "float64")}
    with pytest.raises(ValueError):
        X.encode_image(np.ones((1, 1, 1)), "a.xyz")
    rows = spark.createDataFrame([("x/depth", *(I.fields_of(np.ones((1, 1, 1), np.float32))[c] for c in I.FIELDS)), ("x/grey", *(I.fields_of(np.ones((1, 1, 1), np.uint8))[c] for c in I.FIELDS))], "file string, width int, height int, channels int, type string, data binary")
    assert {r["file"] for r in X.image_files(rows).collect()} == {"x/depth.mvei", "x/grey.png"}
    (tmp_path / "m.smf").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    v, f = X.read_mesh(spark, str(tmp_path / "m.smf"))
    assert v.count() == 3 and f.count() == 1
    names = spark.createDataFrame([("a.PLY",), ("b.bnpts",), ("c",)], "n string")
    assert [r["k"] for r in names.select(X.mesh_format(names.n).alias("k")).collect()] == ["ply", "binary points", None]
    (tmp_path / "list.txt").write_text("one.jpg 0 500\n\n two.jpg\n")
    assert [r["file"] for r in X.read_image_list(spark, str(tmp_path / "list.txt")).orderBy("at").collect()] == ["one.jpg", "two.jpg"]


def test_two_view_matching_and_visible_features(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-1, 1, (40, 3)) + [0, 0, 5]
    r, t = E.rodrigues(np.array([0, 0.2, 0.05])), np.array([0.5, 0, 0])
    a, x = p[:, :2] / p[:, 2:], p @ r.T + t
    b = x[:, :2] / x[:, 2:]
    b[:10] += rng.uniform(0.2, 0.4, (10, 2))
    rows = [("good", i, i, *a[i].tolist(), *b[i].tolist()) for i in range(40)] + [("few", i, i, *a[i].tolist(), *b[i].tolist()) for i in range(20)]
    m = spark.createDataFrame(rows, "pair string, i long, j long, x1 double, y1 double, x2 double, y2 double")
    got = E.two_view_matching(m, "pair", rounds=200).collect()
    assert {r["pair"] for r in got} == {"good"} and {r["i"] for r in got} >= set(range(10, 40)) and len(got) < 40
    eye = np.eye(3).ravel().tolist()
    cams = spark.createDataFrame([(v, 1.0, 0.5, 0.5, 1.0, eye, [float(-v), 0.0, 0.0], 10, 10) for v in range(3)], "view int, flen double, ppx double, ppy double, aspect double, rot array<double>, trans array<double>, width int, height int")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 4.0, [0, 1]), (2, 0.0, 0.0, -4.0, [0, 1]), (3, 1.9, 0.0, 4.0, [0, 1, 2]), (4, 0.0, 0.0, 4.0, [1, 2])], "point int, x double, y double, z double, refs array<int>")
    assert sorted(tuple(r) for r in E.visible_features(pts, cams, 0).collect()) == [(1, 1), (3, 1), (3, 2)]
    assert E.visible_features(pts, cams, 0, (-1.0, -1.0, 0.0), (1.0, 1.0, 9.0)).count() == 1
