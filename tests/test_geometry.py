"""New catalog queries against their SQL; estimators, images and formats on known answers and round trips."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF
from oracle import compare, rows_of
from pyspark.sql import functions as F

from vantage.functions import columns as C
from vantage.functions import geometry as G
from vantage.functions import vectors as V
from vantage.operators import estimators as E
from vantage.operators import images as I
from vantage.operators import relational as R
from vantage.plans import catalog_formats, catalog_geometry, catalog_surfaces, catalog_values
from vantage.plans.queries import QUERIES, SQL
from vantage.sources import bundles, ply, scenes
from vantage.sources.writers import write_lines


@pytest.mark.parametrize("name", sorted([*catalog_formats.SQL, *catalog_geometry.SQL, *catalog_surfaces.SQL, *catalog_values.SQL]))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], SQL[name]) == ""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- cameras, golden values ---


def test_byte_of_mixed_colors(spark, tmp_path):
    """sums that end in a half before they are rounded to a byte, as in the query's SQL."""
    rows = [(1960, 36, 996.0), (8600, 10, 960.0), (15120, 2, 912.0), (1, 50, 999.99), (2, None, 900.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT p_partkey, byte FROM ({SQL['scalar_functions']})").fetchall()
    assert sorted(map(tuple, QUERIES["scalar_functions"](spark, str(tmp_path)).select("p_partkey", "byte").collect())) == sorted(want)


def test_size_texts_beyond_64_bits(spark, tmp_path):
    """keys whose product does not fit into a long; the SQL's own product fails there, so the texts are from whole numbers."""
    rows = [(33, 3), (9_000_001, 900_000), (3_000_000_017, 2_999_999_999), (9_223_372_036_854_775_807, 9_223_372_036_854_775_806), (-9_000_001, 899_999), (5, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(map(tuple, QUERIES["size_texts"](spark, str(tmp_path)).collect()))
    assert got == {33: "4.3 KB", 9_000_001: f"{9_000_001**2 * 900_001 / 2**30:.0f} GB", -9_000_001: f"{9_000_001**2 * 900_000 / 2**30:.0f} GB"}  # the rest are whole numbers, which the query drops


@pytest.mark.parametrize("name", ["influencing_samples", "implicit_values"])
def test_pairs_stay_where_they_meet(spark, tmp_path, name):
    """points are not copied to cells and pairs not shuffled; repeated ids, copies, nulls and empty vectors as in SQL."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    rows += [(k, rows[k + 7][1]) for k in range(5)] + [(1000 + k, rows[3][1]) for k in range(40)] + [(2000, None), (2001, []), (2002, rows[1][1][:8]), (2003, [9.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert rows_of(got.collect(), got.columns) == rows_of(want, got.columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_camera_golden(spark):
    cam = G.camera(1.0)
    lits = lambda *v: [F.lit(float(x)) for x in v]
    assert value(spark, F.array(*G.calibration(cam, 800, 600))) == [800, 0, 400, 0, 800, 300, 0, 0, 1]
    assert value(spark, F.array(*G.calibration(cam, 600, 800))) == [800, 0, 300, 0, 800, 400, 0, 0, 1]
    a = G.camera(1.0, rot=lits(0, -1, 0, 1, 0, 0, 0, 0, 1), trans=lits(1, 2, 3))
    assert value(spark, F.array(*G.camera_position(a))) == [-2, 1, -3] and value(spark, F.array(*G.viewing_direction(a))) == [0, 0, 1]
    both = value(spark, F.array(*V.mat_mult(G.world_to_camera(a), G.camera_to_world(a), 4)))
    assert np.allclose(np.reshape(both, (4, 4)), np.eye(4))
    t, v = G.reprojection(cam, cam, (10, 10), (10, 10))
    assert np.allclose(np.reshape(value(spark, F.array(*t)), (3, 3)), np.eye(3)) and value(spark, F.array(*v)) == [0, 0, 0]
    text = value(spark, G.rotation_string(lits(1, 0, -0.125, 1 / 3, 1e-7, 123456789012, 0.1, 2, 3)))
    assert text == "1 0 -0.125 0.3333333333 1e-07 1.23456789e+11 0.1 2 3"
    back = value(spark, F.array(*G.rotation_of_string(F.lit(text))))
    assert np.allclose(back, [1, 0, -0.125, 1 / 3, 1e-7, 123456789012, 0.1, 2, 3], rtol=1e-8)


def test_strings_golden(spark):
    assert value(spark, C.ellipsize(F.lit("abcdefghij"), 8, "middle")) == "abc...hij" and value(spark, C.ellipsize(F.lit("abcdefghij"), 7, "middle")) == "ab...ij"
    assert value(spark, C.bound_mirror(F.lit(-2), 0, 5)) == 2 and value(spark, C.bound_mirror(F.lit(7), 0, 5)) == 3
    assert value(spark, C.wordwrap(F.lit("a bc def g"), 4)) == "a bc\ndef\ng" and value(spark, C.wordwrap(F.lit("abcdef g\nh"), 3)) == "abcdef\ng\nh"
    assert value(spark, C.parse_cmd(F.lit('a "b c" d""'))) == ["a", "b c", "d"]
    assert [value(spark, C.convert(F.lit(x), "int")) for x in ("12x", " 7", "x")] == [12, 7, 0] and value(spark, C.convert(F.lit("12x"), "int", True)) is None
    assert value(spark, C.sanitize_path(F.lit("a\\b//c/"))) == "a/b/c" and value(spark, C.sanitize_path(F.lit("//"))) == "/"


# --- linear algebra ---


def test_decompositions():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 6, 3))
    u, s, v = E.svd(a)
    q, r = E.qr(a)
    assert np.allclose(u * s[:, None] @ np.swapaxes(v, 1, 2), a) and (np.diff(s) <= 0).all()
    assert np.allclose(q @ r, a) and np.allclose(np.tril(r, -1), 0) and (np.diagonal(r, axis1=1, axis2=2) >= 0).all()
    assert np.allclose(E.pseudo_inverse(a) @ a, np.eye(3))
    low = np.zeros((3, 3))
    low[0, 0] = 2
    assert np.allclose(E.pseudo_inverse(low), np.diag([0.5, 0, 0]))
    u, b, v = E.bidiagonal(a[0])
    assert np.allclose(u @ b @ v.T, a[0]) and np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)
    m = a[0].T @ a[0]
    assert np.allclose(E.cholesky_inverse(m), np.linalg.inv(m)) and np.allclose(E.cholesky(m) @ E.cholesky(m).T, m)
    x, rounds = E.conjugate_gradient(lambda p: m @ p, np.array([1.0, 2, 3]))
    assert np.allclose(m @ x, [1, 2, 3]) and rounds <= 5


def scene(seed=0, n=40):
    rng = np.random.default_rng(seed)
    points = rng.uniform(-1, 1, (n, 3))
    poses = []
    for k in range(3):
        r = E.rodrigues(np.array([0.1 * k, -0.2 * k, 0.05]))
        poses.append((r, np.array([0.3 * k, -0.2, 5.0])))
    seen = [(x := points @ r.T + t)[:, :2] / x[:, 2:] for r, t in poses]
    return points, poses, seen


def test_two_views():
    points, poses, seen = scene()
    f = E.enforce_rank_two(E.fundamental_8_point(seen[0], seen[1]))
    assert E.sampson_distances(f, seen[0], seen[1]).max() < 1e-15 and abs(np.linalg.det(f)) < 1e-12
    k = np.eye(3)
    g = E.fundamental_from_poses(k, *poses[0], k, *poses[1])
    assert abs(abs((f / np.linalg.norm(f) * g / np.linalg.norm(g)).sum()) - 1) < 1e-6
    e = E.enforce_essential(g)
    s = np.linalg.svd(e)[1]
    assert abs(s[0] - s[1]) < 1e-9 and s[2] < 1e-9
    r = poses[1][0] @ poses[0][0].T
    t = poses[1][1] - r @ poses[0][1]
    assert min(np.abs(a - r).max() + np.abs(b - t / np.linalg.norm(t)).max() for a, b in E.poses_from_essential(e)) < 1e-6
    bad = seen[1].copy()
    bad[:8] += 0.3
    _, found = E.ransac_fundamental(seen[0], bad, np.random.default_rng(1), 300)
    assert set(found) >= set(range(8, 40)) and len(found) < 40
    h = np.array([[1.1, 0.1, 0.2], [-0.1, 0.9, 0.1], [0.05, -0.02, 1]])
    q = np.column_stack([seen[0], np.ones(40)]) @ h.T
    q = q[:, :2] / q[:, 2:]
    q[:10] += 0.5
    m, found = E.ransac_homography(seen[0], q, np.random.default_rng(1), 100)
    assert np.allclose(m, h) and list(found) == list(range(10, 40))


def test_pose_and_triangulation():
    points, poses, seen = scene()
    rays = np.column_stack([seen[1], np.ones(40)])
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    found = E.pose_p3p(points[:3], rays[:3])
    assert 0 < len(found) <= 4 and min(np.abs(r - poses[1][0]).max() + np.abs(t - poses[1][1]).max() for r, t in found) < 1e-6
    assert E.pose_p3p(np.array([[0.0, 0, 0], [1, 1, 1], [2, 2, 2]]), rays[:3]) == []
    bad = seen[1].copy()
    bad[:12] += 0.2
    (r, t), inliers = E.ransac_pose(points, bad, np.random.default_rng(2), 60)
    assert np.allclose(r, poses[1][0], atol=1e-6) and np.allclose(t, poses[1][1], atol=1e-6) and list(inliers) == list(range(12, 40))
    p = np.array([np.column_stack(x) for x in poses])
    views = np.array([s[5] for s in seen])
    assert np.allclose(E.triangulate(p, views), points[5]) and np.allclose(E.triangulate(p[:2], views[:2]), points[5])
    assert E.triangulate_robust(p[:2], np.array([seen[0][5], seen[0][5]]), angle=np.radians(80)) is None


def test_bundle_adjustment():
    points, poses, seen = scene(3)
    rng = np.random.default_rng(5)
    cams = np.array([[1.0, 0.02, 0.001, *t, 0, 0, 0] for _, t in poses])
    rots = np.array([r for r, _ in poses])
    ci, pi = np.repeat(np.arange(3), 40), np.tile(np.arange(40), 3)
    obs = E.residuals(cams, rots, points, ci, pi, np.zeros((120, 2)))
    start = cams + rng.normal(0, 0.01, cams.shape) * [1, 0, 0, 1, 1, 1, 0, 0, 0]
    moved = points + rng.normal(0, 0.02, points.shape)
    turned = np.array([E.rodrigues(rng.normal(0, 0.01, 3)) @ r for r in rots])
    jc, jp = E.jacobian(start, turned, moved, ci, pi)
    step = 1e-6
    for k in range(E.CAMERA):
        other, rot = start.copy(), turned.copy()
        if k < 6:
            other[:, k] += step
        else:
            rot = np.array([E.rodrigues(np.eye(3)[k - 6] * step) @ r for r in turned])
        d = (E.residuals(other, rot, moved, ci, pi, obs) - E.residuals(start, turned, moved, ci, pi, obs)) / step
        assert np.allclose(jc[:, :, k], d, atol=1e-4), k
    *_, before, after = E.bundle_adjust(start, turned, moved, ci, pi, obs)
    assert after < 1e-3 * before
    *_, a, b = E.bundle_adjust(cams, rots, moved, ci, pi, obs, mode="points")
    assert b < 1e-6 * a
    u = E.undistort_feature(np.array([0.3, 0.2]), 0.1, 0.01, 1.0)
    r2 = u @ u
    assert np.allclose(u * (1 + 0.1 * r2 + 0.01 * r2**2), [0.3, 0.2])


def test_similarity_of_degenerate_points(spark):
    rows = [("line", [float(i)] * 3, [float(i)] * 3) for i in range(5)] + [("two", [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]), ("two", [1.0, 0.0, 1.0], [1.0, 1.0, 0.0])]
    got = E.similarity_transforms(spark.createDataFrame(rows, "k string, p array<double>, q array<double>"), "k").collect()
    assert all(r["rot"] is None and r["scale"] is None for r in got) and E.determine_transform(np.eye(3)[:2], np.eye(3)[:2]) is None


# --- images ---


def test_images_golden():
    v = np.arange(2 * 3, dtype=np.uint8).reshape(2, 3, 1)
    assert I.rotate(v, "cw")[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]] and I.rotate(v, "ccw")[..., 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert I.half_size(v)[..., 0].tolist() == [[2, 4]] and I.subtract(v, v + 1).max() == 255 and I.difference(v, v + 1).max() == 1
    assert I.double_size(np.array([[[0.0], [4.0]]]))[0, :, 0].tolist() == [0, 1, 3, 4]
    c = I.draw_circle(np.zeros((9, 9, 1)), 4, 4, 3, 1.0)[..., 0]
    assert c[1, 4] == c[7, 4] == c[4, 1] == c[4, 7] == 1 and c.sum() == 16 and np.array_equal(c, c.T)
    box = np.arange(7, dtype=float).reshape(1, 7, 1).repeat(7, 0)
    assert np.allclose(I.blur_boxfilter(box, 1)[3, :, 0][:5], [0.5, 1, 2, 3, 4])
    d = np.zeros((5, 5, 1), np.float32)
    d[0, 0], d[2:4, 2:4] = 1, 2
    assert np.count_nonzero(I.depthmap_cleanup(d, 3)) == 4 and np.count_nonzero(I.depthmap_cleanup(d, 1)) == 5
    for k1 in (0.2, -0.1):
        r = np.linspace(0, 0.9, 10)
        u = I._cubic_radius(r, k1)
        assert np.allclose(u * (1 + k1 * u * u), r)
    assert I.create_thumbnail(np.ones((40, 60, 3), np.uint8), 10, 10).shape == (10, 10, 3) and I.limit_size(np.ones((8, 8, 1)), 20).shape == (4, 4, 1)
    assert np.allclose(I.rescale(np.ones((9, 7, 1)), "gaussian", 3, 0), 1) and np.allclose(I.rotate_by(np.ones((5, 5, 1)), math.pi / 2), 1)


def test_images_keep_other_columns(spark):
    rows = [("a", 2, 1, 1, "uint8", bytes([1, 2]), 7), ("b", None, None, None, None, None, 8)]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, type string, data binary, own int")
    got = {r["path"]: r for r in I.on_images(df, lambda v: I.flip(v, horizontal=True)).collect()}
    assert bytes(got["a"]["data"]) == bytes([2, 1]) and got["a"]["own"] == 7 and got["b"]["data"] is None


# --- meshes ---


def test_meshes(spark):
    # A pyramid without its base: the top is closed, the base's corners are on the border; two fans meet at vertex 6.
    v = pd.DataFrame([(0, 0, 0, 1), (1, 1, 0, 0), (2, 0, 1, 0), (3, -1, 0, 0), (4, 0, -1, 0), (5, 9, 9, 9), (6, 5, 0, 0), (7, 6, 0, 0), (8, 6, 1, 0), (9, 4, 0, 0), (10, 4, -1, 0)], columns=["vid", "x", "y", "z"]).astype({c: float for c in "xyz"})
    f = pd.DataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 3, 4), (3, 0, 4, 1), (4, 6, 7, 8), (5, 6, 9, 10), (6, 5, 5, 5)], columns=["fid", "v0", "v1", "v2"])
    vs, fs = spark.createDataFrame(v), spark.createDataFrame(f)
    good = R.delete_invalid_faces(fs)
    assert good.count() == 6
    kinds = {r["vid"]: r["class"] for r in R.vertex_classes(vs, good).collect()}
    assert kinds[0] == "simple" and {kinds[i] for i in (1, 2, 3, 4, 7, 8)} == {"border"} and kinds[6] == "complex" and kinds[5] == "unreferenced"
    n = {r["vid"]: (r["nx"], r["ny"], r["nz"]) for r in R.vertex_normals(vs, good).collect()}
    assert np.allclose(n[0], (0, 0, 1)) and n[5] == (0, 0, 0) and np.allclose(np.linalg.norm(n[1]), 1)
    assert {r["vid"] for r in R.delete_small_components(vs, good, 5).collect()} == set()
    assert {r["vid"] for r in R.delete_small_components(vs, good, 4).collect()} == {0, 1, 2, 3, 4, 6, 7, 8, 9, 10}
    a, b = R.mesh_merge(vs, good, vs, good)
    assert a.count() == 22 and b.agg(F.max("v2")).first()[0] == 21 and [r["vid"] for r in R.unreferenced(vs, good).collect()] == [5]
    assert R.delete_vertices(vs, F.col("vid") < 3).agg(F.max("new_vid")).first()[0] == 7 and R.invert_faces(good).where("fid = 0").first()["v0"] == 2


def test_order_statistics_of_nothing(spark):
    assert R.order_statistics(spark.createDataFrame([], "x double"), "x", [0, 3]) == [None, None]
    assert R.order_statistics(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double"), "x", [0, 1]) == [1.0, 3.0]
    assert R.large_errors(spark.createDataFrame([], "e double"), "e").count() == 0


# --- formats ---

BUNDLE = """drews 1.0
3 2
1.5 0.1 0.2
1 0 0
0 1 0
0 0 1
1 2 3
0 0 0
0 0 0
0 0 0
0 0 0
0 0 0
0.75 0 0
0 -1 0
1 0 0
0 0 1
-1 0.5 2.25
1 2 3
255 128 0
2 0 5 0 2 7 0
-1.5 0.25 1e-05
10 20 30
0
"""


def test_bundles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "synth_0.out").write_text(BUNDLE)
    cams, points = bundles.read_bundle(spark, str(tmp_path / "in"))
    c = {r["cam"]: r for r in cams.collect()}
    assert c[0]["flen"] == 1.5 and c[0]["trans"] == [1, 2, 3] and c[1]["flen"] == 0 and c[2]["rot"][1] == -1
    p = {r["point"]: r for r in points.collect()}
    assert [tuple(x)[:2] for x in p[0]["refs"]] == [(0, 5), (2, 7)] and p[1]["refs"] == [] and abs(p[0]["color"][1] - 128 / 255) < 1e-6
    write_lines(bundles.bundle_lines(cams, points), str(tmp_path / "out"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "out").glob("*/part*.txt")))
    assert text == BUNDLE
    cams, points = bundles.delete_camera(cams, points, 2)
    assert points.where(bundles.contains_view(F.col("refs"), F.lit(2))).count() == 0 and points.count() == 2 and cams.where("flen > 0").count() == 1
    assert bundles.parse_bundle(BUNDLE.rsplit("\n", 3)[0].encode())[1][0]["point"] == 0
    for raw in (b"drews 2.0\n1 1\n", b"drews 1.0\n99999 1\n", b"drews 1.0\n2 1\n1 2"):
        with pytest.raises(ValueError):
            bundles.parse_bundle(raw)
    assert bundles.bundle_vertices(points).count() == 2 and bundles.bundle_bytes(cams, points).first()["bytes"] == 3 * 72 + 2 * 24 + 16


def test_nvm_and_colmap(spark, tmp_path):
    nvm = b"NVM_V3\n\n2\na.jpg 500 1 0 0 0 1 2 3 0.1 0\n/b.jpg 600 0 1 0 0 0 0 1 0 0\n2\n1 2 3 255 0 0 2 0 1 0.5 0.5 1 2 1.5 2.5\n1 1 1 0 0 0 0\n"
    cams, points = bundles.parse_nvm(nvm)
    assert cams[0]["trans"] == [-1, -2, -3] and cams[1]["trans"] == [0, 0, 1] and len(points) == 1 and points[0]["refs"][1] == (1, 2, 1.5, 2.5)
    sparse = tmp_path / "ws" / "sparse"
    sparse.mkdir(parents=True)
    (sparse / "cameras.txt").write_text("# comment\n1 PINHOLE 800 600 400 400 400 300\n")
    (sparse / "images.txt").write_text("# comment\n1 1 0 0 0 0 0 1 1 a.jpg\n10 20 1 30 40 -1\n2 1 0 0 0 1 0 1 1 b.jpg\n5 6 1\n")
    (sparse / "points3D.txt").write_text("1 1 2 3 255 0 0 0.5 1 0 2 0 2 0\n")
    cams, points = bundles.read_colmap(spark, str(tmp_path / "ws"))
    assert [(r["flen"], r["ppx"], r["name"]) for r in cams.orderBy("cam").collect()] == [(0.5, 0.5, "a.jpg"), (0.5, 0.5, "b.jpg")]
    assert [tuple(x) for x in points.first()["refs"]] == [(0, 0, 10.0, 20.0), (1, 0, 5.0, 6.0)]
    import struct

    raw = struct.pack("<QIiQQ4d", 1, 1, 1, 800, 600, 400, 400, 400, 300)
    assert bundles.colmap_cameras_binary(raw) == bundles.colmap_cameras_text((sparse / "cameras.txt").read_bytes())
    images = struct.pack("<QI7dI", 1, 1, 1, 0, 0, 0, 0, 0, 1, 1) + b"a.jpg\0" + struct.pack("<Qddqddq", 2, 10, 20, 1, 30, 40, -1)
    assert bundles.colmap_images_binary(images)[0] == bundles.colmap_images_text((sparse / "images.txt").read_bytes())[0]
    pts = struct.pack("<QQ3d3BdQ4I", 1, 1, 1, 2, 3, 255, 0, 0, 0.5, 2, 1, 0, 2, 0)
    assert bundles.colmap_points_binary(pts)[0][3] == [(0, 0), (1, 0)]
    depth = bundles.parse_colmap_depth(b"2&1&1&" + np.array([1.5, 2.5], "<f4").tobytes())
    assert depth[0, :, 0].tolist() == [1.5, 2.5]
    with pytest.raises(ValueError):
        bundles.camera_of_model("RADIAL", [1] * 5, 8, 6)
    kind = spark.createDataFrame([(bytearray(nvm),), (bytearray(BUNDLE.encode()),), (bytearray(b"# Bundle file v0.3\n1 1"),), (bytearray(b"x"),)], "c binary").select(bundles.detect_bundle(F.col("c")).alias("k"))
    assert [r["k"] for r in kind.collect()] == ["nvm", "photosynther", "bundler", None]


@pytest.mark.parametrize("binary", [False, True])
def test_ply_round_trip(spark, tmp_path, binary):
    v = pd.DataFrame({"vid": range(4), "x": [0.0, 1, 0, 1.5], "y": [0.0, 0, 1, 1], "z": [0.25] * 4, "nx": [0.0] * 4, "ny": [0.0] * 4, "nz": [1.0] * 4, "r": [1.0, 0, 0.5, 0], "g": [0.0] * 4, "b": [1.0] * 4, "conf": [1.0, 0.5, 0, 1], "value": [2.0, 3, -1, 4]})
    f = pd.DataFrame([(0, 0, 1, 2), (1, 2, 1, 3)], columns=["fid", "v0", "v1", "v2"])
    vs, fs = (spark.createDataFrame(x).withColumn("path", F.lit("m.ply")) for x in (v, f))
    raw = bytes(ply.encode_ply(vs, fs, binary).first()["content"])
    (tmp_path / "m.ply").write_bytes(raw)
    got, faces = ply.read_ply(spark, str(tmp_path / "m.ply"))
    g = got.toPandas().sort_values("vid")
    assert np.allclose(g[["x", "y", "z", "nz", "conf", "value"]], v[["x", "y", "z", "nz", "conf", "value"]]) and np.allclose(g.r, [1, 0, 128 / 255, 0]) and g.u.isna().all()
    assert [tuple(r) for r in faces.orderBy("fid").select("v0", "v1", "v2").collect()] == [(0, 1, 2), (2, 1, 3)]
    kept, counts = ply.process_samples(ply.read_samples(spark, str(tmp_path / "m.ply")), factor=2.0, most=3.5)
    assert [r["scale"] for r in kept.orderBy("vid").collect()] == [4, 6] and counts.select("scale", "conf", "normal", "large").first() == (1, 0, 0, 1)


def test_ply_variants():
    head = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\n{}end_header\n"
    text = (head.format("ascii", "element face 2\nproperty list uchar int vertex_indices\n") + "0 0 -1\n1 0 -1\n0 1 -1\n1 1 -1\n4 0 1 3 2\n2 0 1\n").encode()
    table, info = ply.parse(text)
    assert ply.faces_of(table, info).tolist() == [[0, 1, 3], [3, 2, 0]]
    big = head.format("binary_big_endian", "element tristrips 1\nproperty list int int vertex_indices\n").encode() + np.array([0, 0, -1, 1, 0, -1, 0, 1, -1, 1, 1, -1], ">f4").tobytes() + np.array([4, 0, 1, 2, 3], ">i4").tobytes()
    table, info = ply.parse(big)
    assert ply.faces_of(table, info).tolist() == [[0, 1, 2], [2, 1, 3]] and table["vertex"]["z"].tolist() == [-1] * 4
    grid = head.format("ascii", "obj_info num_cols 2\nobj_info num_rows 2\nelement range_grid 4\nproperty list uchar int vertex_indices\n").encode() + b"0 0 -1\n1 0 -1\n0 1 -1\n1 1 -1\n1 0\n1 1\n1 2\n1 3\n"
    table, info = ply.parse(grid)
    assert len(ply.faces_of(table, info)) == 2
    with pytest.raises(ValueError):
        ply.parse(b"no ply")


def test_scenes(spark, tmp_path):
    for folder, number, name in (("view_0000.mve", 0, "first"), ("view_0001.mve", 1, "second"), ("view_0002.mve", 1, "again"), ("view_0003.mve", 9000, "far")):
        d = tmp_path / "scene" / "views" / folder
        d.mkdir(parents=True)
        (d / "meta.ini").write_text(f"# settings\n[camera]\nfocal_length = 0.9\nrotation = 1 0 0 0 1 0 0 0 1\ntranslation = 1 2 3\n[view]\nid = {number}\nname = {name}\n")
        (d / "depth-L0.mvei").write_bytes(scenes.encode_native(np.arange(6, dtype=np.float32).reshape(2, 3, 1)))
        (d / "notes.blob").write_bytes(scenes.BLOB_MARK + (3).to_bytes(8, "little") + b"abc")
        (d / "points.ply").write_bytes(b"ply")
    views = scenes.read_views(spark, str(tmp_path / "scene"))
    got = {r["id"]: r for r in views.collect()}
    assert set(got) == {0, 1} and got[1]["name"] == "second" and abs(got[0]["flen"] - 0.9) < 1e-6 and got[0]["trans"] == [1, 2, 3]
    values = scenes.list_values(spark, str(tmp_path / "scene"))
    assert {(r["name"]) for r in scenes.embedding_names(values).collect()} == {"depth-L0", "notes"} and scenes.embedding_names(values, "image").count() == 1
    assert values.count() == 8 and scenes.scene_bytes(values).count() == 4 and scenes.max_view_id(views).first()["id"] == 1
    images = scenes.read_native(spark, str(tmp_path / "scene" / "views" / "view_0000.mve" / "*.mvei")).first()
    assert (images["width"], images["height"], images["type"]) == (3, 2, "float32") and np.frombuffer(images["data"], np.float32).tolist() == [0, 1, 2, 3, 4, 5]
    raw = spark.read.format("binaryFile").load(str(tmp_path / "scene" / "views" / "view_0000.mve" / "*.mvei"))
    assert tuple(raw.select(scenes.native_header(F.col("content")).alias("h")).first()["h"]) == (3, 2, 1, "float32")
    blob = spark.read.format("binaryFile").load(str(tmp_path / "scene" / "views" / "view_0000.mve" / "*.blob"))
    told = blob.select(scenes.blob_payload(F.col("content")).alias("p"), "content").withColumn("again", scenes.blob_content(F.col("p")) == F.col("content")).first()
    assert bytes(told["p"]) == b"abc" and told["again"]
    meta = scenes.meta_text(views).where("folder = 'view_0000.mve'").first()
    (tmp_path / "copy" / "views" / "x.mve").mkdir(parents=True)
    (tmp_path / "copy" / "views" / "x.mve" / "meta.ini").write_bytes(bytes(meta["content"]))
    again = scenes.read_views(spark, str(tmp_path / "copy")).first()
    assert again["name"] == "first" and again["trans"] == [1, 2, 3] and again["rot"] == got[0]["rot"]
    new = scenes.new_views(views, spark.createDataFrame([(got[0]["scene"], "b.jpg"), (got[0]["scene"], "a.jpg"), ("other", "c.jpg")], "scene string, file string"))
    assert {r["file"]: r["folder"] for r in new.collect()} == {"a.jpg": "view_0002.mve", "b.jpg": "view_0003.mve", "c.jpg": "view_0000.mve"}
