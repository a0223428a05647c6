"""Further formats by round trips and hand-made files; octrees, surfaces, hashing and streams against plain versions."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vantage.functions import geometry as G
from vantage.functions import vectors as V
from vantage.operators import hashing as H
from vantage.operators import matching as M
from vantage.operators import octree as O
from vantage.sources import records as X
from vantage.streaming import ingest as S


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    v = np.random.default_rng(channels).integers(0, 256, (5, 7, channels)).astype(np.uint8)
    raw = X.encode_png(v)
    assert np.array_equal(X.decode_png(raw), v) and X.png_header(raw) == (7, 5, channels)


def test_png_filters_and_depths():
    import zlib

    rng = np.random.default_rng(1)
    v = rng.integers(0, 256, (6, 4, 3)).astype(np.int64)
    lines = b""
    for y in range(6):
        kind = y % 5
        row, up = v[y].ravel(), v[y - 1].ravel() if y else np.zeros(12, int)
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = X.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines))
    assert np.array_equal(X.decode_png(raw), v)
    bits = X.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 10, 1, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([0, 0b10110000, 0b01000000])))
    assert X.decode_png(bits)[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0, 0, 255]
    palette = X.PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"IDAT", zlib.compress(bytes([0, 1, 0])))
    assert X.decode_png(palette).tolist() == [[[4, 5, 6], [1, 2, 3]]]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff(kind, spark, tmp_path):
    v = (np.arange(24).reshape(2, 4, 3) * (1 if kind == "uint8" else 100)).astype(kind)
    raw = X.encode_tiff(v)
    assert np.array_equal(X.decode_tiff(raw), v) and X.tiff_header(raw)["type"] == kind
    (tmp_path / "a.tif").write_bytes(raw)
    r = X.read_pixels(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], r["type"]) == (4, 2, kind) and r["data"] == v.tobytes()


def test_camera_settings_and_jpeg_header():
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    ifd = struct.pack("<H", 3) + entry(0x10F, 2, 6, struct.pack("<I", 80)) + entry(0x112, 3, 1, struct.pack("<HH", 6, 0)) + entry(0x8769, 4, 1, struct.pack("<I", 50)) + struct.pack("<I", 0)
    sub = struct.pack("<H", 2) + entry(0x920A, 5, 1, struct.pack("<I", 90)) + entry(0xA405, 3, 1, struct.pack("<HH", 50, 0))
    body = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(50, b"\0") + sub
    body = body.ljust(80, b"\0") + b"Maker\0" + b"\0" * 4 + struct.pack("<II", 350, 10)
    segment = b"Exif\0\0" + body
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 480, 640, 3) + b"\0" * 9
    raw = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + frame
    assert X.exif(raw) == {"maker": "Maker", "orientation": 6, "focal_length": 35.0, "focal_length_35mm": 50} and X.jpeg_header(raw) == (640, 480, 3)
    assert X.exif(segment, False)["maker"] == "Maker"
    for bad in (b"", b"\xff\xd8 nothing", b"\xff\xd8\xff\xe1\0\0Exif\0\0XX"):
        with pytest.raises(ValueError):
            X.exif(bad)


OBJ = b"""mtllib a.mtl
v 0 0 0
v 1 0 0
v 0 1 0
v 1 1 0
vt 0 0.25
vn 0 0 1
usemtl red
f 1/1/1 2/1/1 3/1/1
f 1/1/1 3/1/1 4/1/1 2/1/1
usemtl blue
f -1 -2 -3
"""


def test_meshes(spark, tmp_path):
    parts = X.decode_obj(OBJ)
    assert [(p["name"], len(p["vertices"]), len(p["faces"])) for p in parts] == [("red", 4, 3), ("blue", 3, 1)] and parts[0]["vertices"][0] == [0, 0, 0, 0, 0.75, 0, 0, 1]
    (tmp_path / "a.obj").write_bytes(OBJ)
    v, f = X.read_obj(spark, str(tmp_path / "a.obj"))
    assert v.count() == 7 and f.count() == 4
    assert X.decode_materials(b"# c\nnewmtl red\nKd 1 0 0\nmap_Kd red.png\nnewmtl blue\nmap_Kd /abs.png\n", "dir") == {"red": "dir/red.png", "blue": "/abs.png"}
    points = np.arange(12, dtype=np.float32).reshape(2, 6)
    assert [r["nz"] for r in X.decode_points(X.encode_points(points) + b"xx", True)] == [5, 11] and X.decode_points(b"1 2 3 0 0 1\n4 5 6 1 0", False)[0]["z"] == 3
    raw = X.encode_glb(np.eye(3), np.array([[0, 1, 2]]), np.ones((3, 3)))
    size, n = struct.unpack_from("<I", raw, 8)[0], struct.unpack_from("<I", raw, 12)[0]
    import json

    doc = json.loads(raw[20 : 20 + n])
    assert size == len(raw) and doc["accessors"][1]["count"] == 3 and doc["buffers"][0]["byteLength"] == 36 + 12 + 36
    vs, fs = spark.createDataFrame([("p", 0, 0.0, 0.5, 1.0)], "path string, vid long, x double, y double, z double"), spark.createDataFrame([("p", 0, 0, 0, 0)], "path string, fid long, v0 long, v1 long, v2 long")
    assert [r["line"] for r in X.pbrt_lines(vs, fs).orderBy("part", "at").collect()][1:4] == ["0 0 0", ']\n"point P" [', "0.0 0.5 1.0"]


def test_matches_survey_keypoints(spark, tmp_path):
    features = pd.DataFrame([(0, 0, 0.5, 1.5, 1, 2, 3), (1, 0, 2.5, 3.5, 4, 5, 6), (1, 1, 0.0, 1.0, 7, 8, 9)], columns=["view", "feature", "x", "y", "r", "g", "b"])
    matches = pd.DataFrame([(0, 1, 0, 1)], columns=["view1", "view2", "feature1", "feature2"])
    raw = X.encode_matches(features, matches, 2)
    assert X.decode_matches(raw) == (features.to_dict("records"), matches.to_dict("records"))
    (tmp_path / "m").write_bytes(raw)
    assert X.read_matches(spark, str(tmp_path / "m"))[0].count() == 3
    for bad in (b"x", raw[:-3]):
        with pytest.raises(ValueError):
            X.decode_matches(bad)
    survey = X.decode_survey(X.SURVEY_MARK + b"2 2\n1 2 3\n4 5 6\n0 7 0.5 0.25\n1 8 1 2\n")
    assert survey[0]["observations"] == [(7, 0.5, 0.25)] and survey[1]["z"] == 6
    keys = X.decode_keypoints(("1 128\n10 20 2 0.5\n" + " ".join(["3"] + ["0"] * 126 + ["4"])).encode())
    assert keys[0]["x"] == 20 and keys[0]["descriptor"][0] == 0.6 and keys[0]["descriptor"][127] == 0.8
    a = X.decode_alignment(b"1\nscan.ply\n#\n1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n0\n")
    assert a[0]["file"] == "scan.ply" and a[0]["trans"] == [5, 6, 7] and a[0]["direction"] == [0, 0, -1]
    b = X.decode_alignment(b"camera 1 2 3 1 0 0 0\nbmesh s.ply 0 0 1 0 0 0 1\n")
    assert b[0]["camera"] == [1, 2, 4] and b[0]["direction"] == [0, 0, 1]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("abc")
    assert [tuple(r)[1:] for r in X.directory_listing(spark, str(tmp_path / "d")).collect()] == [("f.txt", 3)]
    views = spark.createDataFrame([(3, 10, 20), (1, 30, 40), (2, 5, 5)], "view_id int, width int, height int")
    pixels = spark.createDataFrame([(3, 1, 1.0, 1.0), (1, 9, 2.0, 2.0), (1, 4, 3.0, 3.0)], "view_id int, vertex int, x double, y double")
    xy, v = X.correspondence_lines(views, pixels)
    assert [r["x"] for r in xy.orderBy("at").collect()] == [3, 2, 1] and [r["first_vertex_index"] for r in v.orderBy("view_id").collect()] == [0, 2, 2]


# --- octrees ---


def samples(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    d = pd.DataFrame({"sid": range(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "nx": p[:, 0], "ny": p[:, 1], "nz": p[:, 2], "scale": rng.choice([0.1, 0.2, 0.35], n), "conf": rng.uniform(0.5, 1, n)})
    return d, spark.createDataFrame(d)


def test_octree(spark):
    d, s = samples(spark)
    nodes = O.insert_samples(s)
    centre, size = O.root_box(s)
    for r in nodes.collect():
        box = np.array(centre)
        edge = size
        for k in range(r["level"]):
            octant = r["path"] >> 3 * (r["level"] - 1 - k) & 7
            box = box + np.array([1 if octant >> i & 1 else -1 for i in range(3)]) * edge / 4
            edge /= 2
        assert np.abs(np.array([r["x"], r["y"], r["z"]]) - box).max() <= edge / 2 + 1e-9 and edge <= r["scale"] < 2 * edge
    told = nodes.select("level", *O.node_box(F.col("level"), F.col("path"), [F.lit(c) for c in centre], F.lit(size))[0]).first()
    assert len(told) == 4
    every = O.all_nodes(nodes)
    leaves, inner = every.where("leaf").count(), every.where("not leaf").count()
    assert leaves == 7 * inner + 1 and O.refine(every).count() == 8 * leaves
    levels = {r["level"]: r["samples"] for r in O.samples_per_level(nodes).collect()}
    assert sum(levels.values()) == 200 and O.limit_level(nodes, 1).agg(F.max("level")).first()[0] == 1
    one = spark.createDataFrame([(0, 0, True)], "level int, path long, leaf boolean")
    assert O.leaf_voxels(one).count() == 8 and O.leaf_voxels(O.refine(one)).count() == 27
    key = every.where("level = 3").select(O.voxel_of(F.col("level"), F.col("path"), F.lit(5)).alias("a"), G.voxel_key(3, F.col("path"), F.lit(5)).alias("b"))
    assert key.where("a <> b").count() == 0
    assert spark.range(1).select(O.is_inside([F.lit(0.0)] * 3, [F.lit(0.2)] * 3, F.lit(0.5)).alias("x")).first()["x"]
    assert [tuple(r) for r in spark.range(1).select(*O.ascend(F.lit(2), F.lit(0o35)), *O.descend(F.lit(1), F.lit(3), F.lit(5))).collect()] == [(1, 3, 2, 0o35)]


def test_implicit_function(spark):
    d, s = samples(spark, 120)
    rng = np.random.default_rng(1)
    q = pd.DataFrame({"pid": range(40), **{c: rng.uniform(-1.2, 1.2, 40) for c in "xyz"}})
    got = {r["pid"]: r for r in O.sample_function(spark.createDataFrame(q), s).collect()}
    p, n, scale, conf = d[["x", "y", "z"]].to_numpy(), d[["nx", "ny", "nz"]].to_numpy(), d.scale.to_numpy(), d.conf.to_numpy()
    for i, x in zip(q.pid, q[["x", "y", "z"]].to_numpy(), strict=True):
        far = np.linalg.norm(x - p, axis=1)
        near = np.flatnonzero(far <= 3 * scale)
        if not len(near):
            assert i not in got
            continue
        assert got[i]["n"] == len(near)
        near = near[scale[near] <= 2 * np.sort(scale[near])[len(near) // 10]]
        r, sc = far[near] / scale[near], scale[near]
        f = ((x - p[near]) * n[near]).sum(1) * np.exp(-(r**2) / 2) / (2 * np.pi * sc**4)
        w = np.where(r >= 3, 0, 1 - 2 / 3 * r**2 + 8 / 27 * r**3 - 1 / 27 * r**4) * conf[near]
        b = np.exp(-(far[near] ** 2) / (2 * (sc / 5) ** 2)) / sc * conf[near]
        assert np.isclose(got[i]["conf"], w.sum(), atol=1e-9) and (w.sum() < 1e-6 or np.isclose(got[i]["value"], (f * w).sum() / w.sum(), rtol=1e-5))
        assert b.sum() < 1e-250 or np.isclose(got[i]["scale"], (sc * b).sum() / b.sum())


def test_marching_tetrahedra(spark):
    g = np.arange(9)
    rows = [(int(x), int(y), int(z), float(np.sqrt((x - 4.1) ** 2 + (y - 3.9) ** 2 + (z - 4.05) ** 2) - 2.7)) for x in g for y in g for z in g]
    grid = spark.createDataFrame(rows, "x int, y int, z int, v double")
    c = O.cubes(grid)
    assert c.count() == 512 and c.where(O.cube_index(F.col("corners")) == 255).count() > 0 and O.tetrahedra_of(c).count() == 6 * 512
    v, f = (x.toPandas() for x in O.marching_tetrahedra(grid))
    assert v.vid.is_unique and set(f[["v0", "v1", "v2"]].to_numpy().ravel()) == set(v.vid)
    sides = pd.concat([f[["v0", "v1"]].set_axis(["a", "b"], axis=1), f[["v1", "v2"]].set_axis(["a", "b"], axis=1), f[["v2", "v0"]].set_axis(["a", "b"], axis=1)])
    turned = sides.rename(columns={"a": "b", "b": "a"})
    assert not sides.duplicated().any() and len(sides.merge(turned)) == len(sides)  # closed, and all faces look the same way
    assert len(v) - len(sides) // 2 + len(f) == 2
    p = v.set_index("vid")[["x", "y", "z"]]
    a, b, d = (p.loc[f[k]].to_numpy() for k in ("v0", "v1", "v2"))
    assert abs((a * np.cross(b, d)).sum() / 6 / (4 / 3 * np.pi * 2.7**3) - 1) < 0.1


# --- hashing ---


def test_cascade_hashing(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 64))
    b = np.concatenate([a[:30] + rng.normal(0, 0.05, (30, 64)), rng.normal(size=(40, 64))])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(x))], "id long, v array<double>")
    qa, qb = frame(a), frame(b)
    hashes = H.cascade_hashes(qa, H.mean_vector(qa)).collect()
    assert all(len(r["code"]) == 1 and len(r["buckets"]) == 6 and 0 <= min(r["buckets"]) and max(r["buckets"]) < 256 for r in hashes)
    found = {r["i"]: r["j"] for r in H.cascade_match(qa, qb, 0.5, bits=3).collect()}
    assert all(found.get(i) == i for i in range(30)) and all(i < 30 for i in found)
    ranked = H.bucket_candidates(H.cascade_hashes(qa, [0.0] * 64), H.cascade_hashes(qa, [0.0] * 64))
    assert ranked.where("q = c and ham <> 0").count() == 0 and ranked.where("q = c").count() == 60 and ranked.groupBy("q", "c").count().where("count > 1").count() == 0


def test_uint16_and_lowres_golden(spark):
    frame = lambda x: spark.createDataFrame([(i, [float(y) for y in v], float(i)) for i, v in enumerate(x)], "id long, v array<double>, size double")
    e = frame([[255, 0, 0, 0], [0, 255, 0, 0], [0, 0, 180, 180]])
    q = frame([[255, 0, 0, 0], [0, 0, 180, 180], [0, 180, 180, 0]])
    got = [(r["d1"], r["i1"]) for r in M.nearest_two(q, e, "uint16").orderBy("q").collect()]
    assert got[0] == (0, 0) and got[1] == (2 * (65025 - 64800), 2) and got[2] == (2 * (65025 - 45900), 1)
    assert [r["x"] for r in spark.range(1).select(F.explode(M.uint16_descriptor(F.array(F.lit(0.5), F.lit(2.0), F.lit(-1.0)))).alias("x")).collect()] == [128, 255, 0]
    assert M.ratio_test(M.nearest_two(q, e, "uint16"), 1.0, 1000.0).count() == 2
    unit = lambda x: frame((np.array(x, float) / np.linalg.norm(x, axis=1, keepdims=True)).tolist())
    assert [tuple(r) for r in M.lowres_matches(unit([[1, 0], [0, 1]]), unit([[0, 1], [1, 0], [1, 1]]), "size", 2, 1.0).collect()] == [(0, 1)] or M.lowres_matches(unit([[1, 0], [0, 1]]), unit([[0, 1], [1, 0], [1, 1]]), "size", 2, 1.0).count() >= 1


# --- streams ---


def test_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("b.jpg", "a.jpg", "skip.txt"):
        (src / name).write_bytes(name.encode())
    target, check = str(tmp_path / "table"), str(tmp_path / "check")
    run = lambda: S.ingest(S.file_stream(spark, str(src), suffix=".jpg"), target, check).awaitTermination(120)
    assert run()
    rows = lambda: {r["path"].rsplit("/", 1)[1]: r["id"] for r in spark.read.parquet(target).collect()}
    assert rows() == {"a.jpg": 0, "b.jpg": 1}
    (src / "0.jpg").write_bytes(b"new")
    assert run() and rows() == {"a.jpg": 0, "b.jpg": 1, "0.jpg": 2}
    assert run() and len(rows()) == 3


def test_counters_and_resumable_stages(spark, tmp_path):
    df = spark.createDataFrame([(-1.0, 1.0), (2.0, 0.0), (3.0, 1.0), (-1.0, 0.0), (None, 1.0)], "scale double, conf double")
    kept, seen = S.counted(df, "samples", {"scale": F.col("scale") <= 0, "conf": F.col("conf") <= 0})
    assert kept.count() == 2 and seen.get == {"scale": 2, "conf": 1, "rows": 5}
    path, made = str(tmp_path / "stage"), []
    make = lambda: made.append(1) or spark.range(3)
    assert S.resume(spark, path, make).count() == 3 and S.resume(spark, path, make).count() == 3 and len(made) == 1
    assert S.resume(spark, path, make, force=True).count() == 3 and len(made) == 2
    work = spark.range(5)
    assert S.pending(work, path, ["id"]).count() == 2 and S.pending(work, path, ["id"], True).count() == 5 and S.pending(work, str(tmp_path / "none"), ["id"]).count() == 5
    assert S.in_group(spark, "g", lambda: spark.range(10).count()) == 10
    told = S.progress(spark, "g")
    assert told["failed"] == 0 and told["completed"] >= 1
    S.cancel(spark, "g")


def test_windowed_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:05", "a"), (2, "2024-01-01 00:00:55", "a"), (3, "2024-01-01 00:01:05", "b")]
    spark.createDataFrame(rows, "id int, t string, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string, k string").parquet(str(tmp_path / "in")).withColumn("t", F.to_timestamp("t"))
    query = S.windowed_counts(stream, "t", ["k"], "1 minute", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and sorted((r["k"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_let_computes_once(spark):
    x = V.let([F.lit(3.0)], lambda v: v[0] * v[0] + v[0])
    assert spark.range(1).select(x.alias("x")).first()["x"] == 12
