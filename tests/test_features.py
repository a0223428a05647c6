"""Keypoints and depth meshes on made-up images."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vantage.operators import depthmaps as D
from vantage.operators import images as I
from vantage.operators import keypoints as K


def blobs(turn=False):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:120, :150].astype(float)
    v = np.zeros((120, 150))
    for _ in range(25):
        cx, cy, s = rng.uniform(25, 125), rng.uniform(25, 95), rng.uniform(2, 5)
        v += rng.choice([-1, 1]) * 0.4 * np.exp(-((x - cx) ** 2 + ((y - cy) * rng.uniform(0.7, 1.4)) ** 2) / (2 * s * s))
    v = np.clip(128 + 100 * v, 0, 255).astype(np.uint8)[..., None]
    return I.rotate(v, "cw") if turn else v


def test_keypoints_survive_a_quarter_turn(spark):
    a, b = blobs(), blobs(True)
    rows = [(k, *(I.fields_of(v)[c] for c in I.FIELDS)) for k, v in (("a", a), ("b", b), ("none", np.zeros((40, 40, 1), np.uint8)))] + [("null", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "image string, width int, height int, channels int, type string, data binary")
    got = K.features(df, "image").toPandas()
    p, q = (got[got.image == k].sort_values("feature") for k in ("a", "b"))
    assert set(got.image) == {"a", "b"} and len(p) >= 10 and (np.diff(p.scale) <= 1e-5).all()
    d, e = np.stack(p.descriptor), np.stack(q.descriptor)
    assert np.allclose(np.linalg.norm(d, axis=1), 1, atol=1e-5) and d.max() < 0.5
    best = (d @ e.T).argmax(1)
    right = np.hypot(q.x.to_numpy()[best] + p.y.to_numpy(), q.y.to_numpy()[best] - p.x.to_numpy()) < 0.01
    turned = np.abs((q.orientation.to_numpy()[best] - p.orientation.to_numpy() - np.pi / 2 + np.pi) % (2 * np.pi) - np.pi) < 0.1
    assert (right & turned).mean() > 0.8


def test_gradients_and_extrema():
    v = np.tile(np.arange(6.0), (5, 1))
    g, a = K.gradients(v)
    assert g[2, 2] == 1 and a[2, 2] == 0 and g[0].max() == 0
    d = [np.zeros((5, 5)) for _ in range(3)]
    d[1][2, 2] = 1
    assert K.extrema(d).tolist() == [[0, 2, 2]] and K.localise([x[:, :] for x in d], 0, 2, 2) is not None


def test_depth_meshes(spark):
    depth = np.full((4, 5), 2.0)
    depth[0, 0] = depth[3, 4] = 0
    depth[:, 3:] *= np.where(depth[:, 3:] > 0, 3, 1)
    inverse = np.array([[0.1, 0, -0.25], [0, 0.1, -0.2], [0, 0, 1]])
    pos, faces, pixel = D.triangulate(depth, inverse)
    assert len(faces) == 22 and len(pos) == 18 and sorted(pixel.tolist()) == [i for i in range(20) if i not in (0, 19)]
    assert faces[0].tolist() == [0, 1, 2] and np.allclose(np.linalg.norm(pos, axis=1), depth.ravel()[pixel])
    _, fewer, _ = D.triangulate(depth, inverse, 5.0)
    assert 0 < len(fewer) < 22
    world = np.eye(4)
    world[0, 3] = 7
    rows = [("a", *(I.fields_of(depth[..., None])[c] for c in I.FIELDS), inverse.ravel().tolist(), world.ravel().tolist(), bytes(range(60)))]
    df = spark.createDataFrame(rows, "image string, width int, height int, channels int, type string, data binary, inv array<double>, world array<double>, rgb binary")
    v, f = D.depthmap_meshes(df, "image", "inv", world="world", colors="rgb")
    v = v.toPandas().sort_values("vid")
    assert np.allclose(v[["x", "y", "z"]], pos + [7, 0, 0]) and np.allclose(v.r, 3 * v.pixel / 255) and f.count() == 22
    masks = spark.createDataFrame([("a", int(pixel[0]), 0), ("a", int(pixel[1]), 1)], "image string, pixel long, value int")
    assert D.join_masks(spark.createDataFrame(v), masks, "image").count() == 17


def test_confidences_and_peeling(spark):
    n = 7
    vs = spark.createDataFrame(pd.DataFrame({"vid": range(n * n)}))
    quads = [(y * n + x, y * n + x + 1, (y + 1) * n + x, (y + 1) * n + x + 1) for y in range(n - 1) for x in range(n - 1)]
    tri = [t for a, b, c, d in quads for t in ((a, c, b), (b, c, d))]
    fs = spark.createDataFrame([(i, *t) for i, t in enumerate(tri)], "fid long, v0 long, v1 long, v2 long")
    got = {r["vid"]: r["conf"] for r in D.mesh_confidences(vs, fs, 2).collect()}
    ring = {y * n + x: min(x, y, n - 1 - x, n - 1 - y) for y in range(n) for x in range(n)}
    # Along the triangles' diagonals a vertex may be nearer to the border, never farther.
    assert all(got[v] == 0 for v, r in ring.items() if r == 0) and all(got[v] == 0.5 for v, r in ring.items() if r == 1) and got[24] == 1
    left = D.mesh_peeling(vs, fs, 1)
    assert {x for r in left.collect() for x in (r["v0"], r["v1"], r["v2"])} == {v for v, r in ring.items() if r >= 1}
    assert D.mesh_peeling(vs, fs, 3).count() == 0 and D.mesh_confidences(vs, fs, 0).where("conf <> 1").count() == 0
