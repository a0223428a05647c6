"""Depth maps as meshes. An image is one row and one task's work; meshes are tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images as I
from . import relational as R

#: The triangles of a 2 by 2 block of pixels (0 and 1 above 2 and 3).
TRIANGLES = np.array([[0, 2, 1], [0, 3, 1], [0, 2, 3], [1, 2, 3]])


def triangulate(depth: np.ndarray, inverse: np.ndarray, factor: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, triangles, pixel of each vertex) of a depth map (height, width) by its inverse calibration.

    Blocks of three depths give one triangle, of four two, divided by the diagonal of the smaller difference. With a factor,
    triangles with an edge longer in depth than so many widths of its nearer pixel (the square root of two more on diagonals)
    go. Vertices are numbered in the order in which triangles first use them.
    """
    h, w = depth.shape
    inverse = np.asarray(inverse, float).reshape(3, 3)
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    rays = np.stack([x, y, np.ones_like(x)], -1) @ inverse.T
    length = np.linalg.norm(rays, axis=-1)
    width = inverse[0, 0] * depth / length
    block = lambda v: np.stack([v[:-1, :-1], v[:-1, 1:], v[1:, :-1], v[1:, 1:]], -1).reshape(-1, 4)
    d, wide = block(depth), block(width)
    pixel = block(np.arange(h * w).reshape(h, w))
    have = d > 0
    n = have.sum(1)
    falls = np.abs(d[:, 0] - d[:, 3]) < np.abs(d[:, 1] - d[:, 2])
    use = np.zeros((len(d), 4), bool)
    for k, t in enumerate(TRIANGLES):
        use[:, k] = (n == 3) & have[:, t].all(1)
    use[:, [1, 2]] |= ((n == 4) & falls)[:, None]
    use[:, [0, 3]] |= ((n == 4) & ~falls)[:, None]
    if factor > 0:
        for k, t in enumerate(TRIANGLES):
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                nearer = np.where(d[:, b] < d[:, a], wide[:, b], wide[:, a])
                use[:, k] &= np.abs(d[:, a] - d[:, b]) <= nearer * factor * (math.sqrt(2) if a + b == 3 else 1)
    rows, kinds = np.nonzero(use)
    # Of two triangles of a block the one with a smaller number comes first.
    faces = pixel[rows[:, None], TRIANGLES[kinds]]
    seen, first = np.unique(faces.ravel(), return_index=True)
    order = np.argsort(first)
    number = np.empty(len(seen), np.int64)
    number[order] = np.arange(len(seen))
    vertices = seen[order]
    pos = rays.reshape(-1, 3)[vertices] / length.ravel()[vertices, None] * depth.ravel()[vertices, None]
    return pos, number[np.searchsorted(seen, faces)].reshape(-1, 3), vertices


def depthmap_meshes(images: DataFrame, key: str, inverse: str, factor: float = 0.0, world: str | None = None, colors: str | None = None) -> tuple[DataFrame, DataFrame]:
    """images (key, the columns of a one-channel depth map, and an array of nine of the inverse calibration) -> vertices (key,
    vid, x, y, z, pixel, and r, g, b from 0 to 1 of a packed byte image) and faces (key, fid, v0, v1, v2). world: a column
    with a 4 x 4 camera-to-world transformation of positions."""
    kind = dict(images.dtypes)[key]
    more = [c for c in (world, colors) if c]

    def made(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos, faces, pixel = triangulate(I.array_of(r)[..., 0].astype(float), np.array(r[inverse], float), factor)
        if world:
            m = np.array(r[world], float).reshape(4, 4)
            pos = pos @ m[:3, :3].T + m[:3, 3]
        return pos, faces, pixel

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                pos, _, pixel = made(r)
                out = pd.DataFrame({key: r[key], "vid": np.arange(len(pos)), "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "pixel": pixel})
                rgb = np.frombuffer(r[colors], np.uint8).reshape(-1, 3)[pixel] / 255 if colors else np.full((len(pos), 3), np.nan)
                yield out.assign(r=rgb[:, 0], g=rgb[:, 1], b=rgb[:, 2])

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                f = made(r)[1]
                yield pd.DataFrame({key: r[key], "fid": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]})

    rows = images.select(key, *I.FIELDS, inverse, *more).where(F.col("data").isNotNull())
    return rows.mapInPandas(vertices, f"{key} {kind}, vid long, x double, y double, z double, pixel long, r double, g double, b double"), rows.mapInPandas(faces, f"{key} {kind}, fid long, v0 long, v1 long, v2 long")


def border(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return R.vertex_classes(vertices, faces).where("class = 'border'").select("vid")


def mesh_confidences(vertices: DataFrame, faces: DataFrame, rounds: int) -> DataFrame:
    """vid, conf: how many edges a vertex lies from the border, over `rounds`; 1 from there on."""
    conf = border(vertices, faces).withColumn("ring", F.lit(0)) if rounds else vertices.select("vid", F.lit(0).alias("ring")).limit(0)
    e = R.edges(faces).select("e1", "e2").distinct()
    both = R.cut(e.select(F.col("e1").alias("vid"), F.col("e2").alias("o")).union(e.select("e2", "e1")), "edges")
    conf = R.cut(conf, "rings")
    for k in range(1, rounds):
        near = conf.where(F.col("ring") == k - 1).join(both, "vid").select(F.col("o").alias("vid")).distinct().join(conf, "vid", "left_anti")
        conf = R.cut(conf.union(near.withColumn("ring", F.lit(k))), "rings")
    return vertices.select("vid").join(conf, "vid", "left").select("vid", F.coalesce(F.col("ring") / F.lit(float(max(rounds, 1))), F.lit(1.0)).alias("conf"))


def mesh_peeling(vertices: DataFrame, faces: DataFrame, rounds: int) -> DataFrame:
    """Faces left when those at the border go, `rounds` times."""
    for _ in range(rounds):
        out = border(vertices, faces)
        gone = R.corners(faces).join(out, "vid").select("fid").distinct()
        faces = R.cut(faces.join(gone, "fid", "left_anti").select(*faces.columns), "faces")
    return faces


def join_masks(vertices: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Vertices (key, pixel) whose pixel no mask (key, pixel, value) of their image blanks with zero."""
    return vertices.join(masks.where("value = 0").select(key, "pixel").distinct(), [key, "pixel"], "left_anti")
