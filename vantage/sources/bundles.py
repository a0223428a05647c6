"""Bundle files: cameras and points with references, as text or binary.

A file is read and parsed by one task (binaryFile), many files by many; each function gives tables keyed by path.
cameras: path, cam, flen, k1, k2, aspect, ppx, ppy, rot (9), trans (3), name. points: path, point, pos (3), color (3, from 0
to 1), refs (array of view, feature, x, y). A malformed file raises an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<view:int,feature:int,x:float,y:float>"
CAMERAS = "path string, cam int, flen float, k1 float, k2 float, aspect float, ppx float, ppy float, rot array<float>, trans array<float>, name string"
POINTS = f"path string, point long, pos array<float>, color array<float>, refs array<{REF}>"
MAX_CAMERAS, MAX_POINTS = 10_000, 100_000_000
Parsed = tuple[list[dict], list[dict]]


def quaternion_matrix(q: list[float]) -> np.ndarray:
    """The rotation of (w, x, y, z), normalised."""
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def _camera(cam: int, flen=0.0, k1=0.0, k2=0.0, aspect=1.0, pp=(0.5, 0.5), rot=None, trans=(0, 0, 0), name=None) -> dict:
    return {"cam": cam, "flen": flen, "k1": k1, "k2": k2, "aspect": aspect, "ppx": pp[0], "ppy": pp[1], "rot": [float(x) for x in (np.eye(3) if rot is None else np.asarray(rot)).ravel()], "trans": [float(x) for x in trans], "name": name}


def _counts(cameras: int, points: int) -> None:
    if not (0 <= cameras <= MAX_CAMERAS and 0 <= points <= MAX_POINTS):
        raise ValueError("too many cameras or points")


def parse_bundle(raw: bytes) -> Parsed:
    """By its first line `drews 1.0` (references with a quality, which goes) or `# Bundle file v0.3` (with a position). A file
    that ends within the points gives those before."""
    head, _, rest = raw.decode().partition("\n")
    kinds = {"drews 1.0": 3, "# Bundle file v0.3": 4}
    if head.strip() not in kinds:
        raise ValueError("no bundle file")
    size, word = kinds[head.strip()], iter(rest.split())
    take = lambda n: [float(next(word)) for _ in range(n)]
    try:
        n_cams, n_points = int(next(word)), int(next(word))
        _counts(n_cams, n_points)
        cams = [_camera(i, *take(3), rot=take(9), trans=take(3)) for i in range(n_cams)]
    except StopIteration:
        raise ValueError("the file ends before its cameras do") from None
    points = []
    try:
        for i in range(n_points):
            pos, color, n = take(3), take(3), int(next(word))
            if not 0 <= n <= n_cams:
                raise ValueError("number of references")
            refs = [take(size) for _ in range(n)]
            points.append({"point": i, "pos": pos, "color": [c / 255 for c in color], "refs": [(int(r[0]), int(r[1]), *(r[2:] if size == 4 else (-1.0, -1.0))) for r in refs]})
    except StopIteration:
        pass
    return cams, points


def parse_nvm(raw: bytes) -> Parsed:
    """NVM_V3, its first model: quaternions and centres; points without references go."""
    head, _, rest = raw.decode().partition("\n")
    if not head.split() or head.split()[0] != "NVM_V3":
        raise ValueError("no NVM file")
    word = iter(rest.split())
    take = lambda n: [float(next(word)) for _ in range(n)]
    try:
        n_cams = int(next(word))
        _counts(n_cams, 0)
        cams, points = [], []
        for i in range(n_cams):
            name, (flen,), quat, centre, (k1, _end) = next(word), take(1), take(4), take(3), take(2)
            rot = quaternion_matrix(quat)
            cams.append(_camera(i, flen, k1, rot=rot, trans=-rot @ centre, name=name))
        for i in range(int(next(word))):
            pos, color, n = take(3), take(3), int(next(word))
            if n == 0:
                continue
            if not 2 <= n <= n_cams:
                raise ValueError("number of references")
            refs = [(int(next(word)), int(next(word)), *take(2)) for _ in range(n)]
            points.append({"point": i, "pos": pos, "color": [c / 255 for c in color], "refs": refs})
    except StopIteration:
        raise ValueError("the file ends early") from None
    return cams, points


def _tables(spark: SparkSession, path: str, parse: Callable[[bytes], Parsed]) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def table(which: int, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name, content in zip(b["path"], b["content"], strict=True):
                    rows = parse(content)[which]
                    for at in range(0, len(rows), 10_000):
                        yield pd.DataFrame([{"path": name} | r for r in rows[at : at + 10_000]], columns=names)

        return raw.mapInPandas(run, schema)

    return table(0, CAMERAS), table(1, POINTS)


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, points) of photosynther and bundler files."""
    return _tables(spark, path, parse_bundle)


def read_nvm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _tables(spark, path, parse_nvm)


# --- COLMAP ---

#: Names of camera models by their number in binary files, and how many parameters they have.
MODELS = [("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12)]


def camera_of_model(model: str, params: list[float], width: int, height: int) -> dict:
    """flen, aspect and principal point of the two models without distortion; others raise an error. The focal length of
    SIMPLE_PINHOLE stays as it is in the file."""
    if model == "SIMPLE_PINHOLE":
        return {"flen": params[0], "aspect": 1.0, "pp": (params[1] / width, params[2] / height)}
    if model != "PINHOLE":
        raise ValueError(f"camera model {model} has distortion")
    fx, fy, cx, cy = params[:4]
    portrait = width / height * (fy / fx) < 1
    return {"flen": fy / height if portrait else fx / width, "aspect": fy / fx, "pp": (cx / width, cy / height)}


def _rows(raw: bytes) -> list[list[str]]:
    return [x.split() for x in raw.decode().splitlines() if not x.startswith("#")]


def colmap_cameras_text(raw: bytes) -> dict[int, dict]:
    return {int(r[0]): camera_of_model(r[1], [float(x) for x in r[4:]], int(r[2]), int(r[3])) for r in _rows(raw) if r}


def colmap_images_text(raw: bytes) -> list[tuple]:
    """(view from 0, quaternion, translation, camera, name, points in the image (x, y, point from 0 or -1)): two lines each."""
    rows, out = _rows(raw), []
    for a, b in zip(rows[::2], [*rows[1::2], []], strict=False):
        if a:
            v = [float(x) for x in a[1:8]]
            seen = [(float(x), float(y), int(p) - 1 if int(p) != -1 else -1) for x, y, p in zip(b[::3], b[1::3], b[2::3], strict=False)]
            out.append((int(a[0]) - 1, v[:4], v[4:], int(a[8]), a[9], seen))
    return out


def colmap_points_text(raw: bytes) -> list[tuple]:
    """(point from 0, position, colour, [(view from 0, place in the image)])."""
    out = []
    for r in _rows(raw):
        if len(r) > 8:
            out.append((int(r[0]) - 1, [float(x) for x in r[1:4]], [int(x) / 255 for x in r[4:7]], [(int(a) - 1, int(b)) for a, b in zip(r[8::2], r[9::2], strict=False)]))
    return out


class Bytes:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        end = self.raw.index(0, self.at)
        out, self.at = self.raw[self.at : end].decode(), end + 1
        return out


def colmap_cameras_binary(raw: bytes) -> dict[int, dict]:
    b, out = Bytes(raw), {}
    for _ in range(b.take("Q")[0]):
        cam, model, width, height = b.take("IiQQ")
        name, n = MODELS[model]
        out[cam] = camera_of_model(name, list(b.take(f"{n}d")), width, height)
    return out


def colmap_images_binary(raw: bytes) -> list[tuple]:
    b, out = Bytes(raw), []
    for _ in range(b.take("Q")[0]):
        view, *v, cam = b.take("I7dI")
        name, n = b.text(), b.take("Q")[0]
        seen = [b.take("ddq") for _ in range(n)]
        out.append((view - 1, v[:4], v[4:], cam, name, [(x, y, p - 1 if p != -1 else -1) for x, y, p in seen]))
    return out


def colmap_points_binary(raw: bytes) -> list[tuple]:
    b, out = Bytes(raw), []
    for _ in range(b.take("Q")[0]):
        point, *rest = b.take("Q3d3BdQ")
        track = b.take(f"{2 * rest[7]}I")
        out.append((point - 1, rest[:3], [c / 255 for c in rest[3:6]], [(v - 1, k) for v, k in zip(track[::2], track[1::2], strict=True)]))
    return out


COLMAP = {"cameras": (colmap_cameras_text, colmap_cameras_binary), "images": (colmap_images_text, colmap_images_binary), "points3D": (colmap_points_text, colmap_points_binary)}


def join_colmap(cameras: dict[int, dict], images: list[tuple], points: list[tuple]) -> Parsed:
    """A view refers to a camera; of several references of a point in one view the first one counts."""
    cams = []
    for view, quat, trans, cam, name, _ in images:
        own = cameras[cam]
        cams.append(_camera(view, own["flen"], aspect=own["aspect"], pp=own["pp"], rot=quaternion_matrix(quat), trans=trans, name=name))
    seen, out = {view: own for view, *_, own in images}, []
    for point, pos, color, track in points:
        first: dict[int, int] = {}
        for v, k in track:
            first.setdefault(v, k)
        refs = [(v, k, *seen[v][k][:2]) for v, k in first.items()]
        if not 2 <= len(refs) <= len(cams):
            raise ValueError("number of references")
        out.append({"point": point, "pos": list(pos), "color": list(color), "refs": refs})
    return cams, out


def read_colmap(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, points) of workspaces: the files of `folder`/sparse, text before binary for each part. folder may hold
    wildcards; each workspace is parsed by one task."""
    raw = spark.read.format("binaryFile").load(f"{folder}/sparse").where(F.regexp_extract("path", "/(cameras|images|points3D)\\.(txt|bin)$", 1) != "")
    parts = raw.select(F.regexp_replace("path", "/sparse/[^/]*$", "").alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")

    def table(which: int, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def run(t: pd.DataFrame) -> pd.DataFrame:
            files = dict(zip(t["file"], t["content"], strict=True))
            got = []
            for part, (text, binary) in COLMAP.items():
                if f"{part}.txt" in files:
                    got.append(text(files[f"{part}.txt"]))
                elif f"{part}.bin" in files:
                    got.append(binary(files[f"{part}.bin"]))
                else:
                    raise ValueError(f"no {part} in {t['path'].iloc[0]}")
            return pd.DataFrame([{"path": t["path"].iloc[0]} | r for r in join_colmap(*got)[which]], columns=names)

        return parts.groupBy("path").applyInPandas(run, schema)

    return table(0, CAMERAS), table(1, POINTS)


def parse_colmap_depth(raw: bytes) -> np.ndarray:
    """(height, width, 1) of `width&height&1&` and floats."""
    parts = raw.split(b"&", 3)
    width, height, depth = (int(x) for x in parts[:3])
    if width <= 0 or height <= 0 or depth != 1:
        raise ValueError("depth map size")
    return np.frombuffer(parts[3], "<f4", width * height).reshape(height, width, 1)


def detect_bundle(content: Column) -> Column:
    """nvm, photosynther, bundler, or null, by how a file starts."""
    head = F.decode(F.substring(content, 1, 40), "ISO-8859-1")
    return F.when(head.startswith("NVM_V3"), "nvm").when(head.rlike("^drews 1\\.0\\s*[\\r\\n]"), "photosynther").when(head.rlike("^# Bundle file v0\\.3\\s*[\\r\\n]"), "bundler")


# --- writing ---


def short(x: Column) -> Column:
    """Six significant digits, as a stream prints a number by default."""
    from vantage.functions.geometry import significant

    return significant(x.cast("double"), 6)


def bundle_lines(cameras: DataFrame, points: DataFrame) -> DataFrame:
    """path, part, at, line of photosynther files, for write_lines. Cameras without focal length or with a number that is not
    finite are five lines of zeros; the quality of references is 0; colours are rounded to bytes."""
    bad = lambda c: F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    valid = (F.col("flen") != 0) & ~bad(F.col("rot")) & ~bad(F.col("trans"))
    row = lambda *v: F.concat_ws(" ", *(short(x) for x in v))
    usual = F.concat_ws("\n", row(F.col("flen"), F.col("k1"), F.col("k2")), *(row(*(F.get("rot", F.lit(3 * i + j)) for j in range(3))) for i in range(3)), row(*(F.get("trans", F.lit(j)) for j in range(3))))
    cams = cameras.select("path", F.lit(1).alias("part"), F.col("cam").cast("long").alias("at"), F.when(valid, usual).otherwise(F.lit("\n".join(["0 0 0"] * 5))).alias("line"))
    byte = [F.floor(F.get("color", F.lit(i)) * 255.0 + 0.5).cast("string") for i in range(3)]
    refs = F.transform("refs", lambda r: F.concat(F.lit(" "), r["view"].cast("string"), F.lit(" "), r["feature"].cast("string"), F.lit(" 0")))
    line = F.concat_ws("\n", row(*(F.get("pos", F.lit(i)) for i in range(3))), F.concat_ws(" ", *byte), F.concat(F.size("refs").cast("string"), F.array_join(refs, "")))
    feats = points.select("path", F.lit(2), F.col("point").cast("long"), line)
    n = cameras.groupBy("path").agg(F.count(F.lit(1)).alias("c")).join(points.groupBy("path").agg(F.count(F.lit(1)).alias("p")), "path", "left")
    head = n.select("path", F.lit(0), F.lit(0).cast("long"), F.concat(F.lit("drews 1.0\n"), F.col("c").cast("string"), F.lit(" "), F.coalesce("p", F.lit(0)).cast("string")))
    return head.toDF("path", "part", "at", "line").union(cams).union(feats)


# --- bundles as tables ---


def contains_view(refs: Column, view: Column) -> Column:
    return F.exists(refs, lambda r: r["view"] == view)


def delete_camera(cameras: DataFrame, points: DataFrame, cam: int) -> tuple[DataFrame, DataFrame]:
    """The camera without focal length, and its references gone; points that lose their last one stay."""
    return cameras.withColumn("flen", F.when(F.col("cam") == cam, F.lit(0.0).cast("float")).otherwise(F.col("flen"))), points.withColumn("refs", F.filter("refs", lambda r: r["view"] != cam))


def bundle_vertices(points: DataFrame) -> DataFrame:
    """path, vid, x, y, z, r, g, b: the points as coloured vertices."""
    return points.select("path", F.col("point").alias("vid"), *(F.get("pos", F.lit(i)).alias(c) for i, c in enumerate("xyz")), *(F.get("color", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


def bundle_bytes(cameras: DataFrame, points: DataFrame) -> DataFrame:
    """path, bytes: the size of the numbers of each bundle's cameras, points and references."""
    own = cameras.groupBy("path").agg((F.count(F.lit(1)) * 4 * (3 + 3 + 9 + 3)).alias("c"))
    return own.join(points.groupBy("path").agg(F.sum(24 + F.size("refs") * 16).alias("p")), "path", "left").select("path", (F.col("c") + F.coalesce("p", F.lit(0))).alias("bytes"))
