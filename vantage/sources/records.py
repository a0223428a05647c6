"""Further formats: pixel files (PNG, TIFF, headers of JPEG, camera settings in them), meshes (OBJ with materials, oriented
points, binary glTF, PBRT), matches, survey points, keypoints and alignments. Decoders take a file's bytes and raise
ValueError for malformed ones; `rows_of_files` applies one to every file of a path, a task for each file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundles import quaternion_matrix

#: First lines of match and survey files.
MATCHES_MARK = b"MVE_PREBUNDLE\n"
SURVEY_MARK = b"MVE_SURVEY\n"
MAX_KEYPOINTS = 100_000


def rows_of_files(spark: SparkSession, path: str, decode: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """path and the rows that decode gives for each file. schema: of the rows, without path."""
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                rows = decode(raw)
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame([{"path": name} | r for r in rows[at : at + 10_000]], columns=["path", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


# --- pixels ---

PNG_MARK = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not raw.startswith(PNG_MARK):
        raise ValueError("no PNG file")
    at = 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        yield kind, raw[at + 8 : at + 8 + size]
        at += size + 12


def png_header(raw: bytes) -> tuple[int, int, int]:
    """(width, height, channels); a palette counts as three."""
    kind, data = next(png_chunks(raw))
    width, height, depth, color = struct.unpack_from(">IIBB", data)
    if kind != b"IHDR" or depth > 16:
        raise ValueError("PNG header")
    return width, height, PNG_CHANNELS.get(color, 3)


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, channels) of bytes; 16 bits are cut to 8, fewer than 8 are spread, palettes are looked up. Interlaced
    files raise an error."""
    data, palette, head = [], None, None
    for kind, chunk in png_chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(chunk)
    if head is None or head[6]:
        raise ValueError("PNG without header, or interlaced")
    width, height, depth, color = head[:4]
    n = 1 if color == 3 else PNG_CHANNELS[color]
    step, line = max(1, n * depth // 8), -(-width * n * depth // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)[: height * (line + 1)].reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.int64)
    for y in range(height):
        kind, row = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            row = (row + above) & 255
        elif kind:
            for x in range(line):
                a, b = (row[x - step] if x >= step else 0), above[x]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[x - step] if x >= step else 0
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[x] = (row[x] + guess) & 255
        out[y] = above = row
    if depth == 16:
        v = out.reshape(height, width, n, 2)[..., 0]
    elif depth == 8:
        v = out.reshape(height, width, n)
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, : width * n]
        v = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(height, width, n)
        v = v if color == 3 else v * (255 // ((1 << depth) - 1))
    return palette[v[..., 0]] if color == 3 else v


def encode_png(v: np.ndarray) -> bytes:
    """Of one to four channels of bytes."""
    height, width, n = v.shape
    color = {c: k for k, c in PNG_CHANNELS.items()}[n]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), v.reshape(height, width * n)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def jpeg_header(raw: bytes) -> tuple[int, int, int]:
    """(width, height, channels) by the frame's segment."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at = 2
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            raise ValueError("JPEG segment")
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, n = struct.unpack_from(">HHB", raw, at + 5)
            return width, height, n
        at += 2 + size
    raise ValueError("JPEG without a frame")


TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


def directory(raw: bytes, base: int, at: int, order: str) -> dict[int, tuple]:
    """Tag -> values of one directory of a TIFF structure that starts at base. Values out of range raise an error."""
    out = {}
    (n,) = struct.unpack_from(order + "H", raw, base + at)
    for i in range(n):
        spot = base + at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", raw, spot)
        if kind not in TIFF_TYPES:
            continue
        one = TIFF_TYPES[kind]
        size = count * struct.calcsize(order + one)
        where = spot + 8 if size <= 4 else base + struct.unpack_from(order + "I", raw, spot + 8)[0]
        if where + size > len(raw):
            raise ValueError("a value lies outside the file")
        out[tag] = (raw[where : where + count].split(b"\0")[0].decode("latin-1"),) if one == "s" else struct.unpack_from(order + one * count, raw, where)
    return out


def _order(raw: bytes, at: int) -> str:
    order = {b"II": "<", b"MM": ">"}.get(raw[at : at + 2])
    if order is None or struct.unpack_from(order + "H", raw, at + 2)[0] != 42:
        raise ValueError("byte order")
    return order


def tiff_header(raw: bytes) -> dict:
    """width, height, channels, type."""
    order = _order(raw, 0)
    d = directory(raw, 0, struct.unpack_from(order + "I", raw, 4)[0], order)
    bits, form = d.get(258, (1,))[0], d.get(339, (1,))[0]
    kind = {(8, 1): "uint8", (16, 1): "uint16", (32, 1): "uint32", (32, 3): "float32", (64, 3): "float64", (8, 2): "int8", (16, 2): "int16", (32, 2): "int32"}.get((bits, form))
    if kind is None:
        raise ValueError("TIFF sample format")
    return {"width": d[256][0], "height": d[257][0], "channels": d.get(277, (1,))[0], "type": kind, "d": d, "order": order}


def decode_tiff(raw: bytes) -> np.ndarray:
    """(height, width, channels) of strips without compression or deflated."""
    h = tiff_header(raw)
    d = h["d"]
    packing = d.get(259, (1,))[0]
    if packing not in (1, 8, 32946) or d.get(284, (1,))[0] != 1 or 273 not in d:
        raise ValueError("TIFF layout")
    parts = [raw[a : a + n] for a, n in zip(d[273], d[279], strict=True)]
    data = b"".join(zlib.decompress(p) if packing != 1 else p for p in parts)
    kind = np.dtype(h["type"]).newbyteorder(h["order"])
    return np.frombuffer(data, kind, h["width"] * h["height"] * h["channels"]).reshape(h["height"], h["width"], h["channels"]).astype(h["type"])


def encode_tiff(v: np.ndarray) -> bytes:
    """One strip of bytes, 16-bit values or floats."""
    height, width, n = v.shape
    data = np.ascontiguousarray(v, v.dtype.newbyteorder("<")).tobytes()
    bits, form = 8 * v.dtype.itemsize, 3 if v.dtype.kind == "f" else 1
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * n), (259, 3, [1]), (262, 3, [2 if n >= 3 else 1]), (273, 4, [8]), (277, 3, [n]), (278, 4, [height]), (279, 4, [len(data)]), (284, 3, [1]), (339, 3, [form] * n)]
    start = 8 + len(data) + len(data) % 2
    extra, table, at = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack("<" + TIFF_TYPES[kind] * len(values), *values)
        if len(packed) > 4:
            place, extra = struct.pack("<I", at + len(extra)), extra + packed
        else:
            place = packed.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II" + struct.pack("<HI", 42, start) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + table + struct.pack("<I", 0) + extra


#: Tags of camera settings, in the first directory and in the one of the exposure.
EXIF_FIRST = {0x10E: "description", 0x10F: "maker", 0x110: "model", 0x112: "orientation", 0x131: "software", 0x132: "modified", 0x102: "bits", 0x8298: "copyright", 0x13B: "artist"}
EXIF_SECOND = {0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso_speed", 0x9003: "taken", 0x9201: "shutter_speed", 0x9204: "exposure_bias", 0x920A: "focal_length", 0x9209: "flash", 0x9206: "subject_distance", 0xA405: "focal_length_35mm", 0xA002: "width", 0xA003: "height", 0x9207: "metering_mode"}


def exif(raw: bytes, is_jpeg: bool = True) -> dict:
    """Camera settings of a JPEG file, or of its settings segment alone; fractions are numbers."""
    at = 0
    if is_jpeg:
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        at = raw.find(b"\xff\xe1") + 4
        if at < 4:
            raise ValueError("no settings")
    if raw[at : at + 6] != b"Exif\0\0":
        raise ValueError("no settings")
    base = at + 6
    order = _order(raw, base)
    first = directory(raw, base, struct.unpack_from(order + "I", raw, base + 4)[0], order)
    second = directory(raw, base, first[0x8769][0], order) if 0x8769 in first else {}
    plain = lambda v: v[0] / v[1] if len(v) == 2 and v[1] else 0.0 if len(v) == 2 else v[0]
    return {name: plain(d[tag]) for d, names in ((first, EXIF_FIRST), (second, EXIF_SECOND)) for tag, name in names.items() if tag in d and d[tag]}


DECODERS = (decode_png, decode_tiff)


def decode_any(raw: bytes, decoders: tuple[Callable[[bytes], np.ndarray], ...]) -> np.ndarray:
    """By the first decoder that takes the file."""
    for decode in decoders:
        try:
            return decode(raw)
        except (ValueError, KeyError, struct.error, zlib.error):
            continue
    raise ValueError("unknown image format")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, type, data of PNG, TIFF, PPM, PGM, PFM and native files, by what they hold."""
    from .images import decode
    from .scenes import decode_native

    def rows(raw: bytes) -> list[dict]:
        v = decode_any(raw, (*DECODERS, decode, decode_native))
        return [{"width": v.shape[1], "height": v.shape[0], "channels": v.shape[2], "type": v.dtype.name, "data": np.ascontiguousarray(v).tobytes()}]

    return rows_of_files(spark, path, rows, "width int, height int, channels int, type string, data binary")


# --- meshes ---


def decode_points(raw: bytes, binary: bool) -> list[dict]:
    """Oriented points: six numbers each, as text or floats; an incomplete last one goes."""
    v = np.frombuffer(raw, "<f4", len(raw) // 24 * 6) if binary else np.array(raw.split(), float)
    v = v[: len(v) // 6 * 6].reshape(-1, 6).astype(float)
    return [dict(zip(("vid", "x", "y", "z", "nx", "ny", "nz"), (i, *r), strict=True)) for i, r in enumerate(v.tolist())]


def read_points(spark: SparkSession, path: str, binary: bool) -> DataFrame:
    return rows_of_files(spark, path, lambda raw: decode_points(raw, binary), "vid long, x float, y float, z float, nx float, ny float, nz float")


def encode_points(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<f4").tobytes()


def decode_materials(raw: bytes, folder: str = "") -> dict[str, str]:
    """Material -> its diffuse map's path."""
    out, name = {}, None
    for line in raw.decode().splitlines():
        t = line.split()
        if not t or t[0].startswith("#"):
            continue
        if t[0] == "newmtl":
            if len(t) != 2:
                raise ValueError("material")
            name = t[1]
        elif t[0] == "map_Kd":
            if len(t) != 2 or name is None:
                raise ValueError("diffuse map")
            out.setdefault(name, t[1] if t[1].startswith("/") or not folder else f"{folder}/{t[1]}")
            name = None
    return out


def decode_obj(raw: bytes) -> list[dict]:
    """Parts by material in their order of appearance: name, vertices (x, y, z, u, v, nx, ny, nz; NaN where missing) and
    faces. Equal (position, texture, normal) triples are one vertex of a part; faces of more corners become fans."""
    pos, tex, nrm, parts = [], [], [], {}
    part = None
    for line in raw.decode().splitlines():
        t = line.split()
        if not t or t[0].startswith("#"):
            continue
        if t[0] == "v":
            pos.append([float(x) for x in t[1:4]])
        elif t[0] == "vt":
            tex.append([float(t[1]), 1 - float(t[2])])
        elif t[0] == "vn":
            nrm.append([float(x) for x in t[1:4]])
        elif t[0] == "usemtl":
            part = parts.setdefault(t[1], {"name": t[1], "ids": {}, "faces": []})
        elif t[0] == "f":
            part = part if part is not None else parts.setdefault("", {"name": "", "ids": {}, "faces": []})
            corners = []
            for word in t[1:]:
                k = [int(x) if x else 0 for x in (word.split("/") + ["", ""])[:3]]
                key = tuple(n + x if x < 0 else x - 1 for x, n in zip(k, (len(pos), len(tex), len(nrm)), strict=True))
                if not 0 <= key[0] < len(pos):
                    raise ValueError("vertex index")
                corners.append(part["ids"].setdefault(key, len(part["ids"])))
            part["faces"] += [(corners[0], b, c) for b, c in zip(corners[1:], corners[2:], strict=False)]
    nan = float("nan")
    at = lambda values, i, n: values[i] if 0 <= i < len(values) else [nan] * n
    return [{"name": p["name"], "vertices": [[*pos[a], *at(tex, b, 2), *at(nrm, c, 3)] for a, b, c in p["ids"]], "faces": p["faces"]} for p in parts.values()]


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (path, part, vid, x, y, z, u, v, nx, ny, nz) and faces (path, part, fid, v0, v1, v2)."""
    names = ("x", "y", "z", "u", "v", "nx", "ny", "nz")
    vertices = lambda raw: [{"part": p["name"], "vid": i} | dict(zip(names, r, strict=True)) for p in decode_obj(raw) for i, r in enumerate(p["vertices"])]
    faces = lambda raw: [{"part": p["name"], "fid": i, "v0": f[0], "v1": f[1], "v2": f[2]} for p in decode_obj(raw) for i, f in enumerate(p["faces"])]
    return rows_of_files(spark, path, vertices, "part string, vid long, " + ", ".join(f"{c} float" for c in names)), rows_of_files(spark, path, faces, "part string, fid long, v0 long, v1 long, v2 long")


def encode_glb(v: np.ndarray, f: np.ndarray, colors: np.ndarray | None = None) -> bytes:
    """Binary glTF 2.0 of positions (n, 3), faces (m, 3) and colours (n, 3) from 0 to 1."""
    blobs = [np.ascontiguousarray(v, "<f4").tobytes(), np.ascontiguousarray(f, "<u4").tobytes()]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3", "min": np.min(v, 0).tolist() if len(v) else [0, 0, 0], "max": np.max(v, 0).tolist() if len(v) else [0, 0, 0]}, {"bufferView": 1, "componentType": 5125, "count": int(np.size(f)), "type": "SCALAR"}]
    attributes = {"POSITION": 0}
    if colors is not None:
        blobs.append(np.ascontiguousarray(colors, "<f4").tobytes())
        accessors.append({"bufferView": 2, "componentType": 5126, "count": len(colors), "type": "VEC3"})
        attributes["COLOR_0"] = 2
    views, at = [], 0
    for i, b in enumerate(blobs):
        views.append({"buffer": 0, "byteOffset": at, "byteLength": len(b), "target": 34963 if i == 1 else 34962})
        at += len(b)
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": attributes, "indices": 1, "mode": 4}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": at}]}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = b"".join(blobs)
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def pbrt_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """path, part, at, line of a triangle mesh for the renderer's scene files, for writers.write_lines."""
    head = vertices.select("path").distinct()
    fixed = lambda part, text: head.select("path", F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(text).alias("line"))
    v = vertices.select("path", F.lit(3), F.col("vid").cast("long"), F.concat_ws(" ", *(F.col(c).cast("float").cast("string") for c in "xyz")))
    f = faces.select("path", F.lit(1), F.col("fid").cast("long"), F.concat_ws(" ", "v0", "v1", "v2"))
    return fixed(0, 'Shape "trianglemesh"\n"integer indices" [').union(f).union(fixed(2, ']\n"point P" [')).union(v).union(fixed(4, "]"))


# --- matches, survey points, keypoints, alignments ---


def decode_matches(raw: bytes) -> tuple[list[dict], list[dict]]:
    """(features: view, feature, x, y, r, g, b; matches: view1, view2, feature1, feature2)."""
    if not raw.startswith(MATCHES_MARK):
        raise ValueError("no match file")
    at = len(MATCHES_MARK)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    features, matches = [], []
    try:
        for view in range(int(take("<i4", 1)[0])):
            pos = take("<f4", 2 * int(take("<i4", 1)[0])).reshape(-1, 2).tolist()
            rgb = take("u1", 3 * int(take("<i4", 1)[0])).reshape(-1, 3).tolist()
            rgb += [[0, 0, 0]] * (len(pos) - len(rgb))
            features += [{"view": view, "feature": i, "x": p[0], "y": p[1], "r": c[0], "g": c[1], "b": c[2]} for i, (p, c) in enumerate(zip(pos, rgb, strict=False))]
        for _ in range(int(take("<i4", 1)[0])):
            a, b, n = (int(x) for x in take("<i4", 3))
            matches += [{"view1": a, "view2": b, "feature1": i, "feature2": j} for i, j in take("<i4", 2 * n).reshape(-1, 2).tolist()]
    except (ValueError, IndexError):
        raise ValueError("the file ends early") from None
    return features, matches


def encode_matches(features: pd.DataFrame, matches: pd.DataFrame, views: int) -> bytes:
    out = [MATCHES_MARK, struct.pack("<i", views)]
    for view in range(views):
        own = features[features["view"] == view].sort_values("feature")
        n = struct.pack("<i", len(own))
        out += [n, own[["x", "y"]].to_numpy("<f4").tobytes(), n, own[["r", "g", "b"]].to_numpy(np.uint8).tobytes()]
    pairs = matches.groupby(["view1", "view2"], sort=True)
    out.append(struct.pack("<i", pairs.ngroups))
    for (a, b), own in pairs:
        out += [struct.pack("<3i", a, b, len(own)), own[["feature1", "feature2"]].to_numpy("<i4").tobytes()]
    return b"".join(out)


def read_matches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return rows_of_files(spark, path, lambda raw: decode_matches(raw)[0], "view int, feature int, x float, y float, r int, g int, b int"), rows_of_files(spark, path, lambda raw: decode_matches(raw)[1], "view1 int, view2 int, feature1 int, feature2 int")


def decode_survey(raw: bytes) -> list[dict]:
    """point, x, y, z, observations (view, x, y)."""
    if not raw.startswith(SURVEY_MARK):
        raise ValueError("no survey file")
    v = [float(x) for x in raw[len(SURVEY_MARK) :].split()]
    n, m = int(v[0]), int(v[1])
    if len(v) < 2 + 3 * n + 4 * m:
        raise ValueError("the file ends early")
    out = [{"point": i, "x": v[2 + 3 * i], "y": v[3 + 3 * i], "z": v[4 + 3 * i], "observations": []} for i in range(n)]
    for k in range(m):
        point, view, x, y = v[2 + 3 * n + 4 * k : 6 + 3 * n + 4 * k]
        if not 0 <= point < n:
            raise ValueError("survey point")
        out[int(point)]["observations"].append((int(view), x, y))
    return out


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    return rows_of_files(spark, path, decode_survey, "point int, x float, y float, z float, observations array<struct<view:int,x:float,y:float>>")


def decode_keypoints(raw: bytes) -> list[dict]:
    """feature, x, y, scale, orientation and a descriptor of length 1, of text files of 128 numbers each."""
    v = raw.split()
    n, size = int(v[0]), int(v[1])
    if n > MAX_KEYPOINTS or size != 128 or len(v) < 2 + n * 132:
        raise ValueError("keypoints")
    rows = np.array(v[2 : 2 + n * 132], float).reshape(n, 132)
    length = np.linalg.norm(rows[:, 4:], axis=1, keepdims=True)
    d = np.divide(rows[:, 4:], length, out=np.zeros((n, 128)), where=length > 0)
    return [{"feature": i, "x": r[1], "y": r[0], "scale": r[2], "orientation": r[3], "descriptor": d[i].tolist()} for i, r in enumerate(rows.tolist())]


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    return rows_of_files(spark, path, decode_keypoints, "feature int, x float, y float, scale float, orientation float, descriptor array<float>")


def decode_alignment(raw: bytes) -> list[dict]:
    """scan, file, rot (9), trans (3), camera (3), direction (3): projects with a matrix for each scan, or configurations of
    `bmesh` lines with translation and quaternion behind a `camera` line."""
    lines = [x for x in raw.decode().splitlines() if x.strip() and not x.lstrip().startswith("#")]
    out: list[dict] = []
    if lines and lines[0].strip().isdigit():
        at = 1
        for i in range(int(lines[0])):
            m = np.array([[float(x) for x in lines[at + 1 + r].split()[:4]] for r in range(3)])
            out.append({"scan": i, "file": lines[at].strip(), "rot": m[:, :3].ravel().tolist(), "trans": m[:, 3].tolist(), "camera": m[:, 3].tolist(), "direction": (m[:, :3] @ [0, 0, -1]).tolist()})
            at += 5
        return out
    place, turn = np.zeros(3), np.eye(3)
    for t in (x.split() for x in lines):
        if t[0] == "camera" and len(t) == 8:
            place, turn = np.array(t[1:4], float), quaternion_matrix([float(x) for x in t[4:8]]).T
        elif t[0] == "bmesh" and len(t) == 9:
            rot, trans = quaternion_matrix([float(t[8]), *(float(x) for x in t[5:8])]), np.array(t[2:5], float)
            out.append({"scan": len(out), "file": t[1], "rot": rot.ravel().tolist(), "trans": trans.tolist(), "camera": (rot.T @ turn @ place + trans).tolist(), "direction": (rot.T @ turn @ [0, 0, 1]).tolist()})
    return out


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    return rows_of_files(spark, path, decode_alignment, "scan int, file string, rot array<double>, trans array<double>, camera array<double>, direction array<double>")


def directory_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes of the files of a folder, by name only."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    return f.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))


def correspondence_lines(views: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of pixel correspondences: (x, y) of every vertex, views in the order of their ids and pixels by vertex;
    and view_id, width, height, first_vertex_index. Offsets are sums over views, a row each."""
    from pyspark.sql import Window as W

    n = pixels.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"))
    v = views.join(n, "view_id", "left").fillna(0, ["n"])
    first = F.coalesce(F.sum("n").over(W.orderBy("view_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = v.select("view_id", "width", "height", first.cast("long").alias("first_vertex_index"))
    place = F.row_number().over(W.partitionBy("view_id").orderBy("vertex")) - 1
    own = pixels.withColumn("r", place).join(F.broadcast(v), "view_id")
    return own.select((F.col("first_vertex_index") + F.col("r")).alias("at"), "x", "y"), v
