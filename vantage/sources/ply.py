"""PLY files (ASCII, little and big endian): meshes, oriented samples and depth maps on grids. One task parses a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of number types in headers.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Other names of properties.
ALIASES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b", "confidence": "conf"}
FIELDS = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "u", "v", "conf", "value", "scale")
VERTICES = "path string, vid long, " + ", ".join(f"{c} float" for c in FIELDS)
FACES = "path string, fid long, v0 long, v1 long, v2 long"
Element = tuple[str, int, list[tuple]]


def header(raw: bytes) -> tuple[str, list[Element], dict[str, int], int]:
    """(byte order: '', '<' or '>', elements, numbers of obj_info lines, where the data begins)."""
    end = re.search(rb"end_header[^\n]*\n", raw)
    if not raw.startswith(b"ply") or end is None:
        raise ValueError("no PLY file")
    order, elements, info = None, [], {}
    for line in raw[: end.start()].decode("latin-1").splitlines()[1:]:
        t = line.split()
        if not t or t[0] == "comment":
            continue
        if t[0] == "format":
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[t[1]]
        elif t[0] == "element":
            elements.append((t[1], int(t[2]), []))
        elif t[0] == "obj_info" and len(t) == 3 and t[2].isdigit():
            info[t[1]] = int(t[2])
        elif t[0] == "property":
            elements[-1][2].append((t[-1], TYPES[t[2]], TYPES[t[3]]) if t[1] == "list" else (t[-1], TYPES[t[1]]))
    if order is None:
        raise ValueError("no format")
    return order, elements, info, end.end()


def parse(raw: bytes) -> tuple[dict[str, dict[str, np.ndarray | list]], dict[str, int]]:
    """Element -> property -> its values (a list of arrays for list properties)."""
    order, elements, info, at = header(raw)
    words = iter(raw[at:].split()) if order == "" else None
    out: dict = {}
    for name, n, props in elements:
        if order and all(len(p) == 2 for p in props):
            kind = np.dtype([(f"{i}", order + p[1]) for i, p in enumerate(props)])
            table = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize
            out[name] = {p[0]: table[f"{i}"] for i, p in enumerate(props)}
            continue
        values: dict = {p[0]: [] for p in props}
        for _ in range(n):
            for p in props:
                if order:
                    size = 1
                    if len(p) == 3:
                        size = int(np.frombuffer(raw, order + p[1], 1, at)[0])
                        at += np.dtype(p[1]).itemsize
                    got = np.frombuffer(raw, order + p[-1], size, at)
                    at += got.nbytes
                else:
                    size = int(next(words)) if len(p) == 3 else 1
                    got = np.array([float(next(words)) for _ in range(size)]).astype(p[-1])
                values[p[0]].append(got if len(p) == 3 else got[0])
        out[name] = {p[0]: values[p[0]] if len(p) == 3 else np.array(values[p[0]], p[1]) for p in props}
    return out, info


def vertices_of(table: dict[str, np.ndarray]) -> pd.DataFrame:
    """The known properties as floats; bytes of colours from 0 to 1; null columns for what is missing."""
    made = {}
    for name, values in table.items():
        field = ALIASES.get(name, name)
        if field in FIELDS and field not in made:
            v = np.asarray(values)
            made[field] = v / np.float32(255) if field in "rgb" and v.dtype.kind == "u" else v.astype(np.float32)
    n = len(next(iter(table.values()), []))
    return pd.DataFrame({c: made.get(c, np.full(n, np.nan)) for c in FIELDS})


def split_faces(lists: list[np.ndarray]) -> np.ndarray:
    """Triangles stay, quads become (0, 1, 2) and (2, 3, 0); other sizes go."""
    out = []
    for f in lists:
        if len(f) == 3:
            out.append(f)
        elif len(f) == 4:
            out += [f[:3], f[[2, 3, 0]]]
    return np.array(out, np.int64).reshape(-1, 3)


def split_strips(strip: np.ndarray) -> np.ndarray:
    """Triangles of strips divided by -1; every second one turns around."""
    out, run = [], []
    for v in strip.tolist():
        run = [] if v < 0 else [*run, v]
        if len(run) >= 3:
            a, b, c = run[-3:]
            out.append((a, b, c) if len(run) % 2 else (b, a, c))
    return np.array(out, np.int64).reshape(-1, 3)


def thin(a: np.ndarray, b: np.ndarray, c: np.ndarray, degrees: float = 15.0) -> bool:
    """Whether a triangle's smallest angle is under so many degrees."""
    e = [b - a, c - b, a - c]
    e = [x / np.linalg.norm(x) for x in e]
    return min(np.arccos(np.clip(-e[i] @ e[(i + 1) % 3], -1, 1)) for i in range(3)) < np.radians(degrees)


def triangulate_grid(cells: list[np.ndarray], rows: int, columns: int, pos: np.ndarray) -> np.ndarray:
    """Triangles of 2 by 2 cells with three vertices and more, none of them thin; of four the shorter diagonal divides."""
    grid = np.array([int(c[0]) if len(c) else -1 for c in cells]).reshape(rows, columns)
    out = []
    for y in range(rows - 1):
        for x in range(columns - 1):
            a, b, c, d = grid[y, x], grid[y, x + 1], grid[y + 1, x], grid[y + 1, x + 1]
            have = [v for v in (a, b, c, d) if v >= 0]
            if len(have) == 4:
                short = np.linalg.norm(pos[a] - pos[d]) < np.linalg.norm(pos[b] - pos[c])
                made = [(a, c, d), (a, d, b)] if short else [(a, c, b), (c, d, b)]
            elif len(have) == 3:
                made = [tuple(v for v in (a, c, d, b) if v >= 0)]
            else:
                continue
            out += [t for t in made if not thin(*pos[list(t)])]
    return np.array(out, np.int64).reshape(-1, 3)


def faces_of(table: dict, info: dict[str, int]) -> np.ndarray:
    out = [split_faces(next(v for v in table["face"].values() if isinstance(v, list)))] if "face" in table and len(table["face"]) else []
    if "tristrips" in table:
        out += [split_strips(s) for s in next(iter(table["tristrips"].values()))]
    if "range_grid" in table:
        pos = np.column_stack([table["vertex"][c] for c in "xyz"]).astype(float)
        out.append(triangulate_grid(next(iter(table["range_grid"].values())), info["num_rows"], info["num_cols"], pos))
    return np.concatenate([np.empty((0, 3), np.int64), *out])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (path, vid, x, y, z, nx, ny, nz, r, g, b, u, v, conf, value, scale; NaN where the file has none) and faces
    (path, fid, v0, v1, v2)."""

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                v = vertices_of(parse(content)[0].get("vertex", {}))
                v.insert(0, "vid", np.arange(len(v)))
                v.insert(0, "path", name)
                yield v

    def faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                f = faces_of(*parse(content))
                yield pd.DataFrame({"path": name, "fid": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]})

    return _raw(spark, path).mapInPandas(vertices, VERTICES), _raw(spark, path).mapInPandas(faces, FACES)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, vid, position, normal, scale (the file's value), conf (1 if missing), r, g, b of oriented samples; a file without
    normals or values raises an error."""
    v, _ = read_ply(spark, path)
    need = F.assert_true(~F.isnan("nx") & ~F.isnan("value"), "samples need normals and values")
    return v.withColumn("ok", need).select("path", "vid", "x", "y", "z", "nx", "ny", "nz", F.coalesce(F.col("value"), F.col("ok").cast("float")).alias("scale"), F.nanvl("conf", F.lit(1.0).cast("float")).alias("conf"), "r", "g", "b")


def process_samples(samples: DataFrame, factor: float = 1.0, least: float = 0.0, most: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """(samples kept, path and how many rows went for each reason): scales not above 0, conf not above 0, zero normals and
    scales beyond `most` go, in this order; smaller scales rise to `least`; scales are multiplied and normals normalised."""
    length = F.sqrt(sum(F.col(c).cast("double") * F.col(c) for c in ("nx", "ny", "nz")))
    why = F.when(F.col("scale") <= 0, "scale").when(F.col("conf") <= 0, "conf").when(length == 0, "normal").when(F.col("scale") > most, "large")
    told = samples.withColumn("why", why).withColumn("len", length)
    kept = told.where("why is null").withColumn("scale", (F.greatest(F.col("scale"), F.lit(least)) * factor).cast("float"))
    for c in ("nx", "ny", "nz"):
        kept = kept.withColumn(c, (F.col(c) / F.col("len")).cast("float"))
    counts = told.groupBy("path").agg(*(F.count_if(F.coalesce(F.col("why") == k, F.lit(False))).alias(k) for k in ("scale", "conf", "normal", "large")))
    return kept.drop("why", "len"), counts


def read_depthmap(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, data (packed floats, row by row): for each grid cell the depth -z of its vertex, 0 where empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                table, info = parse(content)
                z = np.asarray(table["vertex"]["z"], np.float32)
                depth = np.array([-z[int(c[0])] if len(c) else 0 for c in next(iter(table["range_grid"].values()))], np.float32)
                yield pd.DataFrame([(name, info["num_cols"], info["num_rows"], depth.tobytes())], columns=["path", "width", "height", "data"])

    return _raw(spark, path).mapInPandas(run, "path string, width int, height int, data binary")


# --- writing ---


def encode_mesh(v: pd.DataFrame, f: np.ndarray, binary: bool = True, fields: tuple[str, ...] = ("normals", "colors", "conf", "value")) -> bytes:
    """The file of a mesh: optional properties where all vertices have them."""
    v = v.reset_index(drop=True)
    has = lambda *c: all(k in v and not v[k].isna().any() for k in c) and len(v) > 0
    kind = [(c, "<f4", "float " + c) for c in "xyz"]
    if "normals" in fields and has("nx", "ny", "nz"):
        kind += [(c, "<f4", "float " + c) for c in ("nx", "ny", "nz")]
    if "colors" in fields and has("r", "g", "b"):
        kind += [(c, "u1", "uchar " + name) for c, name in zip("rgb", ("red", "green", "blue"), strict=True)]
    kind += [(c, "<f4", "float " + name) for c, name in (("conf", "confidence"), ("value", "value")) if c in fields and has(c)]
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {len(v)}", *(f"property {k[2]}" for k in kind)]
    if len(f):
        head += [f"element face {len(f)}", "property list uchar int vertex_indices"]
    rows = np.empty(len(v), [(c, t) for c, t, _ in kind])
    for c, t, _ in kind:
        rows[c] = np.clip(np.floor(v[c].to_numpy(float) * 255 + 0.5), 0, 255) if t == "u1" else v[c]
    out = ("\n".join([*head, "end_header"]) + "\n").encode()
    if binary:
        sides = np.empty(len(f), [("n", "u1"), ("v", "<i4", 3)])
        sides["n"], sides["v"] = 3, f
        return out + rows.tobytes() + sides.tobytes()
    lines = [" ".join(str(int(x)) if t == "u1" else np.format_float_positional(np.float32(x), trim="-") for x, (_, t, _) in zip(r, kind, strict=True)) for r in rows.tolist()]
    return out + "".join(x + "\n" for x in [*lines, *(f"3 {a} {b} {c}" for a, b, c in np.asarray(f).tolist())]).encode()


def encode_ply(vertices: DataFrame, faces: DataFrame, binary: bool = True) -> DataFrame:
    """path, content: the file of each path's mesh. One task puts a mesh together; writers.write_files writes it."""

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("vid"), f.sort_values("fid")
        return pd.DataFrame({"path": [key[0]], "content": [encode_mesh(v, f[["v0", "v1", "v2"]].to_numpy(np.int64), binary)]})

    return vertices.groupBy("path").cogroup(faces.groupBy("path")).applyInPandas(run, "path string, content binary")


def mesh_properties(c: Column) -> Column:
    """The header lines of a PLY file's vertex properties, for looking at files without their data."""
    head = F.regexp_extract(F.decode(F.substring(c, 1, 4096), "ISO-8859-1"), "(?s)^(ply.*?)end_header", 1)
    return F.filter(F.split(head, "\\r?\\n"), lambda x: x.startswith("property"))
