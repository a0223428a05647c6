"""Whole files: writing contents under their names, choosing a format by a name, and bringing pictures into a scene."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import images as I

from . import images, ply, records, scenes


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """Write rows (file, content) below folder and give file, bytes of what was written. file may hold folders.

    Tasks write to the store that the folder's address names, each file under another name first and then renamed, so a
    task that is run again replaces whole files and readers never see half of one. The result must be acted on: nothing is
    written before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            done = []
            for name, content in zip(b["file"], b["content"], strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                new = f"{path}.{uuid.uuid4().hex}.new"
                with store.open_output_stream(new) as out:
                    out.write(bytes(content))
                store.move(new, path)
                done.append((name, len(content)))
            yield pd.DataFrame(done, columns=["file", "bytes"])

    return contents.select("file", "content").mapInPandas(run, "file string, bytes long")


def suffix(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def encode_image(v: np.ndarray, name: str) -> bytes:
    """By the name's ending: png, tif or tiff, ppm or pgm or pfm, or the native format."""
    kinds: dict[str, Callable[[np.ndarray], bytes]] = {"png": records.encode_png, "tif": records.encode_tiff, "tiff": records.encode_tiff, "ppm": images.encode, "pgm": images.encode, "pfm": images.encode, "mvei": scenes.encode_native}
    if suffix(name) not in kinds:
        raise ValueError(f"no image format for {name}")
    return kinds[suffix(name)](v)


def lossless_name(v: np.ndarray, name: str) -> str:
    """name with the ending of a format that keeps the image: png for one to four channels of bytes, else the native one."""
    return f"{name}.png" if v.dtype == np.uint8 and 1 <= v.shape[2] <= 4 else f"{name}.mvei"


def image_files(rows: DataFrame) -> DataFrame:
    """rows (file, and an image's columns) -> file, content; a name without an ending gets that of a lossless format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                v = I.array_of(r)
                name = r["file"] if suffix(r["file"].rsplit("/", 1)[-1]) else lossless_name(v, r["file"])
                yield pd.DataFrame({"file": [name], "content": [encode_image(v, name)]})

    return rows.select("file", *I.FIELDS).where(F.col("data").isNotNull()).mapInPandas(run, "file string, content binary")


def mesh_format(name: Column) -> Column:
    """How a mesh file's name is read: off, ply, points, binary points, smf or obj; null for others."""
    kinds = {"off": "off", "ply": "ply", "npts": "points", "bnpts": "binary points", "smf": "smf", "obj": "obj"}
    return F.element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.lower(F.regexp_extract(name, "\\.([^./]*)$", 1)))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(vertices, faces) of files of one format, told by the path's ending."""
    from . import text

    kind = suffix(path)
    if kind in ("npts", "bnpts"):
        return records.read_points(spark, path, kind == "bnpts"), None
    readers = {"off": text.read_off, "smf": text.read_smf, "ply": ply.read_ply, "obj": records.read_obj}
    if kind not in readers:
        raise ValueError(f"no mesh format for {path}")
    return readers[kind](spark, path)


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """path, at, file: the first word of every line of lists of pictures."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\\r?\\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("path", "at", F.regexp_extract("line", "^\\s*(\\S+)", 1).alias("file"))


def import_images(spark: SparkSession, path: str, scene: str, views: DataFrame, max_pixels: int = 2**62, thumbnail: int = 50) -> DataFrame:
    """Files for write_files of pictures that become views of a scene, numbered on behind its views by file name: for each
    the settings, the picture (halved to max_pixels at most) and a small square one. Unreadable files go."""
    found = spark.read.format("binaryFile").load(path).select(F.lit(scene).alias("scene"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")

    def readable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                try:
                    v = I.limit_size(records.decode_any(r["content"], (*records.DECODERS, images.decode, scenes.decode_native)), max_pixels)
                except ValueError:
                    continue
                yield pd.DataFrame([{"scene": r["scene"], "file": r["file"]} | I.fields_of(v)])

    good = found.mapInPandas(readable, "scene string, file string, width int, height int, channels int, type string, data binary")
    numbered = scenes.new_views(views, good)

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                v = I.array_of(r)
                small = I.create_thumbnail(v, min(thumbnail, v.shape[1]), min(thumbnail, v.shape[0]))
                at, name = f"views/{r['folder']}", r["file"].rsplit(".", 1)[0]
                meta = f"[view]\nid = {r['id']}\nname = {name}\n"
                named = {lossless_name(v, "original"): v, lossless_name(small, "thumbnail"): small}
                rows = [(f"{at}/meta.ini", meta.encode()), *((f"{at}/{n}", encode_image(x, n)) for n, x in named.items())]
                yield pd.DataFrame(rows, columns=["file", "content"])

    return numbered.mapInPandas(files, "file string, content binary")
