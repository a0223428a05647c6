"""Scene folders: views with settings, images and binary values.

A scene has a folder `views` with a folder `*.mve` for each view, in it `meta.ini`, images and `.blob` files. Only names are
listed until content is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import parse_ini

#: Signatures of image and value files, and number types of image files.
IMAGE_MARK = b"\x89MVE_IMAGE\n"
BLOB_MARK = b"\x89MVE_BLOB\n"
IMAGE_TYPES = {1: "uint8", 2: "uint16", 3: "uint32", 4: "uint64", 5: "int8", 6: "int16", 7: "int32", 8: "int64", 9: "float32", 10: "float64"}
MAX_PIXELS = 1 << 28


def _numbers(s: Column, n: int) -> Column:
    got = F.transform(F.filter(F.split(s, "\\s+"), lambda x: x != ""), lambda x: x.cast("float"))
    return F.when(F.size(got) == n, got)


def views_of(files: DataFrame) -> DataFrame:
    """path, text of meta.ini files -> scene, folder, id, name, the camera's columns and all settings (meta). Of equal ids of a
    scene the first folder by name counts; ids above 5,000 that are also above twice the number of views go."""
    m = files.select("path", parse_ini(F.col("text")).alias("meta"))
    at = lambda k: F.element_at("meta", k)
    one = lambda k, default: F.coalesce(at(k).try_cast("float"), F.lit(default).cast("float"))
    rows = m.select(
        F.regexp_extract("path", "^(.*)/views/[^/]+/meta\\.ini$", 1).alias("scene"), F.regexp_extract("path", "([^/]+)/meta\\.ini$", 1).alias("folder"),
        at("view.id").try_cast("int").alias("id"), at("view.name").alias("name"), one("camera.focal_length", 0.0).alias("flen"), one("camera.pixel_aspect", 1.0).alias("aspect"),
        F.coalesce(_numbers(at("camera.principal_point"), 2), F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>")).alias("pp"),
        F.coalesce(_numbers(at("camera.radial_distortion"), 2), F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")).alias("distortion"),
        F.coalesce(_numbers(at("camera.rotation"), 9), F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).cast("array<float>")).alias("rot"),
        F.coalesce(_numbers(at("camera.translation"), 3), F.array(*(F.lit(0.0),) * 3).cast("array<float>")).alias("trans"), "meta")
    n = F.count(F.lit(1)).over(W.partitionBy("scene"))
    first = F.row_number().over(W.partitionBy("scene", "id").orderBy("folder"))
    return rows.where("id is not null and id >= 0").withColumn("n", n).withColumn("r", first).where("r = 1 and not (id > 5000 and id > 2 * n)").drop("n", "r")


def read_views(spark: SparkSession, scene: str) -> DataFrame:
    """The views of a scene folder, or of several by wildcards."""
    return views_of(spark.read.format("binaryFile").load(f"{scene}/views/*.mve/meta.ini").select("path", F.col("content").cast("string").alias("text")))


def list_values(spark: SparkSession, scene: str) -> DataFrame:
    """scene, folder, file, kind (image or blob), name, bytes: what views hold, by name only. PLY and other files are no
    values."""
    f = spark.read.format("binaryFile").load(f"{scene}/views/*.mve/*").select("path", "length")
    kind = F.when(F.lower("path").rlike("\\.(png|jpg|jpeg|mvei)$"), "image").when(F.lower("path").rlike("\\.blob$"), "blob")
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "\\.[^.]*$", "")
    return f.select(F.regexp_extract("path", "^(.*)/views/", 1).alias("scene"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), kind.alias("kind"), name.alias("name"), F.col("length").alias("bytes")).where("kind is not null")


def scene_bytes(values: DataFrame) -> DataFrame:
    return values.groupBy("scene", "folder").agg(F.sum("bytes").alias("bytes"))


def embedding_names(values: DataFrame, kind: str | None = None) -> DataFrame:
    """scene, name: the distinct names of values, of one kind or all."""
    return (values if kind is None else values.where(F.col("kind") == kind)).select("scene", "name").distinct()


def max_view_id(views: DataFrame) -> DataFrame:
    return views.groupBy("scene").agg(F.max("id").alias("id"))


# --- image and value files ---


def decode_native(raw: bytes) -> np.ndarray:
    """(height, width, channels) of an image file."""
    if not raw.startswith(IMAGE_MARK):
        raise ValueError("no image file")
    width, height, channels, kind = np.frombuffer(raw, "<i4", 4, len(IMAGE_MARK)).tolist()
    if width * height > MAX_PIXELS:
        raise ValueError("image too large")
    return np.frombuffer(raw, np.dtype(IMAGE_TYPES[kind]).newbyteorder("<"), width * height * channels, len(IMAGE_MARK) + 16).reshape(height, width, channels)


def encode_native(v: np.ndarray) -> bytes:
    kind = next(k for k, name in IMAGE_TYPES.items() if name == v.dtype.name)
    return IMAGE_MARK + np.array([v.shape[1], v.shape[0], v.shape[2], kind], "<i4").tobytes() + np.ascontiguousarray(v, v.dtype.newbyteorder("<")).tobytes()


def native_header(content: Column) -> Column:
    """width, height, channels and type of an image file by its first 27 bytes; null for other files."""
    whole = F.hex(F.substring(content, 1, 27))
    at = lambda i: F.conv(F.concat(*(F.substring(whole, 23 + 8 * i + 2 * b, 2) for b in (3, 2, 1, 0))), 16, 10).cast("int")
    kinds = F.create_map(*(F.lit(x) for pair in IMAGE_TYPES.items() for x in pair))
    return F.when(whole.startswith(IMAGE_MARK.hex().upper()), F.struct(at(0).alias("width"), at(1).alias("height"), at(2).alias("channels"), F.element_at(kinds, at(3)).alias("type")))


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, type, data as vantage.sources.images reads other files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v = decode_native(raw)
                yield pd.DataFrame([(name, v.shape[1], v.shape[0], v.shape[2], v.dtype.name, v.tobytes())], columns=["path", "width", "height", "channels", "type", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, channels int, type string, data binary")


def blob_payload(content: Column) -> Column:
    """The value of a blob file; null if its signature or size is wrong."""
    n = len(BLOB_MARK)
    head = F.hex(F.substring(content, 1, n + 8))
    size = F.conv(F.concat(*(F.substring(head, 2 * (n + b) + 1, 2) for b in range(7, -1, -1))), 16, 10).cast("long")
    good = head.startswith(BLOB_MARK.hex().upper()) & (size == F.octet_length(content) - n - 8)
    return F.when(good, F.substring(content, n + 9, 2**31 - 1))


def blob_content(payload: Column) -> Column:
    size = F.lpad(F.hex(F.octet_length(payload).cast("long")), 16, "0")
    little = F.concat(*(F.substring(size, 15 - 2 * b, 2) for b in range(8)))
    return F.concat(F.lit(bytearray(BLOB_MARK)), F.unhex(little), payload)


# --- writing ---


def meta_text(views: DataFrame) -> DataFrame:
    """scene, folder, file, content: the meta.ini of each view from its columns; other settings of meta stay."""
    from .writers import write_ini

    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    own = F.create_map(F.lit("view.id"), F.col("id").cast("string"), F.lit("view.name"), F.coalesce("name", F.lit("")), F.lit("camera.focal_length"), F.col("flen").cast("string"), F.lit("camera.pixel_aspect"), F.col("aspect").cast("string"), F.lit("camera.principal_point"), text("pp"), F.lit("camera.radial_distortion"), text("distortion"), F.lit("camera.rotation"), text("rot"), F.lit("camera.translation"), text("trans"))
    rest = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return views.select("scene", "folder", F.lit("meta.ini").alias("file"), write_ini(F.map_concat(rest, own)).cast("binary").alias("content"))


def new_views(views: DataFrame, images: DataFrame) -> DataFrame:
    """images (scene, file) -> with id and folder: numbered on behind each scene's views, by file name."""
    last = max_view_id(views).withColumnRenamed("id", "last")
    r = F.row_number().over(W.partitionBy("scene").orderBy("file"))
    out = images.join(last, "scene", "left").withColumn("id", F.coalesce("last", F.lit(-1)) + r).drop("last")
    return out.withColumn("folder", F.format_string("view_%04d.mve", "id"))
