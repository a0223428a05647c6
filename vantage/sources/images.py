"""PFM, PGM and PPM images. Pixels stay packed (row by row from the top, channels together, little-endian)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PIXELS = 1 << 28
SCHEMA = "path string, width int, height int, channels int, type string, data binary"
HEADER = re.compile(rb"(P5|P6|Pf|PF)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+([-+.\deE]+)\s")


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) of uint8, uint16 or float32. The sign of a PFM's scale is its byte order; values are
    multiplied by its size, and rows are stored from the bottom."""
    head = HEADER.match(raw)
    if not head:
        raise ValueError("neither PFM, PGM nor PPM")
    width, height, top = int(head[2]), int(head[3]), float(head[4])
    channels = 3 if head[1] in (b"P6", b"PF") else 1
    if width * height > MAX_PIXELS:
        raise ValueError("image too large")
    kind = ("<f4" if top < 0 else ">f4") if head[1] in (b"Pf", b"PF") else ("u1" if top < 256 else ">u2")
    v = np.frombuffer(raw, kind, width * height * channels, head.end()).reshape(height, width, channels)
    if v.dtype.kind == "f":
        return v[::-1].astype("<f4") * np.float32(abs(top))
    return v.astype(v.dtype.newbyteorder("<"))


def encode(v: np.ndarray) -> bytes:
    """The file of an image of one or three channels: PFM for float32, else PGM or PPM."""
    height, width, channels = v.shape
    if v.dtype.kind == "f":
        return b"%s\n%d %d\n-1.0\n" % (b"Pf" if channels == 1 else b"PF", width, height) + v[::-1].astype("<f4").tobytes()
    return b"%s\n%d %d\n%d\n" % (b"P5" if channels == 1 else b"P6", width, height, 255 if v.dtype.itemsize == 1 else 65535) + v.astype(v.dtype.newbyteorder(">")).tobytes()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, type, data of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v = decode(raw)
                yield pd.DataFrame([(name, v.shape[1], v.shape[0], v.shape[2], v.dtype.name, v.tobytes())], columns=["path", "width", "height", "channels", "type", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def encode_images(images: DataFrame) -> DataFrame:
    """path, content: the files of images in SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                v = np.frombuffer(r.data, np.dtype(r.type)).reshape(r.height, r.width, r.channels)
                yield pd.DataFrame({"path": [r.path], "content": [encode(v)]})

    return images.select(*(F.col(c.split()[0]) for c in SCHEMA.split(", "))).mapInPandas(run, "path string, content binary")
