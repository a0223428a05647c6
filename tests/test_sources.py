"""Readers on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.sources import images, text


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
@pytest.mark.parametrize("channels", [1, 3])
def test_images_round_trip(spark, tmp_path, kind, channels):
    v = (np.arange(4 * 5 * channels).reshape(4, 5, channels) * 3).astype(kind)
    (tmp_path / "a.img").write_bytes(images.encode(v))
    df = images.read_images(spark, str(tmp_path))
    r = df.first()
    assert (r["width"], r["height"], r["channels"], r["type"], bytes(r["data"])) == (5, 4, channels, kind, v.tobytes())
    assert bytes(images.encode_images(df).first()["content"]) == images.encode(v)


def test_pfm_scale_and_byte_order():
    v = images.decode(b"Pf\n2 1\n2.0\n" + np.array([1, 2], ">f4").tobytes())
    assert v.ravel().tolist() == [2.0, 4.0]


def test_meshes(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF # mesh\n4 4 0\n0 0 1\n0 1 0\n1 0 0\n1 1 1\n3 0 1 2\n4 0 1 2 3\n3 0 1 9\n5 0 1 2 3 0\n")
    (tmp_path / "b.smf").write_text("# mesh\nv 0 0 1\t\r\n\tv 0 1 0\nv 1 0 0\nf 1 2 3\n")
    v, f = text.read_off(spark, str(tmp_path / "a.off"))
    assert [tuple(r)[1:] for r in v.orderBy("vid").collect()] == [(0, 0, 0, 1), (1, 0, 1, 0), (2, 1, 0, 0), (3, 1, 1, 1)]
    assert [tuple(r)[1:] for r in f.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 2, 3, 0)]
    v, f = text.read_smf(spark, str(tmp_path / "b.smf"))
    assert v.count() == 3 and [tuple(r)[1:] for r in f.collect()] == [(0, 0, 1, 2)]


def test_settings_and_transform(spark, tmp_path):
    df = spark.createDataFrame([("# c\n[view]\nid = 3\nname = a b\n[camera]\r\nflen=1.5\t\nid = 4\nid = 5\nlost = 1",)], "t string")
    assert df.select(text.parse_ini(F.col("t")).alias("m")).first()["m"] == {"view.id": "3", "view.name": "a b", "camera.flen": "1.5", "camera.id": "5"}
    (tmp_path / "a.xf").write_text("1 0 0 0\n0 1 0 0\n0 0 1 2\n0 0 0 1\n")
    assert text.read_xf(spark, str(tmp_path)).first()["m"] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 2, 0, 0, 0, 1]
