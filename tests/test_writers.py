"""Writers: what they write, the readers read."""

import pytest
from pyspark.sql import functions as F

from vantage.sources import text, writers

POINTS = [("a", 0, 0.0, 0.0, 1.0), ("a", 1, 0.0, 1.5, 0.0), ("a", 2, 1.0, 0.0, 0.25), ("b", 0, 9.0, 8.0, 7.0)]


@pytest.mark.parametrize("kind", ["off", "smf", "obj"])
def test_mesh_round_trip(spark, tmp_path, kind):
    v = spark.createDataFrame(POINTS, "path string, vid long, x float, y float, z float")
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 2, 1, 0), ("none", 0, 0, 1, 2)], "path string, fid long, v0 long, v1 long, v2 long")
    writers.write_lines(writers.mesh_lines(v, f, kind), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("path=*")) == ["path=a", "path=b"]
    for name in "ab":
        whole = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"path={name}").glob("part-*")))
        (tmp_path / f"{name}.{kind}").write_text(whole)
    read = text.read_off if kind == "off" else text.read_smf
    got_v, got_f = read(spark, str(tmp_path / f"a.{kind}"))
    assert [tuple(r)[1:] for r in got_v.orderBy("vid").collect()] == [p[1:] for p in POINTS[:3]]
    assert [tuple(r)[1:] for r in got_f.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 2, 1, 0)]
    assert read(spark, str(tmp_path / f"b.{kind}"))[0].count() == 1
    if kind == "off":
        assert (tmp_path / "a.off").read_text().splitlines()[:3] == ["OFF", "3 2 0", "0.0000000 0.0000000 1.0000000"]


def test_settings_points_and_transform(spark):
    m = {"view.name": " a b ", "camera.flen": "1.5", "view.id": "3", "camera.x.y": "2"}
    df = spark.createDataFrame([(m, [float(k) for k in range(16)])], "m map<string,string>, t array<float>")
    r = df.select(writers.write_ini(F.col("m")).alias("i"), writers.write_xf(F.col("t")).alias("x")).first()
    assert r["i"] == "\n[camera]\nflen = 1.5\nx.y = 2\n\n[view]\nid = 3\nname = a b\n"
    assert df.select(writers.write_ini(F.col("m")).alias("i")).select(text.parse_ini(F.col("i")).alias("m")).first()["m"] == {k: v.strip() for k, v in m.items()}
    assert r["x"].splitlines()[1] == "4.0 5.0 6.0 7.0"
    p = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0)], "path string, vid long, x float, y float, z float, nx float, ny float, nz float")
    assert writers.point_lines(p).first()["line"] == "1.0 2.0 3.0 0.0 0.0 1.0"
    with pytest.raises(Exception, match="section"):
        spark.createDataFrame([({"id": "1"},)], "m map<string,string>").select(writers.write_ini(F.col("m"))).collect()
