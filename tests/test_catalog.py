"""Every catalog query against its SQL, and golden values of operators on small inputs."""

import sys

import duckdb
import pytest
from conftest import SF
from oracle import compare
from pyspark.sql import functions as F

from vantage.functions import columns as C
from vantage.operators import matching as M
from vantage.operators import relational as R
from vantage.plans import catalog
from vantage.plans.common import connected_components, dense_position


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, catalog.QUERIES[name], catalog.SQL[name]) == ""


def test_greedy_views(spark):
    rows = catalog.greedy_topk(spark, SF).collect()
    assert [r["pick"] for r in rows] == list(range(1, len(rows) + 1)) and [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)


def test_nearest_two_golden(spark):
    e = [[127, 0, 0, 0, 0, 0, 0, 0], [0, -127, 0, 0, 0, 0, 0, 0], [0, 0, 90, 90, 0, 0, 0, 0], [0, 0, 0, 0, 90, -90, 0, 0]]
    q = [[127, 0, 0, 0, 0, 0, 0, 0], [-127, 0, 0, 0, 0, 0, 0, 0], [0, 0, 90, 90, 0, 0, 0, 0], [0, 0, 90, 0, 0, -90, 0, 0], [0, 0, 90, 0, 0, 90, 0, 0]]
    frame = lambda x: spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = [(r["d1"], r["d2"], r["i1"], r["i2"]) for r in M.nearest_two(frame(q), frame(e), "int16").orderBy("q").collect()]
    assert got == [(0, 32258, 0, 3), (32258, 32258, 3, 2), (0, 32258, 2, 3), (16058, 16058, 3, 2), (16058, 32258, 2, 1)]


def test_mutual_golden(spark):
    m = lambda x: spark.createDataFrame(x, "i int, j int")
    assert [tuple(r) for r in M.mutual(m([(0, 1), (2, 3), (3, 2)]), m([(0, 3), (1, 1), (3, 2)])).collect()] == [(2, 3)]


def test_half_size_and_integral_golden(spark):
    p = spark.createDataFrame([(x, y, float(2 * (4 * y + x))) for y in range(2) for x in range(4)], "x int, y int, v double")
    assert [(r["x"], r["v"]) for r in R.half_size(p, 4, 2).orderBy("x").collect()] == [(0, 5.0), (1, 9.0)]
    odd = spark.createDataFrame([(x, y, float(2 * (3 * y + x))) for y in range(2) for x in range(3)], "x int, y int, v double")
    assert [(r["x"], r["v"]) for r in R.half_size(odd, 3, 2).orderBy("x").collect()] == [(0, 4.0), (1, 7.0)]
    q = spark.createDataFrame([(x, y, float(2 * (4 * y + x))) for y in range(4) for x in range(4)], "x int, y int, v double")
    assert [r["s"] for r in R.integral(q).orderBy("y", "x").collect()] == [0, 2, 6, 12, 8, 20, 36, 56, 24, 54, 90, 132, 48, 104, 168, 240]


def test_strings_golden(spark):
    row = spark.range(1).select(
        C.punctate(F.lit("1234567890"), ".", 4), C.punctate(F.lit("1234567890"), ".", 2), C.punctate(F.lit("1234567890"), ".", 0), C.clip_whitespace(F.lit("\t  \t test\t ")), C.clip_newlines(F.lit("test\n\r")), C.clip_newlines(F.lit("test\n\t")),
        F.size(C.split_tokens(F.lit(":test1::test2:test3::"), ":", True)), F.size(C.split_tokens(F.lit(":test1::test2:test3::"), ":")), C.id_ranges(F.lit("3-1,7")), C.simplify(F.lit("-a b--c!")), C.from_gray_code(F.lit(6)), C.ellipsize(F.lit("abcdefghij"), 7, "middle"), C.dirname(F.lit("/a/b/")),
    ).first()
    assert list(row) == ["12.3456.7890", "12.34.56.78.90", "1234567890", "test", "test", "test\n\t", 7, 3, [3, 2, 1, 7], " A B C", 4, "ab...ij", "/a"]


def test_letters_keep_their_number(spark, tmp_path):
    """sharp s, ligatures, a dotted capital I and a final sigma become one letter each, as in the query's SQL."""
    texts = ["Erßie", "ßßßß", "ﬁn ŉa", "İSΑΣ ΑΣ", "ᾳǰΐև", "\U00010428a\t \tb", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = con.execute(catalog.SQL["normalize_text"]).fetchall()
    assert sorted(map(tuple, catalog.normalize_text(spark, str(tmp_path)).collect())) == sorted(want)
    letters = [chr(k) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF]
    every = spark.createDataFrame([("".join(letters),)], "s string").select(C.lower_letters(F.col("s")), C.upper_letters(F.col("s"))).first()
    assert tuple(every) == con.execute("SELECT lower($1), upper($1)", ["".join(letters)]).fetchone()


def test_float_to_byte_golden(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (2.0,)], "v double").select(C.float_to_byte(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 255, 128, 255]


@pytest.mark.parametrize("column", ["x", "same"])
def test_order_statistics(spark, column):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2003 / 7.0).alias("x"), F.lit(3.0).alias("same"))
    want = sorted(r[0] for r in df.select(column).collect())
    assert R.order_statistics(df, column, [0, 777, 1999], sorted_rows=50) == [want[0], want[777], want[1999]]


def test_components_and_positions(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1)] + [(k, k + 1) for k in range(100, 160)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{k: 1 for k in range(1, 6)}, 8: 8, 9: 8, **{k: 100 for k in range(100, 161)}}
    assert connected_components(e.limit(0)).count() == 0
    p = dense_position(spark.range(500).withColumn("g", F.col("id") % 3), ["g"], [F.col("id")], F.col("id"), 7, "at").collect()
    assert all(sorted(r["at"] for r in p if r["g"] == g) == list(range(sum(r["g"] == g for r in p))) for g in range(3))


def test_renumber_golden(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "vid long")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 5)], "fid long, v0 long, v1 long, v2 long")
    assert [tuple(r)[1:] for r in R.renumber(v, f, F.col("vid").isin(0, 3, 4)).collect()] == [(0, 1, 2)]
