"""Text formats as column expressions: meshes, settings and transforms. A malformed file raises an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines without comments and blank ones."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")


def _vertices(df: DataFrame, rows: Column, first: int) -> DataFrame:
    x = df.select("path", F.posexplode(rows).alias("vid", "line")).withColumn("t", F.split("line", r"\s+"))
    return x.select("path", F.col("vid").cast("long"), *(F.col("t")[first + k].cast("float").alias(c) for k, c in enumerate("xyz")))


def read_smf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (path, vid, x, y, z) and faces (path, fid, v0, v1, v2) of `v` and `f` lines; ids in files count from 1."""
    df = files(spark, path).select("path", lines_of(F.col("text")).alias("l"))
    kind = lambda k: F.filter("l", lambda x: x.rlike(rf"^{k}\s"))
    f = df.select("path", F.posexplode(kind("f")).alias("fid", "line")).withColumn("t", F.split("line", r"\s+"))
    faces = f.select("path", F.col("fid").cast("long"), *((F.col("t")[k + 1].cast("long") - 1).alias(f"v{k}") for k in range(3)))
    return _vertices(df, kind("v"), 1), faces


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices and faces as in read_smf. Quads become (0, 1, 2) and (2, 3, 0); faces of other sizes or with indices out
    of range are left out, and fid counts those kept."""
    df = files(spark, path).select("path", lines_of(F.col("text")).alias("l"))
    df = df.select("path", "l", F.when(F.col("l")[0] == "OFF", F.split(F.col("l")[1], r"\s+")).otherwise(F.raise_error(F.lit("no OFF file"))).alias("n"))
    df = df.select("path", "l", F.col("n")[0].cast("int").alias("nv"), F.col("n")[1].cast("int").alias("nf"))
    corner = lambda x: F.transform(F.split(x, r"\s+"), lambda t: t.cast("long"))
    rows = F.transform(F.slice("l", F.col("nv") + 3, F.col("nf")), corner)
    right = lambda t: t[0].isin(3, 4) & F.forall(F.slice(t, F.lit(2), t[0].cast("int")), lambda v: (v >= 0) & (v < F.col("nv")))
    split = lambda t: F.when(t[0] == 3, F.array(F.array(t[1], t[2], t[3]))).otherwise(F.array(F.array(t[1], t[2], t[3]), F.array(t[3], t[4], t[1])))
    faces = df.select("path", F.posexplode(F.flatten(F.transform(F.filter(rows, right), split))).alias("fid", "v"))
    return _vertices(df, F.slice("l", F.lit(3), F.col("nv")), 0), faces.select("path", F.col("fid").cast("long"), *(F.col("v")[k].alias(f"v{k}") for k in range(3)))


def parse_ini(text: Column) -> Column:
    """section.key -> value. `#` starts a comment line; a last line without a line break is dropped; the last of equal
    keys stands. A key before any section raises an error."""
    whole = F.transform(F.split(F.regexp_replace(text, r"[^\n]*\z", ""), "\n"), lambda x: strip(x))
    used = F.filter(whole, lambda x: (x != "") & ~x.startswith("#"))
    start = F.struct(F.lit("").alias("s"), F.create_map().cast("map<string,string>").alias("m"))

    def step(a: Column, x: Column) -> Column:
        key = F.when(a["s"] == "", F.raise_error(F.lit("key outside a section")).cast("string")).otherwise(F.concat(a["s"], F.lit("."), strip(F.regexp_extract(x, "^([^=]*)=", 1))))
        value = strip(F.regexp_extract(x, "^[^=]*=(.*)$", 1))
        added = F.map_concat(F.map_filter(a["m"], lambda k, _: k != key), F.create_map(key, value))
        return F.when(x.rlike(r"^\[.*\]$"), F.struct(F.regexp_extract(x, r"^\[(.*)\]$", 1).alias("s"), a["m"].alias("m"))).otherwise(F.struct(a["s"].alias("s"), added.alias("m")))

    return F.aggregate(used, start, step, lambda a: a["m"])


def read_xf(spark: SparkSession, path: str) -> DataFrame:
    """path, m: the 16 numbers of a 4 x 4 transform, row by row."""
    numbers = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: x.cast("float"))
    return files(spark, path).select("path", numbers.alias("m")).select("path", F.when(F.size("m") == 16, F.col("m")).otherwise(F.raise_error(F.lit("a transform has 16 numbers"))).alias("m"))
