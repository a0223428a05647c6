"""Text formats as rows of lines. A file of any size stays distributed: write_lines sorts by ranges, not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Index of a mesh's first vertex, vertex prefix and face prefix of each format.
MESHES = {"off": (0, "", "3 "), "smf": (1, "v ", "f "), "obj": (1, "v ", "f ")}


def _words(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(" ", *columns))


def mesh_lines(vertices: DataFrame, faces: DataFrame, kind: str) -> DataFrame:
    """path, part, at, line: the lines of off, smf or obj files in the order of (part, at).

    vertices (path, vid, x, y, z) and faces (path, fid, v0, v1, v2); vid counts from 0 without gaps. OFF has seven
    decimals, the others the shortest text that reads as the same float. A path without faces has vertices only; a
    path without vertices has no file.
    """
    first, v, f = MESHES[kind]
    number = (lambda c: F.format_string("%.7f", F.col(c).cast("double"))) if kind == "off" else (lambda c: F.col(c).cast("float").cast("string"))
    own = vertices.select("path").distinct()
    rows = vertices.select("path", F.lit(1).alias("part"), F.col("vid").cast("long").alias("at"), _words(v, *map(number, "xyz")).alias("line"))
    rows = rows.union(faces.join(own, "path", "left_semi").select("path", F.lit(2), F.col("fid").cast("long"), _words(f, *((F.col(f"v{k}") + first).cast("string") for k in range(3)))))
    if kind != "off":
        return rows
    sizes = rows.groupBy("path").agg(F.count_if(F.col("part") == 1).alias("nv"), F.count_if(F.col("part") == 2).alias("nf"))
    head = sizes.select("path", F.lit(0), F.lit(0).cast("long"), F.concat(F.lit("OFF\n"), F.concat_ws(" ", F.col("nv").cast("string"), F.col("nf").cast("string"), F.lit("0"))))
    return rows.union(head)


def point_lines(vertices: DataFrame) -> DataFrame:
    """path, part, at, line of point files: position and normal, for vertices (path, vid, x, y, z, nx, ny, nz)."""
    return vertices.select("path", F.lit(1).alias("part"), F.col("vid").cast("long").alias("at"), _words("", *(F.col(c).cast("float").cast("string") for c in ("x", "y", "z", "nx", "ny", "nz"))).alias("line"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Write path, part, at, line below folder, a folder for each path: its part files, put together in the order of
    their names, are the file."""
    ordered = lines.repartitionByRange("path", "part", "at").sortWithinPartitions("path", "part", "at")
    ordered.select("path", "line").write.partitionBy("path").text(folder)


def write_ini(m: Column) -> Column:
    """The settings file of a map section.key -> value, sorted by key, a header where the section changes. Keys and
    values are trimmed; a key without a section raises an error; an empty map is an empty text."""
    keys = F.array_sort(F.map_keys(m))
    section = lambda k: F.substring_index(strip(k), ".", 1)

    def line(k: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit("")).otherwise(section(F.get(keys, i - 1)))
        head = F.when(section(k) == before, F.lit("")).otherwise(F.concat(F.lit("\n["), section(k), F.lit("]\n")))
        rest = F.regexp_replace(strip(k), r"^[^.]*\.", "")
        whole = F.concat(head, rest, F.lit(" = "), strip(F.element_at(m, k)), F.lit("\n"))
        return F.when(k.contains("."), whole).otherwise(F.raise_error(F.lit("key without a section")).cast("string"))

    return F.array_join(F.transform(keys, line), "")


def write_xf(m: Column) -> Column:
    """The text of a 4 x 4 transform, a line for each row; another number of values raises an error."""
    rows = [F.array_join(F.transform(F.slice(m, 4 * k + 1, 4), lambda x: x.cast("string")), " ") for k in range(4)]
    return F.when(F.size(m) == 16, F.concat(F.concat_ws("\n", *rows), F.lit("\n"))).otherwise(F.raise_error(F.lit("a transform has 16 numbers")).cast("string"))
