"""Tracks, bundles, meshes, rasters, samples and sparse matrices as plans over their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vantage.functions import vectors as V
from vantage.plans.common import connected_components, cut, discard


def order_statistics(df: DataFrame, column: str, places: list[int], sorted_rows: int = 100_000) -> list[float | None]:
    """The elements at the 0-based places of the column's sorted values, null and NaN left out, by histogram refinement: no
    global sort. None for every place of a table without values; a place out of range raises an error.

    The column is written once; each round is one aggregate that narrows a range, and at most sorted_rows values of it are
    then sorted.
    """
    x = cut(df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)"), "values")
    lo0, hi0, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    out = []
    for place in places if n else []:
        lo, hi, skip, size = lo0, hi0, place, n
        if not 0 <= place < n:
            raise IndexError(place)
        inside = x
        while size > sorted_rows and lo < hi:
            b = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / 1024)), F.lit(1023)).cast("int")
            for r in inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect():  # 1024 rows
                if skip < r["n"]:
                    lo, hi, size = r["lo"], r["hi"], r["n"]
                    break
                skip -= r["n"]
            inside = x.where(F.col("x").between(lo, hi))
        out.append(lo if lo == hi else inside.orderBy("x").limit(skip + 1).agg(F.max("x")).first()[0])
    discard(x)
    return out or [None] * len(places)


def dense_ids(df: DataFrame, key: str, name: str, slices: int = 64) -> DataFrame:
    """df (distinct whole numbers in key) with name: their ranks from 0. Ranges of keys are ranked on their own, with offsets
    from the counts of the ranges before."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    t = df.withColumn("__slice", F.floor((F.col(key) - (lo or 0)) / max(1, ((hi or 0) - (lo or 0)) // slices + 1)))
    n = t.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    n = n.select("__slice", F.coalesce(F.sum("__n").over(W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # `slices` rows
    r = F.row_number().over(W.partitionBy("__slice").orderBy(key)) - 1
    return t.withColumn("__r", r).join(F.broadcast(n), "__slice").withColumn(name, (F.col("__r") + F.col("__before")).cast("long")).drop("__slice", "__r", "__before")


def valid_tracks(refs: DataFrame, track: str, view: str) -> DataFrame:
    """track, new_id: tracks of which no view has two features, numbered from 0 in their order."""
    ok = refs.groupBy(track).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(view).alias("views")).where("n = views").select(track)
    return dense_ids(ok, track, "new_id")


def view_pairs(refs: DataFrame, track: str, view: str) -> DataFrame:
    """(v1 < v2, n): common tracks of view pairs. Rows of a track meet in a join, which adaptive execution may split; counts
    are partial before they are shuffled."""
    own = refs.select(track, view).distinct()
    both = own.select(track, F.col(view).alias("v1")).join(own.select(track, F.col(view).alias("v2")), track).where("v1 < v2")
    return both.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"))


def large_errors(errors: DataFrame, column: str, factor: float = 10.0) -> DataFrame:
    """Rows whose error is above factor times the upper median; none of an empty table."""
    n = errors.where(F.col(column).isNotNull()).count()
    middle = order_statistics(errors, column, [n // 2])[0] if n else None
    return errors.where(F.lit(False) if middle is None else F.col(column) > factor * middle)


def corners(faces: DataFrame) -> DataFrame:
    return faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))


def edges(faces: DataFrame) -> DataFrame:
    """(e1 < e2, fid) of each side of each face."""
    side = lambda a, b: F.struct(F.least(a, b).alias("e1"), F.greatest(a, b).alias("e2"))
    return faces.select("fid", F.explode(F.array(side("v0", "v1"), side("v1", "v2"), side("v2", "v0"))).alias("e")).select("e.e1", "e.e2", "fid").where("e1 <> e2").distinct()


def adjacency(faces: DataFrame) -> DataFrame:
    """vid, n_faces, n_neighbours of every referenced vertex."""
    e = edges(faces).select("e1", "e2").distinct()
    near = e.select(F.col("e1").alias("vid"), F.col("e2").alias("o")).union(e.select("e2", "e1")).groupBy("vid").agg(F.count(F.lit(1)).alias("n_neighbours"))
    return corners(faces).distinct().groupBy("vid").agg(F.count(F.lit(1)).alias("n_faces")).join(near, "vid", "left").fillna(0, ["n_neighbours"])


def renumber(vertices: DataFrame, faces: DataFrame, deleted: Column) -> DataFrame:
    """Faces left when the vertices of the condition go, with vertex ids counted anew in order."""
    new = dense_ids(vertices.where(~deleted).select("vid"), "vid", "n")
    out = faces
    for c in ("v0", "v1", "v2"):
        out = out.join(new.select(F.col("vid").alias(c), F.col("n").alias(f"n{c}")), c)
    return out.select("fid", *(F.col(f"n{c}").cast("long").alias(c) for c in ("v0", "v1", "v2")))


def delete_vertices(vertices: DataFrame, deleted: Column) -> DataFrame:
    """Vertices left, all of their columns with new ids from 0."""
    return dense_ids(vertices.where(~deleted), "vid", "new_vid")


def delete_invalid_faces(faces: DataFrame) -> DataFrame:
    """Without faces whose three corners are one vertex."""
    return faces.where((F.col("v0") != F.col("v1")) | (F.col("v0") != F.col("v2")))


def unreferenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that no face has."""
    return vertices.join(corners(faces).select("vid").distinct(), "vid", "left_anti")


def component_sizes(faces: DataFrame) -> DataFrame:
    """vid, component, size: the connected part of each vertex of a face, and its number of vertices."""
    c = corners(faces)
    e = faces.select(F.col("v0").cast("long").alias("u"), F.col("v1").cast("long").alias("v")).union(faces.select(F.col("v0").cast("long"), F.col("v2").cast("long")))
    comp = c.select(F.col("vid").cast("long")).distinct().join(connected_components(e).withColumnRenamed("node", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    return comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")


def delete_small_components(vertices: DataFrame, faces: DataFrame, threshold: int) -> DataFrame:
    """Vertices of components of more than `threshold` vertices; a vertex without a face is a component of one."""
    sized = vertices.join(component_sizes(faces), "vid", "left")
    return sized.where(F.coalesce("size", F.lit(1)) > threshold).drop("component", "size")


def mesh_merge(vertices: DataFrame, faces: DataFrame, more_vertices: DataFrame, more_faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two meshes as one: the second's ids follow the first's."""
    v, f = vertices.agg(F.max("vid")).first()[0], faces.agg(F.max("fid")).first()[0]
    v, f = (-1 if x is None else x for x in (v, f))
    moved = more_faces.withColumns({"fid": F.col("fid") + f + 1} | {c: F.col(c) + v + 1 for c in ("v0", "v1", "v2")})
    return vertices.unionByName(more_vertices.withColumn("vid", F.col("vid") + v + 1)), faces.unionByName(moved)


def invert_faces(faces: DataFrame) -> DataFrame:
    """Faces turned around; normals of a vertex or face table are negated by the caller's columns."""
    return faces.withColumns({"v0": F.col("v2"), "v2": F.col("v0")})


def corner_positions(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, v0, v1, v2 and p0, p1, p2: the corners' (x, y, z)."""
    at = vertices.select("vid", F.array(*(F.col(c).cast("double") for c in "xyz")).alias("p"))
    out = faces.select("fid", "v0", "v1", "v2")
    for k in range(3):
        out = out.join(at.select(F.col("vid").alias(f"v{k}"), F.col("p").alias(f"p{k}")), f"v{k}")
    return out


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, v0, v1, v2, p0, p1, p2, n: the unit normal of each face, zero for faces without area."""
    t = corner_positions(vertices, faces)
    p = [V.parts(F.col(f"p{k}"), 3) for k in range(3)]
    n = V.cross(V.sub(p[1], p[0]), V.sub(p[2], p[0]))
    size = V.norm(n)
    return t.withColumn("n", V.pack([F.when(size > 0, x / F.nullif(size, F.lit(0.0))).otherwise(0.0) for x in n]))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid, nx, ny, nz: the unit mean of the normals of a vertex's faces, weighted by their angles there; zero without one."""
    t = face_normals(vertices, faces)
    p = [V.parts(F.col(f"p{k}"), 3) for k in range(3)]

    def angle(k: int) -> Column:
        a, b = V.normalize(V.sub(p[(k + 1) % 3], p[k])), V.normalize(V.sub(p[(k + 2) % 3], p[k]))
        return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(a, b)))), F.lit(0.0))

    each = t.select("n", F.explode(F.array(*(F.struct(F.col(f"v{k}").alias("vid"), angle(k).alias("w")) for k in range(3)))).alias("c"))
    sums = each.groupBy("c.vid").agg(*(F.sum(F.get("n", F.lit(i)) * F.col("c.w")).alias(f"s{i}") for i in range(3)))
    size = F.sqrt(sum(F.col(f"s{i}") * F.col(f"s{i}") for i in range(3)))
    out = sums.select("vid", *((F.when(size > 0, F.col(f"s{i}") / F.nullif(size, F.lit(0.0))).otherwise(0.0)).alias(f"n{c}") for i, c in enumerate("xyz")))
    return vertices.select("vid").join(out, "vid", "left").fillna(0.0, ["nx", "ny", "nz"])


def vertex_classes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid, class: unreferenced, simple (a closed ring of faces), border (an open one), or complex.

    The sides that a vertex's faces turn towards it, from the next corner to the last, are a ring's steps: it is closed if
    every corner has one step in and one out, open if one has none in and one none out, and all steps hang together.
    """
    step = lambda a, b, c: F.struct(F.col(a).alias("vid"), F.col(b).alias("u"), F.col(c).alias("w"))
    steps = faces.select(F.explode(F.array(step("v0", "v1", "v2"), step("v1", "v2", "v0"), step("v2", "v0", "v1"))).alias("s")).select("s.vid", "s.u", "s.w")
    ends = steps.select("vid", F.col("u").alias("o"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(steps.select("vid", "w", F.lit(0), F.lit(1)))
    ends = ends.groupBy("vid", "o").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    shape = ends.groupBy("vid").agg(F.max(F.greatest("out", "in")).alias("most"), F.count_if(F.col("in") == 0).alias("starts"), F.count_if(F.col("out") == 0).alias("stops"), F.count(F.lit(1)).alias("corners"))
    # Whether the steps hang together: components of the corners around each vertex.
    linked = shape.where("most = 1").select("vid").join(steps, "vid")
    node = lambda c: F.xxhash64("vid", c)
    comp = connected_components(linked.select(node("u").alias("u"), node("w").alias("v")))
    parts = linked.select("vid", node("u").alias("node")).join(comp, "node").groupBy("vid").agg(F.countDistinct("component").alias("parts"))
    told = shape.join(parts, "vid", "left")
    kind = F.when((F.col("most") == 1) & (F.col("parts") == 1) & (F.col("starts") == 0) & (F.col("stops") == 0), "simple").when((F.col("most") == 1) & (F.col("parts") == 1) & (F.col("starts") == 1) & (F.col("stops") == 1), "border").otherwise("complex")
    return vertices.select("vid").join(told.select("vid", kind.alias("class")), "vid", "left").fillna("unreferenced", ["class"])


def normalised(df: DataFrame, column: str, out: str) -> DataFrame:
    """(v - min) / (max - min), zero where all are equal."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(out, (F.col(column) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0))


def integral(pixels: DataFrame) -> DataFrame:
    """(x, y, v) -> s: the sum over all pixels up to and with (x, y)."""
    row = F.sum("v").over(W.partitionBy("y").orderBy("x"))
    return pixels.withColumn("r", row).withColumn("s", F.sum("r").over(W.partitionBy("x").orderBy("y"))).drop("r")


def half_size(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Means of 2 by 2 pixels; at odd ends the last pixel stands for its missing neighbour."""
    px, py = F.col("x"), F.col("y")
    weight = F.when((px == width - 1) & (width % 2 == 1), 2).otherwise(1) * F.when((py == height - 1) & (height % 2 == 1), 2).otherwise(1)
    return pixels.groupBy(F.floor(px / 2).alias("x"), F.floor(py / 2).alias("y")).agg((F.sum(F.col("v") * weight) / 4).alias("v"))


def sobel(pixels: DataFrame, width: int, height: int, most: float = 255.0) -> DataFrame:
    """The gradient's length, at most `most`; zero on the border."""
    w = W.partitionBy("y").orderBy("x")
    at = pixels.withColumn("l", F.lag("v").over(w)).withColumn("r", F.lead("v").over(w)).withColumn("smooth", F.col("l") + 2 * F.col("v") + F.col("r")).withColumn("slope", F.col("r") - F.col("l"))
    c = W.partitionBy("x").orderBy("y")
    gx = F.lag("slope").over(c) + 2 * F.col("slope") + F.lead("slope").over(c)
    gy = F.lead("smooth").over(c) - F.lag("smooth").over(c)
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    return at.withColumn("g", F.least(F.lit(most), F.sqrt(gx * gx + gy * gy))).select("x", "y", F.when(border, 0.0).otherwise(F.col("g")).alias("g"))


def sparse_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w")), "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def sparse_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b.withColumn("v", -F.col("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def range_sums(samples: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """points (pid, p) and samples (s, value): per point, how many samples lie within reach and the sum of their values
    by a linear weight. Points visit the grid cells beside theirs, so the join is an equality of cells."""
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    near = points.withColumn("cell", F.explode(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: cell(F.col("p")) + d)))
    met = near.join(samples.withColumn("cell", cell(F.col("s"))), "cell").where(F.abs(F.col("p") - F.col("s")) <= reach)
    return met.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (1 - F.abs(F.col("p") - F.col("s")) / reach)).alias("f"))


def greedy_views(refs: DataFrame, view: str, track: str, k: int) -> list[tuple[int, int]]:
    """At most k views, one after the other: that of the most tracks not seen yet, ties to the lowest id."""
    left, out = refs.select(view, track).distinct(), []
    for _ in range(k):
        best = left.groupBy(view).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), view).first()
        if best is None:
            break
        out.append((best[view], best["n"]))
        left = left.join(left.where(F.col(view) == best[view]).select(track), track, "left_anti")
    return out
