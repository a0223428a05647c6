"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, small_side, table
from .simhash import merge
from .topk import usable

#: Low-dimensional blocks that rotated vectors are split into.
BLOCKS = 8
#: Rows of a cell that meet in one task; larger cells are dealt as pairs of such chunks. Rows of one distance matrix.
CHUNK, ROWS = 4096, 512
SLACK = 1e-9


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int) -> list[int]:
    n = min(BLOCKS, dim)
    return [dim * i // n for i in range(n + 1)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """The squared distance that each block may have: its share, by dimensions, of that of unit vectors at the cosine."""
    return np.diff(block_edges(dim)) / dim * (2 - 2 * cosine) + SLACK


def cells(z: np.ndarray, cosine: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, row, cell, flags) of rotated unit rows: the home cell of the first two coordinates of each block, and the
    next cells where the row is near enough to the border. flags tell in which coordinates a cell is the next one."""
    edges, most = block_edges(z.shape[1]), budgets(z.shape[1], cosine)
    out = []
    for b, lo in enumerate(edges[:-1]):
        reach = np.sqrt(most[b]) * (1 + SLACK)
        width = 2 * reach
        x = z[:, lo : min(lo + 2, edges[b + 1])]
        home = np.floor(x / width).astype(np.int64)
        near = x + reach >= (home + 1) * width
        for f in range(1 << x.shape[1]):
            step = np.array([f >> i & 1 for i in range(x.shape[1])])
            rows = np.flatnonzero((near | (step == 0)).all(1))
            cell = home[rows] + step
            out.append((b, rows, cell[:, 0] * 1_000_003 + (cell[:, 1] if x.shape[1] > 1 else 0), np.full(len(rows), f)))
    return out


def pairs_of(v: np.ndarray, z: np.ndarray, flags: np.ndarray, side: np.ndarray, block: int, cosine: float):
    """Index pairs (i < j) with the cosine, of which this block is the first within its budget and this cell the common one."""
    edges, most = block_edges(z.shape[1]), budgets(z.shape[1], cosine)
    own = z[:, edges[block] : edges[block + 1]]
    square = (own**2).sum(1)
    crossed = bool((side == 1).any())
    for at in range(0, len(v), ROWS):
        d = square[at : at + ROWS, None] + square[None, at:] - 2 * own[at : at + ROWS] @ own[at:].T
        i, j = np.nonzero(d <= most[block] + SLACK)
        i, j = i + at, j + at
        ok = (i < j) & ((flags[i] & flags[j]) == 0)
        if crossed:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 200_000):
            a, b = i[s : s + 200_000], j[s : s + 200_000]
            d2 = np.add.reduceat((z[a] - z[b]) ** 2, edges[:-1], axis=1) if len(a) else np.empty((0, len(edges) - 1))
            good = (d2[:, block] <= most[block]) & ~(d2[:, :block] <= most[:block]).any(1)
            a, b = a[good], b[good]
            cos = np.einsum("ij,ij->i", v[a], v[b]) / np.sqrt(np.einsum("ij,ij->i", v[a], v[a])) / np.sqrt(np.einsum("ij,ij->i", v[b], v[b]))
            good = cos >= cosine
            yield a[good], b[good]


def near_links(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Rows of equal, non-null labels link at the cosine or more, in double precision. Vectors that are null, zero or hold
    null or non-finite components, and rows without label, have no links and are their own components. Equal vectors of
    a label meet the others once, as one vector, and count one link each. Only vectors of equal length meet. A row
    without vec_id links and counts, but gives no component its id. Repeated vec_ids are rows of their own that share
    a component. An empty table gives no rows.

    Unit vectors are rotated at random and split into blocks; if two are near, at least one block is within its share
    of the squared distance. Each block is range-joined on a grid of its first two coordinates, candidates are checked
    exactly in the first block that has them, and tasks return counts and stars, never pairs.
    """
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fit = F.coalesce(usable(F.col("embedding")) & F.col("label").isNotNull() & (norm2 > 0), F.lit(False))
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", F.when(fit, F.xxhash64("label", doubles)).alias("h1"), F.when(fit, F.xxhash64(F.lit("b"), doubles, "label")).alias("h2"), F.when(fit, F.col("label").cast("string")).alias("label"), F.when(fit, doubles).alias("v"))
    keys = cut(rows.select("vec_id", "h1", "h2"), "keys")
    classes = cut(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                sizes = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    part = b.take(pa.array(np.flatnonzero(sizes == size)))
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    z = v / np.abs(v).max(1, keepdims=True)
                    z = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ rotation(int(size))
                    for block, r, cell, flags in cells(z, cosine):
                        p = part.take(pa.array(r))
                        fill = lambda x, kind: pa.array(np.full(len(r), x), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([p.column("label"), fill(size, pa.int32()), fill(block, pa.int32()), pa.array(cell), pa.array(flags, pa.int32()), p.column("h1"), p.column("copies"), p.column("v")], names=["label", "size", "block", "cell", "flags", "id", "copies", "v"])

    placed = classes.select("label", "h1", "copies", "v").mapInArrow(deal, "label string, size int, block int, cell long, flags int, id long, copies long, v array<double>")
    cell = ["label", "size", "block", "cell"]
    large = cut(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "large")
    m = F.coalesce(F.ceil(F.col("n") / CHUNK).cast("int"), F.lit(1))
    placed = placed.join(small_side(large), cell, "left").withColumn("m", m).withColumn("c", F.pmod(F.xxhash64("id", F.lit(5)), F.col("m")).cast("int"))
    met = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    met = met.select(*cell, F.least("c", "j").alias("p"), F.greatest("c", "j").alias("q"), (F.col("c") > F.col("j")).cast("int").alias("side"), "flags", "id", "copies", "v")

    def run(t: pa.Table) -> pa.Table:
        size, block = t.column("size")[0].as_py(), t.column("block")[0].as_py()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        ids, copies, flags, side = (t.column(c).to_numpy() for c in ("id", "copies", "flags", "side"))
        z = v / np.abs(v).max(1, keepdims=True)
        z = (z / np.linalg.norm(z, axis=1, keepdims=True)) @ rotation(size)
        links, label = np.zeros(len(v), np.int64), np.arange(len(v))
        for a, b in pairs_of(v, z, flags, side, block, cosine):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = merge(label, a, b)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "root": ids[label[some]], "links": links[some]})

    found = cut(met.groupBy(*cell, "p", "q").applyInArrow(run, "id long, root long, links long"), "found")
    comp = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("h1", "h2", "first", "copies").join(comp.select(F.col("node").alias("h1"), F.col("component").alias("root")), "h1", "left").join(links.withColumnRenamed("id", "h1"), "h1", "left")
    named = named.withColumn("root", F.coalesce("root", "h1"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keys.join(named, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_inner_product(a.v, b.v) / a.n / b.n >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.u = m.vec_id LEFT JOIN k ON k.u = m.vec_id
"""
