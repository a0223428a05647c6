"""Exact top-k search by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, table

#: Rows and queries that meet in one task, and those that one aggregation works on at a time.
ROW_TILE, QUERY_TILE = 8192, 4096
ROWS, QUERIES = 4096, 256
#: Shares of the lists read at which bounds are compared.
DEPTHS = (0.5, 0.8, 0.9, 0.96, 1.0)
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """id, v: floor(scale * x) of every component in double precision, of the usable vectors."""
    return vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every component's rows by value, and the place of every row in them."""
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(x))[:, None].repeat(x.shape[1], 1), axis=0)
    return order, rank


def aggregate(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of the k best rows of x for each query, ties to smaller ids, own row left out.

    lists: sorted_lists(x). Every component is a list sorted by value, read from its top by queries of a positive weight there and from its
    bottom by those of a negative one, all lists in step. A row's lower bound puts the list's worst value in place of
    what is not read yet, its upper bound the value that the list stands at. A query stops, with what may still
    qualify, once the bounds of all other rows are below its k-th lower bound; only the rows that some query still
    asks about are read further, and to the end, which resolves their scores.
    """
    n, dim = x.shape
    k = min(k, n)
    order, rank = lists
    low, high = x[order[0], np.arange(dim)], x[order[-1], np.arange(dim)]
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T  # weights of reads from the top, from the bottom
    rows, asks = np.arange(n), np.arange(len(q))
    total = np.zeros((n, len(q)))
    maybe = np.ones((n, len(q)), bool)
    maybe[np.searchsorted(ids, own)[own_in := np.isin(own, ids)], np.flatnonzero(own_in)] = False
    done = 0
    for depth in DEPTHS:
        to = n if depth == 1.0 else int(n * depth)
        r, v = rank[rows], x[rows]
        top, bottom = n - 1 - r, r
        now_t, now_b = (top >= done) & (top < to), (bottom >= done) & (bottom < to)
        total += (v * now_t) @ up[:, asks] + (v * now_b) @ down[:, asks]
        done = to
        if to == n:
            break
        rest_t, rest_b = (top >= to).astype(float), (bottom >= to).astype(float)
        at_t, at_b = x[order[n - to - 1], np.arange(dim)], x[order[to], np.arange(dim)]
        worst = total + rest_t @ (low[:, None] * up[:, asks]) + rest_b @ (high[:, None] * down[:, asks])
        best = total + rest_t @ (at_t[:, None] * up[:, asks]) + rest_b @ (at_b[:, None] * down[:, asks])
        worst[~maybe] = -np.inf
        kth = np.partition(worst, len(rows) - min(k, len(rows)), axis=0)[len(rows) - min(k, len(rows))]
        maybe &= best >= kth
        keep = np.flatnonzero(maybe.any(1))
        if len(keep) < 0.9 * len(rows):
            rows, total, maybe = rows[keep], total[keep], maybe[keep]
    found = []
    for j in range(len(asks)):
        c = np.flatnonzero(maybe[:, j])
        c = c[np.lexsort((ids[rows[c]], -total[c, j]))[:k]]
        found.append((np.full(len(c), j), rows[c], total[c, j]))
    a, b, s = (np.concatenate(z) for z in zip(*found, strict=True))
    return a, b, s


def plain_scores(x: np.ndarray, q: np.ndarray) -> bool:
    return bool(len(x) and len(q)) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= EXACT


def top_k(vectors: DataFrame, asks: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `asks` picks, the k other rows of the highest
    integer inner product of floor(scale * x), ties to the smaller vec_id; all of them if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; vectors of
    another length than the query's don't meet it. Rows with the query's own vec_id are not its candidates. An empty
    table gives no rows. Rows and queries are dealt in tiles by hash; each pair of tiles is one task's work, and of each
    query only a tile's best k leave it. Scores must stay below 2**53.
    """
    rows = cut(quantised(vectors, scale), "rows")
    asked = cut(quantised(vectors.where(asks), scale), "asks")
    spark = vectors.sparkSession
    n, m = rows.count(), asked.count()
    row_tiles = max(-(-n // ROW_TILE), min(-(-n // 1024), 2 * spark.sparkContext.defaultParallelism))
    query_tiles = max(1, -(-m // QUERY_TILE))
    own = lambda df, tiles, salt: df.withColumn("own", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, tiles))).cast("int"))
    met = lambda df, other: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(1, other) - 1))))
    left = met(own(rows, row_tiles, "row"), query_tiles).select(F.col("own").alias("a"), F.col("other").alias("b"), "id", "v")
    right = met(own(asked, query_tiles, "query"), row_tiles).select(F.col("other").alias("a"), F.col("own").alias("b"), "id", "v")

    def arrays(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        mine = np.flatnonzero(v.value_lengths().to_numpy(zero_copy_only=False) == size)
        t = t.take(pa.array(mine))
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)[order].astype(float)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        for size in sorted(set(right.column("v").combine_chunks().value_lengths().to_pylist())):
            (ids, x), (q_ids, q) = arrays(left, size), arrays(right, size)
            if plain_scores(x, q):
                raise OverflowError("scores of these vectors may pass 2**53")
            for i in range(0, len(ids), ROWS):
                lists = sorted_lists(x[i : i + ROWS])
                for j in range(0, len(q_ids), QUERIES):
                    a, b, s = aggregate(x[i : i + ROWS], ids[i : i + ROWS], q[j : j + QUERIES], q_ids[j : j + QUERIES], k, lists)
                    out.append((q_ids[j + a], ids[i + b], s.astype(np.int64)))
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        best = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
        return pa.table({"query_id": a[best], "vec_id": b[best], "score": s[best]})

    tiles = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "query_id long, vec_id long, score long")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", r.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 1024) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
