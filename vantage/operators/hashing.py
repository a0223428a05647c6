"""Cascade hashing: random projections give every descriptor a code and a bucket in each of several groups; descriptors that
share a bucket are ranked by their codes, and the nearest few by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .matching import ratio_test, top_hamming_levels


def mean_vector(df: DataFrame) -> list[float]:
    """The mean of the column v (one row for each dimension comes back)."""
    return [r["m"] for r in df.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos").collect()]


def projections(dim: int, groups: int, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Normal random vectors: dim of them for the code, bits for each group."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, dim)), rng.normal(size=(groups * bits, dim))


def cascade_hashes(df: DataFrame, mean: list[float], groups: int = 6, bits: int = 8, seed: int = 0) -> DataFrame:
    """(id, v) -> id, code (a long for each 64 dimensions) and buckets (a number for each group) of v less the mean."""
    dim = len(mean)
    first, second = projections(dim, groups, bits, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) - mean
            signs = np.packbits(v @ first.T > 0, axis=1, bitorder="little")
            signs = np.pad(signs, ((0, 0), (0, -signs.shape[1] % 8)))
            code = np.ascontiguousarray(signs).view(np.int64)
            weight = 1 << np.arange(bits)
            bucket = ((v @ second.T > 0).reshape(-1, groups, bits) * weight).sum(2)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(list(x), pa.list_(k)) for x, k in ((code, pa.int64()), (bucket, pa.int32())))], names=["id", "code", "buckets"])

    return df.select("id", "v").mapInArrow(run, "id long, code array<long>, buckets array<int>")


def build_buckets(hashes: DataFrame) -> DataFrame:
    """grp, bucket, id, code: where each descriptor lies."""
    return hashes.select(F.posexplode("buckets").alias("grp", "bucket"), "id", "code")


def bucket_candidates(queries: DataFrame, elements: DataFrame) -> DataFrame:
    """q, c, ham: elements that share a bucket of any group with a query, once each, with the distance of their codes."""
    a = build_buckets(queries).select("grp", "bucket", F.col("id").alias("q"), F.col("code").alias("cq"))
    b = build_buckets(elements).select("grp", "bucket", F.col("id").alias("c"), F.col("code").alias("cc"))
    ham = F.aggregate(F.zip_with("cq", "cc", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return a.join(b, ["grp", "bucket"]).groupBy("q", "c").agg(F.first(ham).alias("ham"))


def cascade_match(queries: DataFrame, elements: DataFrame, squared_ratio: float, mean: list[float] | None = None, least: int = 6, most: int = 10, **settings) -> DataFrame:
    """i, j, d1, d2: the nearest of each query's best-ranked candidates, by the ratio of squared distances of unit vectors. A
    query of one candidate has none to compare with and no match."""
    mean = mean_vector(queries.select("v").union(elements.select("v"))) if mean is None else mean
    ranked = top_hamming_levels(bucket_candidates(*(cascade_hashes(x, mean, **settings) for x in (queries, elements))), least, most)
    near = ranked.join(queries.select(F.col("id").alias("q"), F.col("v").alias("vq")), "q").join(elements.select(F.col("id").alias("c"), F.col("v").alias("vc")), "c")
    ip = F.aggregate(F.zip_with("vq", "vc", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    r = F.row_number().over(W.partitionBy("q").orderBy(F.desc("ip"), F.desc("c")))
    two = near.select("q", "c", ip.alias("ip")).withColumn("r", r).where("r <= 2").withColumn("d", F.greatest(F.lit(0.0), 2 - 2 * F.col("ip")))
    top = two.groupBy("q").agg(F.max(F.when(F.col("r") == 1, F.col("c"))).alias("i1"), *(F.max(F.when(F.col("r") == k, F.col("d"))).alias(f"d{k}") for k in (1, 2)))
    return ratio_test(top.where("d2 is not null"), squared_ratio)
