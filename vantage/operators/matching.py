"""Descriptor matching: nearest neighbours in tiles, ratio and mutual tests, hashing candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TILE = 4096
#: Rows of one product of a tile.
ROWS = 512


def int16_descriptor(v: Column) -> Column:
    return F.transform(v, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 127))


def uint16_descriptor(v: Column) -> Column:
    """Values from 0 to 1 as whole numbers from 0 to 255."""
    return F.transform(v, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(0.0)) * 255))


def nearest_two(queries: DataFrame, elements: DataFrame, kind: str = "float") -> DataFrame:
    """(id, v) and (id, v) -> q, i1, d1, i2, d2: the two elements of the largest inner product, ties to the later id.

    kind "float": squared distance max(0, 2 - 2 ip); "int16": 32258 - 2 ip with ip in [0, 16129]; "uint16": 2 min(32767,
    65025 - ip). Negative inner products
    never win: their place holds id 0 at inner product 0. Both sides are dealt in tiles by hash; a pair of tiles is a
    matrix product of one task, and only two elements of each query leave it.
    """
    n, m = elements.count(), queries.count()
    a, b = max(1, -(-n // TILE)), max(1, -(-m // TILE))
    tile = lambda df, k, salt: df.select("id", "v", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int").alias("t"))
    left = tile(queries, b, "q").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).select("id", "v", F.col("t").alias("q"), F.col("o").alias("e"))
    right = tile(elements, a, "e").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).select("id", "v", F.col("o").alias("q"), F.col("t").alias("e"))

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "ip": pa.array([], pa.float64())})
        if not q.num_rows or not e.num_rows:
            return empty
        (qi, qv), (ei, ev) = arrays(q), arrays(e)
        order = np.argsort(-ei, kind="stable")
        out = []
        for at in range(0, len(qi), ROWS):
            ip = qv[at : at + ROWS] @ ev[order].T
            own = np.arange(len(ip))
            for _ in range(min(2, len(ei))):
                # The first of equal ones is that of the largest id.
                best = ip.argmax(1)
                out.append(pa.table({"q": qi[at : at + ROWS], "i": ei[order][best], "ip": ip[own, best]}))
                ip[own, best] = -np.inf
        return pa.concat_tables(out)

    found = left.groupBy("q", "e").cogroup(right.groupBy("q", "e")).applyInArrow(run, "q long, i long, ip double").where("ip >= 0")
    r = F.row_number().over(W.partitionBy("q").orderBy(F.desc("ip"), F.desc("i")))
    two = found.withColumn("r", r).where("r <= 2").groupBy("q").agg(*(F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("i", "ip")))
    all_q = queries.select(F.col("id").alias("q")).join(two, "q", "left")
    d = {"float": lambda c: F.greatest(F.lit(0.0), 2 - 2 * c), "int16": lambda c: 32258 - 2 * F.least(c, F.lit(16129.0)), "uint16": lambda c: 2 * F.greatest(F.lit(0.0), F.least(F.lit(32767.0), 65025 - c))}[kind]
    return all_q.select("q", *(x for k in (1, 2) for x in (F.coalesce(f"i{k}", F.lit(0)).alias(f"i{k}"), d(F.coalesce(F.col(f"ip{k}"), F.lit(0.0))).alias(f"d{k}"))))


def ratio_test(top: DataFrame, squared_ratio: float, squared_distance: float = float("inf")) -> DataFrame:
    """Matches (i, j) whose nearest one is much nearer than the second, and not too far."""
    top = top.where(F.col("d1") <= squared_distance) if squared_distance < float("inf") else top
    return top.where(F.col("d1") <= F.lit(squared_ratio) * F.col("d2")).select(F.col("q").alias("i"), F.col("i1").alias("j"), "d1", "d2")


def mutual(m12: DataFrame, m21: DataFrame) -> DataFrame:
    """Pairs (i, j) that are matched in both directions."""
    return m12.select("i", "j").join(m21.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])


def combine(first: DataFrame, second: DataFrame, offset_i: int, offset_j: int) -> DataFrame:
    return first.select("i", "j").unionByName(second.select((F.col("i") + offset_i).alias("i"), (F.col("j") + offset_j).alias("j")))


def sign_hash(v: Column, bits: int, dim: int) -> Column:
    """Bit k is set if component k exceeds component (7 k + 3) mod dim: a projection that needs no random numbers."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.when(v[k % dim] > v[(7 * k + 3) % dim], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def top_hamming_levels(ranked: DataFrame, least: int = 6, most: int = 10) -> DataFrame:
    """(q, c, ham): whole levels of Hamming distance until there are `least` candidates, `most` at the most."""
    level = W.partitionBy("q").orderBy("ham")
    before = F.count(F.lit(1)).over(level.rangeBetween(W.unboundedPreceding, -1))
    place = F.row_number().over(W.partitionBy("q").orderBy("ham", "c"))
    return ranked.withColumn("b", before).withColumn("r", place).where((F.col("b") < least) & (F.col("r") <= most)).drop("b", "r")


def lowres_matches(first: DataFrame, second: DataFrame, rank: str, most: int, squared_ratio: float, kind: str = "float") -> DataFrame:
    """Mutual matches of the `most` rows of the largest `rank` of each side (id, v and rank; ties to the smaller id): the gate
    in front of a full match."""
    some = [x.orderBy(F.desc(rank), "id").limit(most).select("id", "v") for x in (first, second)]
    return mutual(*(ratio_test(nearest_two(a, b, kind), squared_ratio) for a, b in (some, some[::-1])))
