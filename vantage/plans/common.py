"""What several operators share: the shared folder, lineage cuts, ranks without a global sort, components."""

from __future__ import annotations

import re
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Where tests and single machines keep cut lineage when spark.checkpoint.dir is unset.
FALLBACK_DIR = "/tmp/checkpoints/vantage"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, FALLBACK_DIR on one machine and an
    error on a cluster, whose executors don't share local folders."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return own or FALLBACK_DIR


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vantage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing will read again."""
    path = getattr(df, "_vantage_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if its counted rows are at most max_rows, else df for a shuffle join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def dense_position(df: DataFrame, by: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Add name: a gapless position from 0 among the rows of equal `by`, without sorting a whole group in one task.

    Rows fall in `buckets` by a hash of `spread`; small counts of the buckets give each bucket's offset and only
    a bucket's own rows are sorted together. Equal keys of one bucket take the order of `order`.
    """
    b, n, off, r = (f"__{name}_{x}" for x in ("b", "n", "off", "r"))
    df = df.withColumn(b, F.pmod(F.xxhash64(spread, F.lit(name)), F.lit(buckets)))
    sizes = df.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    sizes = sizes.withColumn(off, F.sum(n).over(W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1)) if by else F.sum(n).over(W.orderBy(b).rowsBetween(W.unboundedPreceding, -1)))
    sizes = sizes.select(*by, b, F.coalesce(off, F.lit(0)).alias(off))
    ranked = df.withColumn(r, F.row_number().over(W.partitionBy(*by, b).orderBy(*order)) - 1)
    joined = ranked.join(sizes, [*by, b])
    return joined.withColumn(name, (F.col(r) + F.col(off)).cast("long")).drop(b, off, r)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, component): the smallest node reachable, for each node that has an edge.

    Alternating large-star and small-star rounds until the edges are stars: every node has one smaller neighbour or none,
    and no node has both smaller and larger ones. A hub's edges meet in no single task:
    minima are partial aggregates and the joins may be split by adaptive execution.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(hooked.union(small_low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def worker_store() -> dict:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("_vantage_store", types.ModuleType("_vantage_store")).__dict__
