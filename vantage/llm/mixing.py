"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small_side, table

#: Blocks of near-equal words that each source's permuted documents form, and rows of a block on average: sources of more
#: than their product form more blocks, by powers of two.
BLOCKS, BLOCK_ROWS = 512, 100_000
#: Units of the splitting tree that are ordered in one task on average; more are split in strata of sources.
STRATUM = 500_000
#: Output shards, a power of two: the tree halves them level by level.
SHARDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def permuted(name: str = "mix") -> Column:
    """A row's place in its source's permutation; equal for rows of equal doc_id, text and source."""
    return F.xxhash64(F.lit(name), "doc_id", "text", "source")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, perm (the row's place in its source's permutation), perm2 (more bits that tell rows apart) and
    block (its block by perm)."""
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), permuted().alias("perm"), permuted("mix2").alias("perm2")), "sized")
    large = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCKS * BLOCK_ROWS)
    large = cut(large.select(F.col("source").alias("s"), F.ceil(F.log2(F.col("n") / (BLOCKS * BLOCK_ROWS))).cast("int").alias("more")), "large")
    bits = F.lit((BLOCKS - 1).bit_length())
    if not large.isEmpty():
        # One row for each BLOCKS * BLOCK_ROWS rows of docs at most.
        rows = rows.join(F.broadcast(large), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        bits = bits + F.coalesce("more", F.lit(0))
    block = F.call_function("shiftrightunsigned", F.col("perm"), F.lit(64) - bits)
    return rows.select("doc_id", "source", "size", "perm", "perm2", block.alias("block"))


def source_targets(per_source: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with weight and target: the share of all words by weight, no source above `most` times
    its size, what is above dealt to the others by weight until none is above (a water level over the sources).

    Sources are ordered by code point, null last; the weights repeat. The table has one row for each source.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("words", F.sum("source_size").over(everything) * F.lit(float(share)))
    fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("words") - before) / behind)
    s = s.withColumn("level", F.max(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, units) -> source, shard, first, upto: the units [first, upto) of the source's sequence go to the shard.

    A node of the tree holds the units of all sources that its shards share. Its left half draws half of them without
    replacement: units of the node are ordered by a hash anew at each level and the lower half goes left, so the
    sources' counts there are multivariate hypergeometric and add up to the node's exactly. Only unit numbers, BLOCKS
    for each source and epoch, are handled here, never documents. Beyond STRATUM units, sources are dealt in strata by
    hash and each stratum of a node is split on its own, so that no task orders all units.
    """
    strata = 1 + (quotas.agg(F.sum("units")).first()[0] or 0) // STRATUM
    unit = quotas.where("units > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit")).withColumn("node", F.lit(0).cast("long")).withColumn("stratum", F.pmod(F.xxhash64("source"), F.lit(strata)))
    for level in range(shards.bit_length() - 1):
        own = W.partitionBy("node", "stratum")
        at = F.row_number().over(own.orderBy(F.xxhash64(F.lit(f"level{level}"), "source", "unit"), "source", "unit")) - 1
        half = F.floor((F.count(F.lit(1)).over(own) + F.pmod(F.col("node") + F.col("stratum"), F.lit(2))) / 2)
        unit = unit.select("source", "unit", "stratum", (F.col("node") * 2 + (at >= half).cast("long")).alias("node"))
    got = unit.groupBy("source", F.col("node").cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    run = W.partitionBy("source").orderBy("shard")
    upto = F.sum("n").over(run)
    return got.select("source", "shard", (upto - F.col("n")).alias("first"), upto.alias("upto"))


def plan(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = SHARDS) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, copies.

    copies is an array of (epoch, shard, place), one for each time that the mix takes the document; taken is size
    times their number, at most `most` rounded up times the size. A source's words are taken epoch by epoch in blocks of its permuted
    documents; of the last block, documents are taken in order while they fit whole, and then the one document of the
    source that comes nearest to what is still missing. Shards draw disjoint runs of blocks (split_quotas) and
    place orders a shard's rows. All draws are hashes of the rows: reruns agree. Null sources form one source, last;
    null texts have size 0 and are taken with their block; an empty table gives no rows; a repeated row is permuted like any other.
    """
    rows = sized(docs)
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, most)
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    targets = cut(targets, "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    b = blocks.join(targets, same(blocks, targets)).select(blocks["source"], "block", "words", "source_size", "target", "full", "rest")
    run = W.partitionBy("source").orderBy("block")
    b = b.withColumn("before", F.sum("words").over(run) - F.col("words")).withColumn("index", F.row_number().over(run) - 1)
    b = cut(b.withColumn("touched", F.col("before") < F.col("rest")), "blocks")
    units = b.groupBy("source").agg((F.max("full") * F.count(F.lit(1)) + F.count_if("touched")).cast("int").alias("units"), F.count(F.lit(1)).cast("int").alias("in_source"))
    runs = split_quotas(units, shards)
    epochs = b.select("source", "block", "before", "words", "source_size", "target", "rest", "full", "touched", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"), "index").where("epoch < full or touched")
    epochs = epochs.join(units.select(F.col("source").alias("s"), "in_source"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("unit", F.col("epoch") * F.col("in_source") + F.col("index"))
    r = runs.select(F.col("source").alias("s"), "shard", "first", "upto")
    placed = epochs.join(r, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") >= F.col("first")) & (F.col("unit") < F.col("upto")))
    placed = placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("copies"))
    b = b.join(placed.select(F.col("source").alias("s"), F.col("block").alias("k"), "copies"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")), "left").select(F.col("source").alias("s"), F.col("block").alias("k"), "source_size", "target", "full", "rest", "before", "touched", "copies")
    out = rows.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    ahead = F.col("before") + F.coalesce(F.sum("size").over(W.partitionBy("source", "block").orderBy("perm", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("copies", F.coalesce("copies", F.array().cast("array<struct<epoch:int,shard:int>>"))).withColumn("ahead", ahead)
    last = F.col("touched") & (F.col("ahead") + F.col("size") <= F.col("rest"))
    taken = F.filter("copies", lambda c: (c["epoch"] < F.col("full")) | last)
    out = cut(out.select("doc_id", "source", "size", "source_size", "target", "full", "perm", "perm2", "block", "ahead", taken.alias("copies")), "taken")
    gap = out.groupBy("source").agg((F.first("target") - F.sum(F.size("copies") * F.col("size"))).alias("gap"))
    near = out.where((F.size("copies") == F.col("full")) & (F.col("full") < most)).join(gap.select(F.col("source").alias("s"), "gap"), F.col("source").eqNullSafe(F.col("s")))
    near = near.groupBy("s").agg(F.first("gap").alias("gap"), F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "perm", "block", "ahead", "doc_id", "size")).alias("best"))
    near = near.where((F.col("best.off") < F.col("gap"))).select("s", F.col("best.perm").alias("p"), F.col("best.ahead").alias("a"), F.col("best.size").alias("z"))
    out = out.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.col("perm") == F.col("p")) & (F.col("ahead") == F.col("a")) & (F.col("size") == F.col("z")), "left")
    more = F.array(F.struct(F.col("full").alias("epoch"), F.pmod(F.col("perm"), F.lit(shards)).cast("int").alias("shard")))
    taken = F.when(F.col("p").isNotNull(), F.concat("copies", more)).otherwise(F.col("copies"))
    copies = F.transform(taken, lambda c: F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"), F.xxhash64(c["shard"], c["epoch"], F.col("perm")).alias("place")))
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), "copies", "perm", "perm2")


def mix(docs: DataFrame, places: bool = True, **settings) -> DataFrame:
    """The mixed corpus: docs' rows, each as often as the plan takes it, with mix_epoch, mix_shard and mix_place (with
    underscores behind them where docs has such columns; without them if places is off).

    Rows of a shard are in mix_place's order; write with repartition("mix_shard").sortWithinPartitions("mix_place").
    Rows equal in doc_id, text and source are taken as often as the plan takes them together, with the other columns of one.
    """
    own = ["epoch", "shard", "place"]
    copy, key = fresh("mix_copy", docs.columns), [fresh("mix_perm", docs.columns), fresh("mix_perm2", docs.columns)]
    copies = cut(plan(docs, **settings).where(F.size("copies") > 0).select(*(F.col(x).alias(k) for x, k in zip(("perm", "perm2"), key, strict=True)), F.col("copies").alias(copy)), "copies")
    again = cut(copies.groupBy(*key).count().where("count > 1").select(*key), "again")
    keyed = docs.withColumn(key[0], permuted()).withColumn(key[1], permuted("mix2"))
    if again.isEmpty():
        out = keyed.join(copies, key).withColumn(copy, F.explode(copy))
    else:
        twice = small_side(again)
        once = keyed.join(copies.join(twice, key, "left_anti"), key).withColumn(copy, F.explode(copy))
        more = copies.join(twice, key).withColumn(copy, F.explode(copy))
        out = once.unionByName(keyed.join(twice, key, "left_semi").dropDuplicates(key).join(more, key))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{copy}.{c}").alias(fresh(f"mix_{c}", docs.columns)) for c in own if places))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
