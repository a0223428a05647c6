"""Sharding by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, dense_position, discard, small_side, table

LAW = "rows"
#: Rows that are sorted together when positions are given out.
BUCKET_ROWS = 20_000


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and the 128-bit text hash (g1, g2) of each row, with its permutation hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.md5(F.encode(text, "UTF-8"))
    out = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("g1"), F.conv(F.substring(h, 16, 15), 16, 10).cast("long").alias("g2"))
    return out.withColumn("perm", F.xxhash64(F.lit("shard"), "doc_id", "g1", "g2"))


def propagate(linked: DataFrame, quota: float, shards: int, rounds: int) -> DataFrame:
    """Rows of groups (g1, g2) of two and more -> with label: their shard after some rounds of label propagation.

    A row moves to the label that most of its group's rows have, weighted by the room left there. Where more want in
    than there is room, the same share of each is let in, by hash; so no shard's order of all its rows is needed.
    """
    now = linked.withColumn("label", F.pmod(F.xxhash64(F.lit("start"), "perm"), F.lit(shards)).cast("int"))
    room = F.broadcast  # of a table of `shards` rows
    for k in range(rounds):
        cells = now.groupBy("g1", "g2", "label").agg(F.count(F.lit(1)).alias("n"))
        load = now.sparkSession.range(shards).select(F.col("id").cast("int").alias("label")).join(now.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("label", F.greatest(F.lit(0.0), 1 - F.coalesce("n", F.lit(0)) / F.lit(quota)).alias("free"))
        score = F.struct((F.col("n") * (F.col("free") + 1e-6)).alias("s"), F.xxhash64("g1", "g2", "label").alias("h"), "label")
        wish = cut(cells.join(room(load), "label").groupBy("g1", "g2").agg(F.max(score).alias("best")).select("g1", "g2", F.col("best.label").alias("to")), "wish")
        # One row for each group; a hot group's rows are not gathered by it where it is broadcast, and split by AQE where not.
        wanting = now.join(small_side(wish), ["g1", "g2"])
        asked = wanting.where("to <> label").groupBy("to").agg(F.count(F.lit(1)).alias("asked"))
        share = asked.join(room(load), F.col("to") == F.col("label")).select("to", F.least(F.lit(1.0), F.col("free") * quota / F.col("asked")).alias("let_in"))
        moves = (F.pmod(F.xxhash64(F.lit(k), "perm"), F.lit(1_000_000)) < F.col("let_in") * 1_000_000) & (F.col("to") != F.col("label"))
        new = wanting.join(room(share), "to", "left").withColumn("label", F.when(F.coalesce(moves, F.lit(False)), F.col("to")).otherwise(F.col("label"))).select(*now.columns)
        new = cut(new, "labels")
        discard(now)
        now = new
    return now


def shard(docs: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row: shards whose counts are at most one apart.

    Rows of equal texts are linked; label propagation under each shard's quota brings them together, so that few groups
    are cut (those larger than a shard must be). Rows without links fill the shards up to their exact counts. slot is
    the row's gapless place in its shard. Null texts count as empty, so they and empty texts are one group; an
    empty table gives no rows; a repeated row is one more row. grown_shard is null, as the law is `rows`.
    """
    rows = cut(numbered(docs), "rows")
    total = rows.count()
    buckets = max(8, total // BUCKET_ROWS)
    groups = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = small_side(cut(groups, "groups"))
    linked = cut(rows.join(groups, ["g1", "g2"]), "linked")
    single = rows.join(groups.select("g1", "g2"), ["g1", "g2"], "left_anti")
    labels = propagate(linked, max(1, total) / shards, shards, rounds)
    quota = [total // shards + (i < total % shards) for i in range(shards)]
    limit = F.array(*(F.lit(q) for q in quota))
    # Rows of a group stand together in a label's order; those of a group beyond BUCKET_ROWS in several parts.
    placed = dense_position(labels, ["label"], [F.col("perm"), F.col("doc_id")], F.struct("g1", "g2", F.pmod("perm", F.ceil(F.col("members") / BUCKET_ROWS))), max(4, buckets // shards), "at")
    placed = cut(placed.withColumn("shard", F.when(F.col("at") < F.element_at(limit, F.col("label") + 1), F.col("label"))).drop("at", "label", "members"), "placed")
    held = {r["shard"]: r["n"] for r in placed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # `shards` rows
    ends, sum_ = [], 0
    for i, q in enumerate(quota):
        sum_ += q - held.get(i, 0)
        ends.append(sum_)
    free = single.select(*rows.columns).unionByName(placed.where("shard is null").select(*rows.columns))
    free = dense_position(free, [], [F.col("perm"), F.col("doc_id")], F.col("perm"), buckets, "at")
    free = free.withColumn("shard", F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("at")))).drop("at")
    done = placed.where("shard is not null").select(*rows.columns, "shard").unionByName(free.select(*rows.columns, "shard"))
    done = dense_position(cut(done, "done"), ["shard"], [F.col("perm"), F.col("doc_id")], F.col("perm"), max(4, buckets // shards), "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
