"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, small_side, table

BITS = 64
#: Rows of a bucket that meet in one kernel call; larger buckets are dealt as pairs of such chunks.
CHUNK = 4096
#: Rows that one group of small buckets holds on average.
GROUP_ROWS = 60_000


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every `words`-word shingle of the lower-cased bytes, repeats included."""
    w = raw.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; no hashes give zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[i : i + 65_536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A shingle counts as often as it stands in the text. Null texts count as
    empty. Rows are taken as they are: repeated doc_ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint_of(shingle_hashes((t.as_py() or "").encode(), words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def pigeonhole_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all ways to choose blocks - radius of the blocks: bits within the radius agree on at least one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(part, blocks - radius)]


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints -> (64, blocks) bit planes: bit l of planes[b, k] is bit b of lane l of block k."""
    out = np.empty((BITS, len(lanes)), np.uint64)
    for b in range(BITS):
        bits = ((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def within(query: np.ndarray, block: np.ndarray, valid: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a block of 64 lanes: the pairs with lanes in the radius, and these lanes.

    Distances of 64 lanes are kept as vertical counters, updated plane by plane with carry-save adders. Counters start
    so that they overflow just beyond the radius; a pair is abandoned once all its lanes have overflowed.
    """
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius
    alive = np.arange(len(query))
    dead = ~valid
    counter = [np.full(len(query), np.uint64(0xFFFFFFFFFFFFFFFF if start >> i & 1 else 0)) for i in range(width)]
    for b in range(BITS):
        carry = planes[b][block] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        dead |= carry
        if b % 8 == 7:
            keep = np.flatnonzero(dead != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(keep) < 0.8 * len(alive) or b == BITS - 1:
                alive, query, block, dead = alive[keep], query[keep], block[keep], dead[keep]
                counter = [c[keep] for c in counter]
    return alive, ~dead


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its set) after joining the sets of u and v."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def bucket_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, batch: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of one key whose fingerprints differ in at most radius bits, each pair once.

    Rows of side 0 meet all of their bucket, unless it has rows of side 1: then they meet those only.
    """
    order = np.lexsort((side, key))
    key, side = key[order], side[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    bucket = np.repeat(np.arange(len(first)), size)
    if not (size > 1).any():
        return
    crossed = np.zeros(len(first), bool)
    crossed[bucket[side == 1]] = True
    rank = np.arange(len(key)) - first[bucket]
    blocks = -(-size // 64)
    offset = np.r_[0, np.cumsum(blocks)]
    block, lane = offset[bucket] + rank // 64, rank % 64
    lanes = np.zeros((offset[-1], 64), np.uint64)
    lanes[block, lane] = fp[order]
    row = np.zeros((offset[-1], 64), np.int64)
    row[block, lane] = np.arange(len(key))
    can = np.zeros((2, offset[-1], 64), np.uint8)
    can[0, block, lane] = ~crossed[bucket] | (side == 1)
    can[1, block, lane] = ~crossed[bucket] | (side == 0)
    can = np.packbits(can, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    planes = planes_of(lanes)
    asks = np.flatnonzero((size[bucket] > 1) & (side == 0))
    begin = block[asks]
    span = offset[bucket[asks] + 1] - begin
    ends = np.cumsum(span)
    at = 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch, "right")))
        q = np.repeat(asks[at:to], span[at:to])
        step = np.arange(len(q)) - np.repeat(np.cumsum(span[at:to]) - span[at:to], span[at:to])
        k = np.repeat(begin[at:to], span[at:to]) + step
        valid = can[side[q], k]
        own = k == block[q]
        bit = np.uint64(1) << lane[q[own]].astype(np.uint64)
        valid[own] &= ~((bit << np.uint64(1)) - np.uint64(1))
        some = np.flatnonzero(valid)
        q, k = q[some], k[some]
        hit, word = within(fp[order[q]], k, valid[some], planes, radius)
        if len(hit):
            p, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield order[q[hit[p]]], order[row[k[hit[p]], bit]]
        at = to


def masked(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """nodes (id, fp, more columns) -> their columns and key: a row for each table's bucket."""
    own, signed = nodes.columns, [m - (1 << 64) if m >> 63 else m for m in masks]
    return nodes.select(*own, F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)))).alias("x")).select(*own, F.xxhash64("x.t", "x.k").alias("key"))


def dealt(rows: DataFrame, total: int) -> DataFrame:
    """rows (key, id, fp, more columns), about total of them -> rows (grp, key, side and the other columns): every bucket
    meets in one grp, or, if it is larger than CHUNK, in one grp for each pair of its chunks."""
    spark, own = rows.sparkSession, [c for c in rows.columns if c != "key"]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // GROUP_ROWS)
    large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "large")
    usual = F.pmod(F.col("key"), F.lit(groups))
    if large.isEmpty():
        return rows.select(usual.alias("grp"), "key", *own, F.lit(0).alias("side"))
    rows = rows.join(small_side(large), "key", "left").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
    met = F.when(F.col("chunks").isNull(), F.array(F.struct(usual.alias("grp"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.xxhash64("key", F.least("c", j), F.greatest("c", j)).alias("grp"), (F.col("c") > j).cast("int").alias("side")))
    )
    return rows.select("key", *own, F.explode(met).alias("x")).select("x.grp", "key", *own, "x.side")


def star_edges(nodes: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """nodes (id, fp) -> (u, v): for each set linked inside a group, every member with the set's first one."""

    def run(t: pa.Table) -> pa.Table:
        key, ids, fp, side = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "id", "fp", "side"))
        label = np.arange(len(ids))
        for u, v in bucket_links(key, fp.view(np.uint64), side, radius):
            label = merge(label, u, v)
        joined = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": ids[joined], "v": ids[label[joined]]})

    return dealt(masked(nodes, masks), nodes.count() * len(masks)).groupBy("grp").applyInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """doc_id, fp, component_id: documents joined by chains of fingerprints that differ in at most radius bits.

    Fingerprints are compared once however many documents share them. component_id is the smallest doc_id of the
    component (null only if all of its doc_ids are null); empty and null texts have fingerprint zero and link like any
    other; an empty table gives no rows; repeated rows each get a row.
    """
    prints = cut(fingerprints(docs, words), "fp")
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    edges = star_edges(firsts.select(F.col("fp").alias("id"), "fp"), pigeonhole_masks(radius, blocks), radius)
    comp = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = firsts.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
