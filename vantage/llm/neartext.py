"""Near-duplicate texts by word shingles: shared rare shingles bring texts together, SimHash fingerprints are compared
bit-sliced, and what is left is checked by the exact similarity of the shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, small_side
from .simhash import BITS, bucket_links, fingerprint_of, merge

#: Fingerprints of sets of similarity 0.8 differ in 9.7 of 64 bits on average (each with probability acos(8/9)/pi), beyond
#: this radius with probability 2e-7. Sets under SMALL shingles, of which that doesn't hold, are compared at any distance.
RADIUS, SMALL = 26, 64
#: A shingle of more than COMMON distinct texts stands behind all others in prefixes. Only the LATE most frequent such
#: shingles are kept, which bounds what is broadcast. Both decide how many candidates there are, not which pairs are found.
COMMON, LATE = 32, 1_000_000
#: Shingles that one part counts, prefix hashes that one part compares, and shingles packed at a time.
COUNT_KEYS, PART_KEYS, PACK = 4_000_000, 1_000_000, 1 << 21
#: Texts and shingles of a tile's side; larger families are dealt as several chunks. Rows and shingles of one task on average.
CHUNK, CHUNK_SHINGLES = 256, 1_000_000
GROUP_ROWS, GROUP_SHINGLES = 60_000, 2_000_000
#: Shingle hashes from HALF on are not counted.
HALF = np.uint64(1 << 63)
_STEP, _MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the `words`-word shingles of a text, A-Z lower-cased; of fewer words the whole sequence,
    of none the empty set. Shingles are hashed as polynomials of the XXH64 of their words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(x) - words + 1)
    h = x[:n]
    for i in range(1, min(words, len(x))):
        h = h * _STEP + x[i : i + n]
    for _ in range(2):
        h = (h ^ (h >> _SHIFT)) * _MIX
    return np.unique(h ^ (h >> _SHIFT))


def content_hash(text: str | None) -> int:
    """128 bits of the lower-cased word sequence."""
    return xxhash.xxh3_128_intdigest(b" ".join((text or "").encode().lower().split()))


def codes(h: np.ndarray, parts: int) -> np.ndarray:
    """What a shingle is counted under: its part, and 24 bits of its hash."""
    return (h % np.uint64(parts)) << np.uint64(24) | h >> np.uint64(39) & np.uint64(0xFFFFFF)


def ordered_prefix(h: np.ndarray, similarity: float, late: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the sorted distinct hashes h in an order common to all sets: counted rare ones, uncounted ones, late
    ones, each by size; as the counted rare part and the rest. Any two sets of this similarity share one of theirs,
    whatever `late` holds: they share ceil(similarity * len(h)) hashes at least, the first of which has the others behind it.
    """
    counted = h[: np.searchsorted(h, HALF)]
    other = h[len(counted) :]
    if len(late):
        code = codes(counted, parts)
        common = late[np.minimum(np.searchsorted(late, code), len(late) - 1)] == code
        counted, last = counted[~common], counted[common]
    else:
        last = h[:0]
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1 if len(h) else 0
    return counted[:n], np.concatenate([other, last])[: max(0, n - len(counted))]


def packed(part: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """A row for each value of the sorted `part`, with lists of what belongs to it."""
    start = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
    ends = pa.array(np.r_[start, len(part)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(part[start]), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in values.values())], names=["part", *values])


def flat(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def columns_of(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def common_shingles(docs: DataFrame, words: int, parts: int) -> np.ndarray:
    """Sorted codes of the shingles that more than COMMON distinct texts hold, the LATE most frequent of them.

    Every text is counted. A shingle travels as 24 bits beside 8 bits of its text's content, once for each batch, so that
    copies count once, a frequent shingle costs at most 256 entries a batch, and counts end at 256.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(held))
            return packed((both >> np.uint64(32)).astype(np.int32), seen=(both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))

        for batch in batches:
            for t in batch.column(0):
                h = shingle_set(t.as_py(), words)
                h = h[: np.searchsorted(h, HALF)]
                held.append(codes(h, parts) << np.uint64(8) | np.uint64(content_hash(t.as_py()) & 0xFF))
                size += len(h)
                if size >= PACK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(t: pa.Table) -> pa.Table:
        seen = np.unique(flat(t, "seen").view(np.uint32)) >> np.uint32(8)
        code, n = np.unique(seen, return_counts=True)
        frequent = n > COMMON
        return pa.table({"code": code[frequent].astype(np.int64) + (t.column("part")[0].as_py() << 24), "n": n[frequent]})

    some = cut(docs.select("text").mapInArrow(pack, "part int, seen array<int>").groupBy("part").applyInArrow(count, "code long, n long"), "frequent")
    # Counts end at 256, so the table of how many shingles have each is short; of the last count that has room, a share by hash.
    left, least, edge, share = LATE, 257, -1, 0.0
    for r in some.groupBy("n").count().orderBy(F.desc("n")).collect():
        if r["count"] > left:
            edge, share = r["n"], left / r["count"]
            break
        left, least = left - r["count"], r["n"]
    kept = some.where((F.col("n") >= least) | (F.col("n") == edge) & (F.pmod(F.xxhash64("code"), F.lit(1 << 20)) < share * (1 << 20)))
    return np.sort(kept.select("code").toArrow().column("code").to_numpy()).view(np.uint64)


def fingerprints(docs: DataFrame, words: int, similarity: float, late: np.ndarray, parts: int) -> DataFrame:
    """doc_id, c1 and c2 (the content hash), fp (a bit is set if over half of the distinct shingles have it), m (their
    number), and the two parts of ordered_prefix. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                c, fp, m, first, rest = [], [], [], [], []
                for t in batch.column(1):
                    h, x = shingle_set(t.as_py(), words), content_hash(t.as_py())
                    c.append((x >> 64, x & 0xFFFFFFFFFFFFFFFF))
                    fp.append(fingerprint_of(h))
                    m.append(len(h))
                    a, b = ordered_prefix(h, similarity, late, parts)
                    first.append(a)
                    rest.append(b)
                c = np.array(c, np.uint64).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x).view(np.int64))) for x in (first, rest)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(m, pa.int32()), *lists], names=["doc_id", "c1", "c2", "fp", "m", "prefix", "tail"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, c1 long, c2 long, fp long, m int, prefix array<long>, tail array<long>")


def families(nodes: DataFrame) -> DataFrame:
    """nodes (id, prefix, tail) -> (first, id), distinct: for every hash that several nodes hold, all of them with the
    smallest. Rare hashes meet packed; those of tails, which may be frequent, by partial minima and a join."""
    spark = nodes.sparkSession
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_KEYS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                lists = batch.column(1)
                h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
                part = (h % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                yield packed(part[order], keys=(h[order] >> np.uint64(31)).astype(np.uint32).view(np.int32), ids=ids[order])

    def meet(t: pa.Table) -> pa.Table:
        key, ids = flat(t, "keys"), flat(t, "ids")
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        shared = np.repeat(size > 1, size)
        both = np.unique(np.stack([np.repeat(ids[start], size)[shared], ids[shared]]), axis=1)
        return pa.table({"first": both[0], "id": both[1]})

    rare = nodes.select("id", "prefix").mapInArrow(pack, "part int, keys array<int>, ids array<long>").groupBy("part").applyInArrow(meet, "first long, id long")
    tails = nodes.select("id", F.explode("tail").alias("key"))
    shared = cut(tails.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "tails")
    return rare.union(tails.join(small_side(shared), "key").select("first", "id")).distinct()


def tile_pairs(first: np.ndarray, sub: np.ndarray, side: np.ndarray, ids: np.ndarray, fp: np.ndarray, m: np.ndarray, comp: np.ndarray, similarity: float, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one tile (first, sub) that may reach the similarity, in batches: of different nodes and
    components, of fitting sizes, and within the radius unless one has under SMALL shingles."""
    _, a = np.unique(first, return_inverse=True)
    key = np.unique(a * (1 + sub.max(initial=0)) + sub, return_inverse=True)[1]
    large, little = np.flatnonzero(m >= SMALL), np.flatnonzero(similarity * m < SMALL)
    for rows, r in ((large, radius), (little, BITS)):
        if len(rows):
            for i, j in bucket_links(key[rows], fp[rows].view(np.uint64), side[rows], r):
                i, j = rows[i], rows[j]
                least, most = np.minimum(m[i], m[j]), np.maximum(m[i], m[j])
                keep = (least >= similarity * most - 1e-6) & (ids[i] != ids[j]) & (comp[i] != comp[j])
                if r == BITS:
                    keep &= least < SMALL
                yield i[keep], j[keep]


COLUMNS = ("first", "sub", "side", "id", "fp", "m", "comp")


def similar_stars(rows: DataFrame, docs: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """rows (first, sub, side, id, fp, m, comp, c1) of tiles -> (u, v): stars with the same components as the pairs of each
    tile that reach the similarity. Candidates are found on fingerprints; only texts of nodes with a candidate travel."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows, "tiles")

    def asking(t: pa.Table) -> pa.Table:
        columns = columns_of(t, *COLUMNS)
        has = np.zeros(t.num_rows, bool)
        for i, j in tile_pairs(*columns, similarity, radius):
            has[i] = has[j] = True
        return t.drop_columns("grp").filter(pa.array(has))

    def check(t: pa.Table) -> pa.Table:
        own = [xxhash_high == c for xxhash_high, c in zip((content_hash(x.as_py()) >> 64 for x in t.column("text")), columns_of(t, "c1")[0].view(np.uint64).tolist(), strict=True)]
        t = t.filter(pa.array(own, pa.bool_()))
        columns = columns_of(t, *COLUMNS)
        ids, fp = columns[3], columns[4].view(np.uint64)
        names, at = np.unique(ids, return_index=True)
        place = np.searchsorted(names, ids)
        sets = [shingle_set(t.column("text")[int(k)].as_py(), words) for k in at]
        label = np.arange(len(names))
        for i, j in tile_pairs(*columns, similarity, radius):
            order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
            i, j, done, step = place[i[order]], place[j[order]], 0, 256
            while done < len(i):
                x, y = i[done : done + step], j[done : done + step]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                good = np.zeros(len(x), bool)
                for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                    same = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    good[k] = same >= similarity * (len(sets[p]) + len(sets[q]) - same) - 1e-9
                label = merge(label, x[good], y[good])
                done, step = done + step, min(2 * step, 1 << 14)
        joined = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"u": names[joined], "v": names[label[joined]]})

    types = "first long, sub long, side int, id long, fp long, m int, comp long, c1 long"
    groups = max(least, rows.count() // GROUP_ROWS)
    wanted = cut(rows.withColumn("grp", F.pmod(F.xxhash64("first", "sub"), F.lit(groups))).groupBy("grp").applyInArrow(asking, types), "wanted")
    groups = max(least, (wanted.agg(F.sum("m")).first()[0] or 0) // GROUP_SHINGLES)
    told = docs.select(F.col("doc_id").alias("id"), "text").join(small_side(wanted), "id").withColumn("grp", F.pmod(F.xxhash64("first", "sub", F.lit(1)), F.lit(groups)))
    out = cut(told.groupBy("grp").applyInArrow(check, "u long, v long"), "stars")
    discard(rows)
    discard(wanted)
    return out


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the group) of documents whose group has several rows.

    Groups are chains of texts whose sets of `words`-word shingles have this Jaccard similarity or more. Equal word
    sequences are one node. Any two similar sets share a hash of their prefixes; nodes that share one form families, whose
    fingerprints are compared bit-sliced within the radius (small sets at any distance) and whose candidates are checked on
    whole texts. A family of up to CHUNK nodes is one tile. A larger one first meets its first chunk only; nodes that are
    then not in its largest component meet all others, so nothing is left out and no pair leaves its task.

    Null and empty texts are equal texts. Rows without doc_id take no part. Of a doc_id with several texts the one with the
    smallest content hash stands for it. An empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (12 * COUNT_KEYS))
    prints = cut(fingerprints(docs, words, similarity, common_shingles(docs, words, parts), parts), "prints")
    one = prints.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("c"), F.count(F.lit(1)).alias("rows"))
    again = cut(one.where("rows > 1").select("doc_id", F.col("c.c1").alias("r1"), F.col("c.c2").alias("r2")), "again")
    rows = prints
    if not again.isEmpty():
        rows = prints.join(small_side(again), "doc_id", "left").where("r1 is null or (r1 = c1 and r2 = c2)").drop("r1", "r2")
    nodes = cut(rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), F.min("m").alias("m"), F.first("prefix").alias("prefix"), F.first("tail").alias("tail")), "nodes")
    members = cut(families(nodes).join(nodes.select("id", "fp", "m", "c1"), "id"), "members")
    sizes = members.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("w")).select("first", F.ceil(F.greatest(F.col("n") / CHUNK, F.col("w") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    large = cut(sizes.where("chunks > 1"), "large")
    dealt = members.join(small_side(large), "first", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), "chunks").cast("int"))
    fields = ["first", F.col("x.sub").cast("long").alias("sub"), F.col("x.side").cast("int").alias("side"), "id", "fp", "m"]
    place = F.when(F.col("chunk") > 0, F.array(F.struct(F.col("chunk").alias("sub"), F.lit(1).alias("side")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(j.alias("sub"), F.lit(0).alias("side"))))
    links = similar_stars(dealt.withColumn("x", F.explode(place)).select(*fields, F.col("id").alias("comp"), "c1"), docs, words, similarity, radius)
    comp = cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id")), "groups")
    if not large.isEmpty():
        open_ = cut(dealt.where("chunks > 1").join(comp, "id", "left").withColumn("comp", F.coalesce("group_id", "id")).drop("group_id"), "open")
        main = open_.groupBy("first", "comp").count().groupBy("first").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
        main = cut(main.where("most < all").select("first", "main", F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int").alias("outer")), "main")
        if not main.isEmpty():
            open_ = open_.join(small_side(main), "first")
            asks = open_.where("comp <> main").withColumn("a", F.pmod(F.xxhash64("id", F.lit(6)), "outer"))
            asks = asks.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct((F.col("a") * F.col("chunks") + j).alias("sub"), F.lit(0).alias("side")))))
            told = open_.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct((i * F.col("chunks") + F.col("chunk")).alias("sub"), F.lit(1).alias("side")))))
            more = similar_stars(asks.select(*fields, "comp", "c1").unionByName(told.select(*fields, "comp", "c1")), docs, words, similarity, radius)
            links = links.union(more)
            comp = cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id")), "groups")
    copies = nodes.join(comp, "id", "left").where("n > 1 or group_id is not null").select("c1", "c2", F.coalesce("group_id", "id").alias("group_id"))
    return rows.select("doc_id", "c1", "c2").join(copies, ["c1", "c2"]).select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id. Rows equal in doc_id and text stay once, all rows
    without doc_id stay, columns stay as they are."""
    groups = cut(near_duplicate_groups(docs, **settings), "found")
    gone = cut(groups.where("doc_id <> group_id").select("doc_id").distinct(), "gone")
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    kept = docs.join(small_side(gone), "doc_id", "left_anti")
    if not again.isEmpty():
        twice = small_side(again)
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)
