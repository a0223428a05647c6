"""Line dedup by probing a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPACE = " \t\n\v\f\r"
#: Keys of a shard of the hash, and bytes of arrays that one pass over the documents may broadcast.
SHARD_KEYS, PASS_BYTES = 50_000, 96 << 20
LEVELS = 40


def keys_of(lines: list[str], min_chars: int) -> tuple[list[int], np.ndarray]:
    """The places of the lines whose stripped form has min_chars code points, and the 128-bit hashes of their keys."""
    at, h = [], []
    for i, line in enumerate(lines):
        k = line.strip(SPACE)
        if len(k) >= min_chars:
            at.append(i)
            h.append(xxhash.xxh3_128_digest(k.encode().lower()))
    return at, np.frombuffer(b"".join(h), ">u8").reshape(-1, 2).astype(np.uint64)


def spread(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash of 64-bit numbers: level by level, numbers that fall alone on a bit keep it; a bit's rank is the index."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        self.start = np.r_[0, np.cumsum(sizes)]
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        parts, sizes, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("equal numbers can't be told apart")
            n = -(-2 * len(left) // 64)
            at = (spread(left, len(sizes) + 1) % np.uint64(64 * n)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * n) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(n)
            left = left[~alone[at]]
        return cls(np.concatenate([*parts, np.empty(0, np.uint64)]), np.array(sizes, np.int64))

    def index(self, x: np.ndarray) -> np.ndarray:
        """The index of each number that was hashed; -1 or any index for others."""
        out, todo = np.full(len(x), -1, np.int64), np.arange(len(x))
        for level, n in enumerate(self.sizes):
            at = (spread(x[todo], level + 1) % np.uint64(64 * n)).astype(np.int64)
            word, bit = self.start[level] + at // 64, (at % 64).astype(np.uint64)
            w = self.words[word]
            hit = (w >> bit & np.uint64(1)).astype(bool)
            low = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[word[hit]] + low
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class Shard:
    """A shard's hash with its arrays: fingerprint, count and last doc_id of each line."""

    def __init__(self, row: dict) -> None:
        a = lambda k, t: np.frombuffer(row[k], t)
        self.hash = PerfectHash(a("words", np.uint64), a("sizes", np.int64))
        self.print, self.count, self.last = a("print", np.uint64), a("count", np.uint32), a("last", np.int64)

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in the shard, and its index."""
        i = self.hash.index(lo)
        return (i >= 0) & (self.print[i] == hi), i


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """hi, lo, n, last: how many documents hold each line, and the largest doc_id of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, found = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = keys_of((t.as_py() or "").split("\n"), min_chars)[1]
                    h = np.unique(h, axis=0) if len(h) > 1 else h
                    found.append(h)
                    ids += [i] * len(h)
                h = np.ascontiguousarray(np.concatenate([*found, np.empty((0, 2), np.uint64)]).T).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ids, pa.int64())], names=["hi", "lo", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "hi long, lo long, doc_id long").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def hash_shards(counts: DataFrame) -> DataFrame:
    """(hi, lo, n, last) -> one row for each shard: its perfect hash and arrays as binaries, and their bytes."""
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def run(t: pa.Table) -> pa.Table:
        s, hi, lo, n, last = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("shard", "hi", "lo", "n", "last"))
        h = PerfectHash.build(lo.view(np.uint64))
        order = np.argsort(h.index(lo.view(np.uint64)))
        blobs = {"words": h.words, "sizes": h.sizes, "print": hi.view(np.uint64)[order], "count": np.minimum(n[order], 2**32 - 1).astype(np.uint32), "last": last[order]}
        raw = {k: v.tobytes() for k, v in blobs.items()}
        return pa.table({"shard": pa.array([s[0]], pa.int32()), "bytes": pa.array([sum(map(len, raw.values()))], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in raw.items()})

    keyed = counts.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(run, "shard int, bytes long, words binary, sizes binary, print binary, count binary, last binary"), shards


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with text rewritten, and n_lines and n_dropped (in place of columns of these names).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of min_chars code points and more
    that at least min_docs rows hold stay in the rows of the largest doc_id only (in all rows if none of these has a
    doc_id). Null and empty texts are one empty line; a text whose lines all go becomes empty; repeated rows count as
    documents; an empty table stays empty. Lines are hashed to 128 bits. The arrays of the repeated lines are sent to
    the documents: one pass if they have at most pass_bytes, else a pass over the documents for each such part.
    """
    counts = cut(line_counts(docs, min_chars).where((F.col("n") >= min_docs) & F.col("last").isNotNull()), "lines")
    made, shards = hash_shards(counts)
    made = cut(made, "shards")
    passes, room = [[]], pass_bytes
    for r in made.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if passes[-1] and r["bytes"] > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(r["shard"])
        room -= r["bytes"]
    plain = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "__drops")]
    out = docs.select(*plain, F.lit(None).cast("array<int>").alias("__drops"))
    for k, own in enumerate(passes):
        arrays = [r.asDict() for r in made.where(F.col("shard").between(own[0], own[-1])).collect()] if own else []  # at most pass_bytes and a shard
        out = _probe(out, docs.sparkSession.sparkContext.broadcast(arrays), shards, min_chars, k == len(passes) - 1)
        out = out if k == len(passes) - 1 else cut(out, "pass")
    return out


def _probe(docs: DataFrame, sent, shards: int, min_chars: int, last_pass: bool) -> DataFrame:
    names = [c for c in docs.columns if c != "__drops"]
    at_id, at_text = names.index("doc_id"), names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {r["shard"]: Shard(r) for r in sent.value}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = [(t.as_py() or "").split("\n") for t in batch.column(at_text)]
                found = [keys_of(t, min_chars) for t in texts]
                size = np.array([len(x[0]) for x in found], np.int64)
                row, place = np.repeat(np.arange(len(texts)), size), np.fromiter((i for x in found for i in x[0]), np.int64)
                h = np.concatenate([*(x[1] for x in found), np.empty((0, 2), np.uint64)])
                ids = batch.column(at_id).cast(pa.int64())
                no_id, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
                shard = np.mod(h[:, 0].view(np.int64) if h.flags["F_CONTIGUOUS"] else np.ascontiguousarray(h[:, 0]).view(np.int64), shards)
                drop = np.zeros(len(row), bool)
                for s, a in arrays.items():
                    mine = np.flatnonzero(shard == s)
                    hit, i = a.probe(h[mine, 0], h[mine, 1])
                    mine, i = mine[hit], i[hit]
                    drop[mine] = (a.last[i] != ids[row[mine]]) | no_id[row[mine]]
                drops = [set(x.as_py() or ()) for x in batch.column(len(names))]
                for r, p in zip(row[drop].tolist(), place[drop].tolist(), strict=True):
                    drops[r].add(p)
                columns = [batch.column(i) for i in range(len(names))]
                if last_pass:
                    columns[at_text] = pa.array(["\n".join(x for i, x in enumerate(t) if i not in d) if d else "\n".join(t) for t, d in zip(texts, drops, strict=True)], batch.column(at_text).type)
                    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(d) for d in drops], pa.int64())]
                else:
                    columns.append(pa.array([sorted(d) for d in drops], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["n_lines", "n_dropped"] if last_pass else ["__drops"])])

    return docs.mapInArrow(run, fields + (", n_lines long, n_dropped long" if last_pass else ", __drops array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
n AS (SELECT *, translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT n.doc_id, n.i, n.line, coalesce(r.last <> n.doc_id, false) AS gone FROM n LEFT JOIN r ON n.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
