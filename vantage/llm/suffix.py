"""Repeated passages by an enhanced suffix array.

A window is a string of `length` bytes. Every window has an anchor: the GRAM-byte string in it of the smallest hash. Equal
windows have equal anchors, so windows may be dealt by the anchor's hash. Runs of windows that share an anchor travel as one
segment, and only if the anchor's hash is found more than once in the corpus. A suffix array over the distinct segments of an
anchor finds the maximal repeats; of each, every occurrence but the first goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

GRAM = 24
#: Windows of a piece that hashes are computed for at once, and bytes of segments that share one suffix array.
PIECE, ARRAY_BYTES = 1 << 19, 1 << 20
NO_ID = (1 << 63) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, put together from those of 8 and 16 bytes."""
    h, base, n = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while n < 16:
        eight, base8 = (h, base) if n == 8 else (None, None)
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base & 0xFFFFFFFFFFFFFFFF, 2 * n
    return mixed(h[:-8] * np.uint64(base8) + eight[16:])


def anchored_runs(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of the runs of windows of b that share an anchor. Windows number below 2**20."""
    h = gram_hashes(b)
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, n = length - GRAM + 1, 1
    while 2 * n <= span:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if span > n:
        key = np.minimum(key[: n - span], key[span - n :])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[first] >> np.uint64(20)).astype(np.int64), first, np.diff(np.r_[first, len(key)])


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc, t, text) -> h, doc, t, x: the runs of all documents. x packs the first window (from bit 18), the number of
    windows (from bit 2) and two flags, `led` (2) and `twice` (1).

    Of the runs of one batch with the same h only the first is to be routed by h, and `twice` tells whether there were
    others, which are `led`; so a very frequent anchor sends one row from each batch to its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts, pieces, total = [], [], 0

            def flush(pieces: list) -> None:
                if not pieces:
                    return
                b = np.concatenate([p[2] for p in pieces])
                start = np.cumsum([0] + [len(p[2]) for p in pieces])
                h, at, n = anchored_runs(b, length)
                cut = np.unique(np.concatenate([at, start[:-1], start[1:] - length + 1]))
                cut = cut[(cut >= 0) & (cut <= len(b) - length)]
                own = np.searchsorted(at, cut, "right") - 1
                n = np.diff(np.r_[cut, len(b) - length + 1])
                p = np.searchsorted(start, cut, "right") - 1
                inside = cut + length <= start[p + 1]
                rows = np.array([q[0] for q in pieces])[p]
                off = np.array([q[1] for q in pieces])[p]
                parts.append(np.stack([h[own], rows, cut - start[p] + off, n])[:, inside])  # noqa: B023

            for i, x in enumerate(batch.column(2)):
                raw = np.frombuffer((x.as_py() or "").encode(), np.uint8)
                for at in range(0, len(raw) - length + 1, PIECE):
                    piece = raw[at : at + PIECE + length - 1]
                    if pieces and total + len(piece) > PIECE:
                        flush(pieces)
                        pieces, total = [], 0
                    pieces.append((i, at, piece))
                    total += len(piece)
            flush(pieces)
            if not parts:
                continue
            h, row, a, n = np.concatenate(parts, axis=1)
            _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(h), bool)
            lead[first] = True
            x = a << 18 | n << 2 | np.where(lead, 0, 2) | (count[back] > 1)
            for s in range(0, len(h), 200_000):
                k = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h[k], doc[row[k]], t[row[k]], x[k])], names=["h", "doc", "t", "x"])

    return docs.mapInArrow(run, "h long, doc long, t int, x long")


def repeated(runs: DataFrame) -> DataFrame:
    """doc, t, x of the runs whose anchor is found more than once; x packs the first window (from bit 16) and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None

        def packed(t: pa.Table | pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
            doc, u, x = (t.column(c).to_numpy()[: len(keep)][keep] for c in ("doc", "t", "x"))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(u), pa.array(x >> 2)], names=["doc", "t", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            x = t.column("x").to_numpy()
            h = np.where(x & 2, -1, t.column("h").to_numpy())
            same = (h[1:] == h[:-1]) & (h[1:] != -1)
            stay = (x & 1 == 1) | np.r_[h[0] != -1 and h[0] == before, same] | np.r_[same, False]
            held = t.slice(len(h) - 1).to_batches()[0]
            before = h[-2] if len(h) > 1 else before
            yield packed(t, stay[:-1])
        if held is not None:
            x, h = held.column("x")[0].as_py(), held.column("h")[0].as_py()
            yield packed(held, np.array([bool(x & 1) or (not x & 2 and h == before)]))

    led = F.col("x").bitwiseAND(F.lit(2)) != 0
    dealt = runs.repartition(F.when(led, F.xxhash64("doc", "x")).otherwise(F.col("h"))).sortWithinPartitions(led, "h")
    return dealt.mapInArrow(run, "doc long, t int, x long")


def segments(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """h, content, doc, t, a, size: the bytes of the runs. Of equal bytes in a batch only the first run carries them; the
    others, known to be later ones, have null content."""
    lists = found.groupBy("doc", "t").agg(F.collect_set("x").alias("runs"))
    both = docs.join(lists, ["doc", "t"]).select("doc", "t", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict = {}
            rows: list = []
            doc, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (text, runs) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                raw, x = text.as_py().encode(), np.sort(runs.values.to_numpy())
                a, n = x >> 16, x & 0xFFFF
                b, h = np.frombuffer(raw, np.uint8), np.empty(len(a), np.int64)
                for at in range(0, len(raw) - length + 1, PIECE):
                    mine = slice(*np.searchsorted(a, (at, at + PIECE)))
                    if mine.start < mine.stop:
                        key, first_of, _ = anchored_runs(b[at : at + PIECE + length - 1], length)
                        h[mine] = key[np.searchsorted(first_of, a[mine] - at, "right") - 1]
                for p, k, g in zip(a.tolist(), n.tolist(), h.tolist(), strict=True):
                    piece, ref = raw[p : p + k + length - 1], (doc[i], t[i], p)
                    old = first.get(piece)
                    if old is None:
                        first[piece] = (ref, g)
                    elif ref < old[0]:
                        rows.append((g, None, old[0], len(piece)))
                        first[piece] = (ref, g)
                    elif ref > old[0]:
                        rows.append((g, None, ref, len(piece)))
            rows += [(g, p, ref, len(p)) for p, (ref, g) in first.items()]
            del first
            for s in range(0, len(rows), 20_000):
                part = rows[s : s + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), *(pa.array([r[2][i] for r in part], k) for i, k in enumerate([pa.int64(), pa.int32(), pa.int64()])), pa.array([r[3] for r in part], pa.int32())], names=["h", "content", "doc", "t", "a", "size"])

    return both.mapInArrow(run, "h long, content binary, doc long, t int, a long, size int")


def window_classes(b: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal windows of b, in the windows' order: a suffix array's ranks, doubled up to `length` bytes."""
    n, size = len(b) - length + 1, 8
    wide = np.concatenate([b, np.zeros(8, np.uint8)])
    rank = np.zeros(len(b), np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | wide[i : i + len(b)].astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)
        pair = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    return rank[:n]


def maximal_repeats(contents: list[bytes], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, [(content, place), ...]): the strings of `length` bytes and more that repeat in the contents and can't be made
    longer on either side without losing an occurrence, each with all its occurrences.

    Windows are ordered by suffix ranks. A class of equal windows that all stand behind the same byte lies in the class
    of its left neighbours, with all repeats below it, and is passed over. The other classes are sorted as suffixes; a
    stack over their common-prefix lengths yields the nested intervals, of which those of diverse left bytes are maximal.
    The ends of a content count as a byte of their own.
    """
    sizes = np.array([len(c) for c in contents])
    start = np.cumsum(np.r_[0, sizes])
    b = np.frombuffer(b"".join(contents), np.uint8)
    if len(b) < length:
        return
    at = np.arange(len(b) - length + 1)
    owner = np.searchsorted(start, at, "right") - 1
    at = at[at + length <= start[owner + 1]]
    rank = window_classes(b, length)[at]
    order = np.lexsort((at, rank))
    at, rank = at[order], rank[order]
    first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    size = np.diff(np.r_[first, len(at)])
    head = np.isin(at, start)
    left = np.where(head, -1 - at, b[np.maximum(at, 1) - 1].astype(np.int64))
    diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    for g in np.flatnonzero((size > 1) & diverse):
        own = at[first[g] : first[g] + size[g]]
        where = np.searchsorted(start, own, "right") - 1
        suffix = sorted((contents[c][p - start[c] :], int(c), int(p - start[c])) for p, c in zip(own, where, strict=True))
        common = [0]
        for (x, *_), (y, *_) in zip(suffix, suffix[1:], strict=False):
            m = length
            while m < min(len(x), len(y)) and x[m] == y[m]:
                m += 1
            common.append(m)
        common.append(0)
        stack: list[tuple[int, int]] = []  # (common prefix, first of the interval)
        for i in range(1, len(common)):
            begin = i - 1
            while stack and stack[-1][0] > common[i]:
                shared, begin = stack.pop()
                inside = suffix[begin:i]
                if len({contents[c][p - 1] if p else (c,) for _, c, p in inside}) > 1:
                    yield shared, [(c, p) for _, c, p in inside]
            if common[i] and (not stack or stack[-1][0] < common[i]):
                stack.append((common[i], begin))


def spans(pieces: DataFrame, length: int) -> DataFrame:
    """doc, t, at, size: the spans to remove. Rows of an anchor come together, equal contents behind one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        lists: list = []  # the distinct contents, with their first places, of anchors that have several
        own: list = []
        held, anchor = 0, None

        def solve() -> None:
            group = [x for g in lists for x in g]
            refs = [x[1] for x in group]
            for size, places in maximal_repeats([x[0] for x in group], length):
                where = [(refs[c][0], refs[c][1], refs[c][2] + p) for c, p in places]
                least = min(where)
                out.extend((*w, size) for w in where if w != least)

        def packed(rows: list) -> pa.RecordBatch:
            x = np.array(rows, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i]), k) for i, k in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=["doc", "t", "at", "size"])

        for batch in batches:
            for h, content, doc, t, a, size in zip(*(batch.column(c).to_pylist() for c in ("h", "content", "doc", "t", "a", "size")), strict=True):
                if content is None:
                    out.append((doc, t, a, size))
                    continue
                if h != anchor:
                    if len(own) > 1:
                        lists.append(own)
                        held += sum(len(x[0]) for x in own)
                    own, anchor = [], h
                    if held > ARRAY_BYTES:
                        solve()
                        lists.clear()
                        held = 0
                if own and own[-1][0] == content:
                    if (doc, t, a) != own[-1][1]:
                        out.append((doc, t, a, size))
                else:
                    own.append((content, (doc, t, a)))
            if len(out) > 50_000:
                yield packed(out)
                out = []
        if len(own) > 1:
            lists.append(own)
        if lists:
            solve()
        yield packed(out)

    route = F.when(F.col("content").isNull(), F.xxhash64("doc", "a")).otherwise(F.col("h"))
    return pieces.repartition(route).sortWithinPartitions("h", "content", "doc", "t", "a").mapInArrow(run, "doc long, t int, at long, size long")


def drop_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row.

    Removed is every byte that a string of `length` bytes covers which also starts earlier: in a smaller doc_id or
    earlier in the text. All is judged on the input; matches never cross texts. Null texts count as empty. Rows
    without doc_id come after all others. Rows of one doc_id with other texts are ordered by a hash of the text, and
    its equal rows are one document, whose rows get the same result. An empty table gives no rows.
    """
    # The text's hash joins with doc_id, so rows that share a doc_id stay apart.
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).alias("t"), text.alias("text"))
    # Whole copies are found by a 128-bit hash; only the first of them is looked into, of the others all bytes go.
    whole = cut(keyed.select("doc", "t", F.octet_length("text").alias("size"), F.xxhash64("text").alias("w1"), F.xxhash64(F.lit("w"), "text").alias("w2")).where(F.col("size") >= length), "whole")
    copies = whole.groupBy("size", "w1", "w2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = cut(whole.join(copies, ["size", "w1", "w2"]).where("doc > first").select("doc", "t").distinct(), "later")
    found = repeated(anchors(keyed.join(later, ["doc", "t"], "left_anti").select("doc", "t", "text"), length))
    gone = spans(segments(found, keyed, length), length).groupBy("doc", "t").agg(F.collect_set(F.struct("at", "size")).alias("gone"))
    both = keyed.join(gone, ["doc", "t"], "left").join(later.withColumn("copy", F.lit(True)), ["doc", "t"], "left").select("doc", "text", "gone", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows = []
                for text, gone, copy in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                    raw, gone = text.as_py().encode(), gone.as_py()
                    if copy.as_py():
                        rows.append((len(raw), len(raw), 1, b""))
                        continue
                    if not gone:
                        rows.append((len(raw), 0, 0, raw))
                        continue
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, [g["at"] for g in gone], 1)
                    np.add.at(change, [g["at"] + g["size"] for g in gone], -1)
                    out = np.cumsum(change[:-1]) > 0
                    n = int(out.sum())
                    rows.append((len(raw), n, int(out[0]) + int((out[1:] & ~out[:-1]).sum()), np.frombuffer(raw, np.uint8)[~out].tobytes()))
                doc = batch.column(0)
                doc = pa.array([None if x == NO_ID else x for x in doc.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, *(pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
