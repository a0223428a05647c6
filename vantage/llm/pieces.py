"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, worker_store

MARK = "▁"
#: A run of markers with the characters up to the next marker; a run at the end stands alone.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+\\Z")
#: The most frequent chunks, up to this number and length, are broadcast with their ids.
COMMON_CHUNKS, COMMON_CHARS = 200_000, 64
#: Ids below this are shared objects in a worker's table.
NUMBERS = 1 << 16
#: Distinct chunks that a task counts before it hands them on.
HELD_CHUNKS = 200_000


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def read_model(path: str | None) -> bytes:
    if path is None:
        return public_model()
    with open(os.fspath(path), "rb") as f:
        return f.read()


def check_model(model: bytes) -> None:
    """Raise ValueError unless chunks can be segmented one by one: a BPE model without normalisation, that puts a marker
    first, keeps white space, has no user-defined pieces and no piece with a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n, t = m.normalizer_spec, m.trainer_spec
    crossing = [p.piece for p in m.pieces if p.type == 1 and MARK in p.piece.lstrip(MARK)]
    if t.model_type != 2 or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces) or crossing:
        raise ValueError("this model's pieces may cross chunks")


def chunks_of(text: str | None) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The library's processor, kept by the worker from task to task."""
    kept = worker_store().get("pieces")
    if kept is None or kept[0] != model:
        kept = worker_store()["pieces"] = (model, sentencepiece.SentencePieceProcessor(model_proto=model))
    return kept[1]


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """chunk, n: every distinct chunk of the texts and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(chunks_of(t.as_py()))
                if len(seen) >= HELD_CHUNKS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def least_count(chunks: DataFrame, most: int) -> int:
    """The least count n that at most `most` chunks reach: from how many chunks have each count, without sorting them."""
    left, least = most, 2**62
    for r in chunks.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # a row for each count
        left -= r["count"]
        if left < 0:
            break
        least = r["n"]
    return least


def segmented(chunks: DataFrame, model_path: str | None = None) -> DataFrame:
    """chunk, n and more columns -> with ids: each chunk segmented once."""
    model = read_model(model_path)
    check_model(model)
    sent = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(sent.value)
        for batch in batches:
            ids = [segment(sp, c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "n", "ids"])

    return chunks.select("chunk", "n").mapInArrow(run, "chunk string, n long, ids array<int>")


def segment(sp: sentencepiece.SentencePieceProcessor, chunk: str) -> list[int]:
    # The library puts the first marker back, but not before nothing.
    return [sp.piece_to_id(MARK)] if chunk == MARK else sp.encode(chunk[1:])


def known_chunks(sent) -> dict[str, list[int]]:
    """The broadcast table of common chunks as a dictionary, kept by the worker while it serves the same table."""
    kept = worker_store().get("chunks")
    if kept is None or kept[0] != sent["id"]:
        worker_store().pop("chunks", None)
        kept, numbers = None, worker_store().setdefault("numbers", list(range(NUMBERS)))
        table: dict[str, list[int]] = {}
        for batch in pa.ipc.open_stream(sent["data"]):
            for at in range(0, batch.num_rows, 5_000):  # small steps, so that few numbers stand beside the shared ones
                part = batch.slice(at, 5_000)
                for chunk, ids in zip(part.column("chunk").to_pylist(), part.column("ids").to_pylist(), strict=True):
                    table[chunk] = [numbers[i] if i < NUMBERS else i for i in ids]
        kept = worker_store()["chunks"] = (sent["id"], table)
    return kept[1]


def _coded(docs: DataFrame, common: pa.Table, model: bytes, whole: bool) -> DataFrame:
    """doc_id and ids; whole: chunks that are not common are segmented where they stand, and the decoding of ids follows;
    else they are left out, and the gaps follow: k1 and k2 (a hash of the text), at (places in ids) and gaps (the chunks)."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, common.schema) as writer:
        writer.write_table(common)
    # At most COMMON_CHUNKS chunks of COMMON_CHARS characters, with their ids.
    sent = docs.sparkSession.sparkContext.broadcast({"id": uuid.uuid4().hex, "data": sink.getvalue().to_pybytes(), "model": model})
    tail = "decoded string" if whole else "k1 long, k2 long, at array<int>, gaps array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(sent.value["model"])
        known = known_chunks(sent.value).get
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # small steps bound the lists of ids
                part = batch.slice(start, 500)
                rows, more = [], []
                for text in part.column(1):
                    text, ids, at, gaps = text.as_py(), [], [], []
                    for chunk in chunks_of(text):
                        got = known(chunk)
                        if got is not None:
                            ids += got
                        elif whole:
                            ids += segment(sp, chunk)
                        else:
                            at.append(len(ids))
                            gaps.append(chunk)
                    rows.append(ids)
                    if whole:
                        more.append((sp.decode(ids),))
                    else:
                        h = xxhash.xxh3_128_intdigest((text or "").encode()) if gaps else 0
                        more.append((*np.array([h >> 64, h & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist(), at, gaps))
                kinds = [pa.string()] if whole else [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.int32())), *(pa.array([m[i] for m in more], k) for i, k in enumerate(kinds))], names=["doc_id", "ids", *(["decoded"] if whole else ["k1", "k2", "at", "gaps"])])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, ids array<int>, {tail}")


def encode_decode(docs: DataFrame, model_path: str | None = None, join_rest: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the model's ids of the whole text, without begin or end ids, and the library's
    decoding of these ids.

    A table holds the distinct chunks of all texts by their counts. The most frequent ones, at most COMMON_CHUNKS and of at most
    COMMON_CHARS characters, are segmented once and broadcast with their ids, so that frequent chunks meet in no join.
    Rarer ones are segmented where they stand, or with join_rest once each too, and their ids are joined back by text and
    position; both ways give the same ids. Null and empty texts give an empty array and an empty string; rows are
    taken as they are, and an empty table gives no rows. The model's content (a fixed few hundred KB) travels with the job,
    so executors need no file.
    """
    model = read_model(model_path)
    docs = docs.select("doc_id", "text")
    chunks = cut(distinct_chunks(docs), "chunks")
    short = chunks.where(F.length("chunk") <= COMMON_CHARS)
    common = segmented(short.where(F.col("n") >= least_count(short, COMMON_CHUNKS)), model_path).select("chunk", "ids").toArrow()
    if not join_rest or chunks.count() <= common.num_rows:
        return _coded(docs, common, model, True)
    chunks = cut(segmented(chunks, model_path), "segmented")
    coded = cut(_coded(docs, common, model, False), "coded")
    gaps = coded.where(F.size("gaps") > 0).select("k1", "k2", "gaps").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.posexplode("gaps").alias("i", "chunk"))
    filled = gaps.join(chunks.select("chunk", F.col("ids").alias("own")), "chunk").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("i", "own"))).alias("filled"))
    whole = coded.where(F.size("gaps") > 0).join(filled, ["k1", "k2"]).select("doc_id", "ids", "at", F.col("filled.own").alias("filled"))
    rest = coded.where(F.size("gaps") == 0).select("doc_id", "ids", F.array().cast("array<int>").alias("at"), F.array().cast("array<array<int>>").alias("filled"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for ids, at, filled in zip(*(part.column(c).to_pylist() for c in ("ids", "at", "filled")), strict=True):
                    row, last = [], 0
                    for place, own in zip(at, filled, strict=True):
                        row += ids[last:place]
                        row += own
                        last = place
                    out.append(row + ids[last:])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(pa.int32())), pa.array([sp.decode(x) for x in out], pa.string())], names=["doc_id", "ids", "decoded"])

    return whole.unionByName(rest).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, as encode_decode gives them."""
    return encode_decode(docs, model_path).select("doc_id", "ids")


def decode(coded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null ids count as an empty array."""
    sent = coded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sp.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
