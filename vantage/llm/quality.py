"""Quality classifier: naive Bayes support vectors over byte n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FEATURE_BITS = 17
#: Labelled documents that the model is fitted on, at most: those of the smallest hashes of doc_id.
MAX_TRAIN = 6_000
THRESHOLD = 0.3


def remainder(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def features(text: str | None) -> np.ndarray:
    """The distinct hashed 3- and 4-grams of the lower-cased bytes of a whole text, with a space before and behind."""
    b = np.frombuffer(b" " + (text or "").encode().lower() + b"  ", np.uint8).astype(np.uint32)
    on = np.zeros(1 << FEATURE_BITS, bool)
    for at in range(0, len(b) - 3, 1 << 20):  # long texts in overlapping parts
        x = b[at : at + (1 << 20) + 3]
        three = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
        for g in (three, three | x[3:] << np.uint32(24)):
            on[((g + np.uint32(0x3C6EF35F)) * np.uint32(2654435761) + (np.uint32(0) if g is three else np.uint32(0x9E3779B9))) >> np.uint32(32 - FEATURE_BITS)] = True
    return np.flatnonzero(on).astype(np.int32)


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """Weights, slope and shift: score = sigmoid(slope * sum(weights[features]) / sqrt(n features) + shift).

    Indicators are scaled by the log-count ratios of the two classes, a hinge-loss model is fitted to them by dual
    coordinate descent on four fifths of the rows, and a logistic curve maps the margins of the rest to probabilities.
    """
    dim, y = 1 << FEATURE_BITS, np.where(np.asarray(y) > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(dim), 0.0, 0.0 if not len(y) else 4.0 * y[0]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    if abs(y[own].sum()) == len(own) or abs(y[held].sum()) == len(held):
        held = own = order
    counts = {s: np.full(dim, 1.0) for s in (1.0, -1.0)}
    for i in own:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    ratio[(counts[1.0] == 1) & (counts[-1.0] == 1)] = 0
    norm = np.array([max(1, len(r)) ** -0.5 for r in rows])
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(y))
    square = np.array([(ratio[r] ** 2).sum() for r in rows]) * norm**2 + 1
    for _ in range(epochs):
        for i in rng.permutation(own):
            r = rows[i]
            x = ratio[r] * norm[i]
            g = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    weights = w * ratio
    m = np.array([weights[rows[i]].sum() * norm[i] + bias for i in held])
    t = (y[held] > 0) * (1 - 2 / (len(held) + 2)) + 1 / (len(held) + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        q = p * (1 - p) + 1e-6
        grad = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        a, b = float(np.clip(a, 0.1, 50)), float(np.clip(b, -50, 50))
    return weights, a, a * bias + b


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float, float]:
    """The model of at most max_train labelled documents that are not held out. Null labels, null doc_ids and labels
    without a document are left out; of a repeated doc_id the least text counts; without both classes the score is a constant."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))], names=["doc_id", "quality", "f"])

    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"), "text").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    got = found.mapInArrow(run, "doc_id long, quality int, f array<int>").toArrow().combine_chunks().sort_by("doc_id")
    f = got.column("f").combine_chunks()
    rows = np.split(f.flatten().to_numpy(zero_copy_only=False), np.cumsum(f.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if got.num_rows else []
    return fit(rows, got.column("quality").to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """docs' columns and quality_score (in place of a column of this name): from 0 to 1, higher the likelier label 1.
    Null texts count as empty; rows are taken as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float64), *model[1:]))
    plain = docs.select(*(c for c in docs.columns if c != "quality_score"))
    fields, at = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, slope, shift = sent.value
        for b in batches:
            p = np.empty(b.num_rows)
            for i, t in enumerate(b.column(at)):
                f = features(t.as_py())
                p[i] = slope * w[f].sum() / max(1, len(f)) ** 0.5 + shift
            p = 1 / (1 + np.exp(-np.clip(p, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "quality_score"])

    return plain.mapInArrow(run, f"{fields}, quality_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
