"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, worker_store
from .quality import remainder

#: Units of a layer, and the longest sequence in bytes; longer words are cut between characters.
HIDDEN, STEPS = 16, 96
#: Documents of a language that the network learns from, at most.
DOCS_PER_LANG = 300
#: Words whose results a worker keeps before it starts anew.
TABLE_WORDS = 400_000
LETTER = re.compile(r"[^\W\d_]")


def windows(word: bytes) -> list[bytes]:
    """The word with a space before and behind, cut between characters into sequences of at most STEPS bytes."""
    w, out, at = b" " + word + b" ", [], 0
    while len(w) - at > STEPS:
        to = at + STEPS
        while to > at + STEPS - 4 and w[to] & 0xC0 == 0x80:
            to -= 1
        out.append(w[at:to])
        at = to
    return [*out, w[at:]]


def padded(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major byte numbers and a mask."""
    n = np.array([len(s) for s in seqs])
    x = np.frombuffer(b"".join(s.ljust(n.max(), b"\0") for s in seqs), np.uint8).reshape(-1, n.max())
    return np.ascontiguousarray(x.T), np.arange(n.max())[:, None] < n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over the languages at every byte."""

    def __init__(self, langs: list[str], p: dict[str, np.ndarray] | None = None, key: str | None = None, seed: int = 3) -> None:
        rng, h, k = np.random.default_rng(seed), HIDDEN, len(langs)
        self.langs, self.key = langs, key or uuid.uuid4().hex
        if p is not None:
            self.p = p
            return
        self.p = {"out": rng.normal(0, 0.1, (2 * h, k)), "bias": np.zeros(k)}
        for d in "fb":
            self.p |= {f"{d}x": rng.normal(0, 0.3, (256, 3 * h)), f"{d}u": rng.normal(0, h**-0.5, (h, 3 * h)), f"{d}c": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def walk(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte in direction d; where the mask is off the state stands still."""
        wx, u, c, h = self.p[f"{d}x"], self.p[f"{d}u"], self.p[f"{d}c"], HIDDEN
        s = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, r = wx[x[t]] + c, s @ u
            zr = sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, g = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + g * r[:, 2 * h :])
            new = np.where(mask[t][:, None], (1 - z) * n + z * s, s)
            if keep is not None:
                keep.append((t, s, z, g, n, r[:, 2 * h :]))
            s = out[t] = new
        return out

    def log_probs(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        o = np.concatenate([self.walk(d, x, mask) for d in "fb"], axis=2) @ self.p["out"] + self.p["bias"]
        o -= o.max(2, keepdims=True)
        return o - np.log(np.exp(o).sum(2, keepdims=True))

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy at all bytes, by backpropagation through time."""
        h, kept = HIDDEN, {"f": [], "b": []}
        states = np.concatenate([self.walk(d, x, mask, kept[d]) for d in "fb"], axis=2)
        o = states @ self.p["out"] + self.p["bias"]
        o = np.exp(o - o.max(2, keepdims=True))
        d_o = o / o.sum(2, keepdims=True)
        d_o[:, np.arange(len(y)), y] -= 1
        d_o *= (mask / mask.sum())[:, :, None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tbh,tbk->hk", states, d_o, optimize=True)
        g["bias"] = d_o.sum((0, 1))
        d_s = d_o @ self.p["out"].T
        for i, d in enumerate("fb"):
            u, back = self.p[f"{d}u"], np.zeros((x.shape[1], h), np.float32)
            for t, s, z, r, n, un in reversed(kept[d]):
                m = mask[t][:, None]
                total = back + d_s[t][:, i * h : (i + 1) * h]
                own = np.where(m, total, 0)
                d_n = own * (1 - z) * (1 - n * n)
                d_z = own * (s - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n], axis=1)
                d_h = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(g[f"{d}x"], x[t], d_a)
                g[f"{d}c"] += d_a.sum(0)
                g[f"{d}u"] += s.T @ d_h
                back = np.where(m, own * z, total) + d_h @ u.T
        return g

    def fit(self, seqs: list[bytes], y: np.ndarray, steps: int = 500, batch: int = 384, rate: float = 0.01, seed: int = 4) -> None:
        """Adam on batches that hold as many sequences of each language."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            own = np.concatenate([rng.choice(b, batch // len(by) + 1) for b in by])
            g = self.gradient(*padded([seqs[i] for i in own]), y[own])
            lr = rate * (1 - step / (steps + 1))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


class WordTable:
    """Each distinct word goes through the network once; a document pools the bytes of all its words."""

    def __init__(self, net: Network) -> None:
        self.net, self.at, self.used = net, {}, 0
        self.sums = np.zeros((1024, len(net.langs)))
        self.size = np.zeros(1024)

    def learn(self, words: list[bytes]) -> None:
        if self.used > TABLE_WORDS:
            self.at, self.used = {}, 0
        need = self.used + len(words)
        if need > len(self.sums):
            self.sums, self.size = (np.concatenate([a[: self.used], np.zeros((2 * need - self.used, *a.shape[1:]))]) for a in (self.sums, self.size))
        words.sort(key=len)
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            cut = [windows(w) for w in part]
            seqs, owner = [s for c in cut for s in c], np.repeat(np.arange(len(part)), [len(c) for c in cut])
            got = np.zeros((len(part), self.sums.shape[1]))
            for j in range(0, len(seqs), 4096):
                x, mask = padded(seqs[j : j + 4096])
                np.add.at(got, owner[j : j + 4096], (self.net.log_probs(x, mask) * mask[:, :, None]).sum(0))
            self.sums[self.used : self.used + len(part)] = got
            self.size[self.used : self.used + len(part)] = [len(w) + 2 for w in part]
            self.at |= {w: self.used + k for k, w in enumerate(part)}
            self.used += len(part)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """The mean log probability of each language over all bytes of each text."""
        split = [t.encode().split() for t in texts]
        if new := {w for ws in split for w in ws if w not in self.at}:
            if self.used + len(new) > TABLE_WORDS:
                new = {w for ws in split for w in ws}
                self.at, self.used = {}, 0
            self.learn(list(new))
        out = np.zeros((len(texts), self.sums.shape[1]))
        for i, ws in enumerate(split):
            if ws:
                k = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
                out[i] = self.sums[k].sum(0) / self.size[k].sum()
        return out


def train(docs: DataFrame, learn, docs_per_lang: int = DOCS_PER_LANG) -> Network | None:
    """The network of at most docs_per_lang documents of each language, those of the smallest hashes, and of all distinct
    words of their whole texts. learn: a condition.

    Null languages, null texts and texts without words are left out; of a repeated doc_id all rows are learnt from; None
    if nothing is left.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h")).distinct()
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("h", "doc_id")) <= docs_per_lang
    # The smallest of each of 64 parts of a language, then the smallest of those.
    some = rows.withColumn("part", F.pmod("h", F.lit(64))).withColumn("own", first("lang", "part")).where("own")
    pick = some.withColumn("own", first("lang")).where("own").select("doc_id", "lang")
    words = docs.join(F.broadcast(pick), ["doc_id", "lang"]).select("lang", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("w")).where("w <> ''").distinct()
    pairs = sorted({(s, k) for k, w in zip(*(c.to_pylist() for c in words.toArrow().columns), strict=True) for s in windows(w.encode())})
    if not pairs:
        return None
    langs = sorted({k for _, k in pairs})
    net = Network(langs)
    net.fit([s for s, _ in pairs], np.array([langs.index(k) for _, k in pairs]))
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for each row: the language of the largest pooled probability, ties to the first by name.

    Texts that are null or have no letter, and all texts if there is no network, give `und` with score 0.
    """
    # Plain arrays, so that workers need no copy of the package to read them.
    sent = docs.sparkSession.sparkContext.broadcast(net and (net.langs, net.p, net.key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Network(*sent.value)
        kept = worker_store().get("words")
        if model is not None and (kept is None or kept.net.key != model.key):
            kept = worker_store()["words"] = WordTable(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t.as_py() or "" for t in b.column(1)]
                known = [i for i, t in enumerate(texts) if model is not None and LETTER.search(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    p = np.exp(kept.pooled([texts[i] for i in known]))
                    p /= p.sum(1, keepdims=True)
                    for i, best, row in zip(known, p.argmax(1), p, strict=True):
                        lang[i], score[i] = model.langs[best], float(row[best])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, remainder(F.col("doc_id"), 3) != 1)
    return identify(docs, net).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
