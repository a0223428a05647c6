"""Training-data operators against brute force, on edge cases and on the small tables."""

import hashlib
import os
import random
import subprocess
import sys
import zlib

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
import xxhash
from conftest import SF
from oracle import compare
from pyspark.sql import functions as F

from vantage.llm import embedding, language, lines, mixing, neartext, pieces, quality, registry, sharding, simhash, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string, n_dropped string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(spark, empty=False):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    rows = [(1, "The cat sat on the mat.", "en"), (2, "the CAT sat on the mat.", "en"), (3, None, None), (4, "", "en"), (5, " \t\n", "de"), (6, LONG, "en"), (7, LONG + " end", "en"), (8, "Ünïcode ▁ mark  double\r\n" * 30, "de"), (8, "Ünïcode ▁ mark  double\r\n" * 30, "de"), (9, "1234 5678", None), (None, "no id, a line of its own\nno id, a line of its own", "en"), (10, "a" * 500, "fr")]
    rows += [(20 + i, f"A shared line of enough characters\nown {i}\n  a SHARED line of enough characters ", "en") for i in range(5)]
    rows = [(i, t, k, None if i in (3, 6) else f"s{(i or 0) % 3}", None, "x", "y", "z") for i, t, k in rows]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    parent, ids = {i: i for i in docs}, sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(parent, i)) for i in docs}


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 15])
def test_bit_sliced_links(radius, monkeypatch):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fp = np.array([base[i % 6] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 18), replace=False))) for i in range(400)])
    key, side = rng.integers(0, 4, 400), np.zeros(400, int)
    side[(key == 3) & (np.arange(400) % 2 == 0)] = 1
    got = {(min(i, j), max(i, j)) for u, v in simhash.bucket_links(key, fp, side, radius, batch=256) for i, j in zip(u.tolist(), v.tolist())}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= radius and (key[i] != 3 or side[i] != side[j])}
    assert got == want


def test_simhash_large_buckets_and_edges(spark, monkeypatch):
    docs = documents(spark)
    plain = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr)
    monkeypatch.setattr(simhash, "CHUNK", 2)
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr) == plain
    assert len(plain) == docs.count()
    assert next(c for i, f, c in plain if i == 4) == 3 and next(c for i, f, c in plain if i == 2) == 1
    assert simhash.simhash_components(documents(spark, empty=True)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            changed = list(words)
            changed[rng.randrange(300)] = "other"
            rows.append((10 * k + c, " ".join(changed)))
    rows += [(1000, rows[0][1].upper()), (1001, None), (1002, ""), (None, rows[0][1])]
    kept = [r["doc_id"] for r in neartext.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in kept if x is not None) == [10 * k for k in range(12)] + [1001] and kept.count(None) == 1


def test_near_duplicates_differ_in_repetition(spark):
    rng = random.Random(11)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:20] * 30 + words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neartext.drop_near_duplicates(docs).collect()) == list(range(0, 40, 2))


def test_near_duplicates_just_above_the_similarity(spark):
    rng = random.Random(17)
    rows, similar = [], 0
    while similar < 400:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        changed = list(words)
        for at in rng.sample(range(len(words)), round(len(words) / rng.uniform(38, 55))):
            changed[at] = f"x{rng.randrange(5000)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, changed))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * similar, " ".join(words)), (2 * similar + 1, " ".join(changed))]
            similar += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in neartext.drop_near_duplicates(docs).collect()}
    assert sum(2 * k + 1 not in got for k in range(400)) == 400 and got == set(range(0, 800, 2))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m = int(rng.integers(1, 200))
        h = np.unique(rng.integers(0, 2**64, m, dtype=np.uint64))
        other = np.unique(np.r_[rng.permutation(h)[: rng.integers(0, m + 1)], rng.integers(0, 2**64, m // 8, dtype=np.uint64)])
        late = np.unique(neartext.codes(rng.choice(np.r_[h, other], rng.integers(0, m + 1), replace=False), 7))
        same = len(np.intersect1d(h, other))
        if same >= 0.8 * (len(h) + len(other) - same):
            x, y = (neartext.ordered_prefix(z, 0.8, late, 7) for z in (h, other))
            assert len(np.intersect1d(x[0], y[0])) or len(np.intersect1d(x[1], y[1]))


def test_shingle_sets():
    plain = lambda t, k: len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) if (w := t.lower().split()) else 0
    rng = random.Random(4)
    for t in [None, "", " \t", "One", "a b c d", "A b C d E", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(300))) for _ in range(20))]:
        assert len(neartext.shingle_set(t, 5)) == plain(t or "", 5)
    assert np.array_equal(neartext.shingle_set("One two\nTHREE", 5), neartext.shingle_set("one  two three", 5))


def test_near_duplicates_check_every_candidate(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for doc in range(50):
        # Runs of variants that share most words, so that many candidates lie nearer than the true partner.
        words = [f"w{i}" for i in range(60)] if not rows or rng.random() < 0.2 else rng.choice(rows)[1].split()
        for _ in range(rng.choice([1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((doc, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    want = list(range(len(rows)))
    for u in range(len(rows)):
        for v in range(u):
            if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
                a, b = sorted((want[u], want[v]))
                want = [a if w == b else w for w in want]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, neartext.near_duplicate_groups(docs).collect()))
    assert len(set(want)) > 5 and [got.get(d, d) for d, _ in rows] == want
    # Many chunks a family, frequent shingles, and fingerprints that are compared within the radius.
    for name, value in (("CHUNK", 4), ("COMMON", 2), ("SMALL", 1), ("LATE", 7), ("PACK", 100), ("GROUP_ROWS", 5), ("GROUP_SHINGLES", 500)):
        monkeypatch.setattr(neartext, name, value)
    assert dict(map(tuple, neartext.near_duplicate_groups(docs).collect())) == got


def test_near_duplicates_edges(spark):
    docs = documents(spark)
    out = neartext.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 3, 6, 8, 9, 10, 20, 21, 22, 23, 24, None], key=str)
    assert neartext.drop_near_duplicates(documents(spark, empty=True)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "other words that stand under one id"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(neartext.drop_near_duplicates(twice).collect()) in ([(1, "a b c d e f"), (1, "other words that stand under one id")], [(1, "a b c d e f"), (1, "other words that stand under one id"), (2, "A b c d e f")])


def test_embedding_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 16))
    rows = [(i, v[i % 20] * (1 + i) + 0.05 * rng.normal(size=16) * (i >= 20), i % 2) for i in range(40)]
    rows = [(i, [float(y) for y in x], k) for i, x, k in rows] + [(50, None, 1), (51, [0.0] * 16, 1), (52, [float("nan")] * 16, 1), (53, [None] * 16, 1), (54, rows[0][1].tolist(), None), (55, [1.0], 0), (56, [], 0), (57, rows[0][1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(x) / np.linalg.norm(x), k) for i, x, k in rows if k is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    links = {i: [j for j in good if j != i and good[j][1] == good[i][1] and len(good[j][0]) == len(good[i][0]) and good[i][0] @ good[j][0] >= 0.93] for i in good}
    parent = {r[0]: r[0] for r in rows}
    for i in links:
        for j in links[i]:
            x, y = find(parent, i), find(parent, j)
            parent[max(x, y)] = min(x, y)
    want = sorted((i, len(links.get(i, [])), find(parent, i), find(parent, i) == i) for i in parent)
    for chunk in (4096, 3):
        monkeypatch.setattr(embedding, "CHUNK", chunk)
        assert sorted(map(tuple, embedding.near_links(df).collect())) == want
    assert embedding.near_links(df.limit(0)).count() == 0


def test_topk_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(120)] + [(200, None), (300, [None] * 5), (400, [float("inf")] * 5), (121, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    x = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = [(q, r + 1, c, s) for q in sorted(x) if q % 7 == 0 for r, (s, c) in enumerate(sorted(((int(x[q] @ x[c]), c) for c in x if c != q and len(x[c]) == len(x[q])), key=lambda z: (-z[0], z[1]))[:10])]
    monkeypatch.setattr(topk, "ROWS", 16)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 7 == 0).collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.plan(docs).toPandas()
    by = rows.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert ((by.target - by.taken).abs() <= rows["size"].max()).all() and (rows.taken <= 2 * rows["size"]).all()
    assert rows.sort_values("doc_id").taken.tolist() == mixing.plan(docs.repartition(5)).toPandas().sort_values("doc_id").taken.tolist()
    mixed = mixing.mix(docs).toPandas()
    assert len(mixed) == sum(len(c) for c in rows.copies) and mixed.groupby("mix_shard").size().std() < 10
    weights = {k: (3.0, 1.0, 2.0)[i % 3] for i, k in enumerate(sorted(by.index.dropna()))}
    free, left, target = dict(by["size"].items()), 1.5 * by["size"].sum(), {}
    while free:  # what a source can't take is dealt to the others
        level = left / sum(weights[k] for k in free)
        full = [k for k in free if weights[k] * level > 2 * free[k]]
        if not full:
            target |= {k: weights[k] * level for k in free}
            break
        for k in full:
            target[k] = 2 * free.pop(k)
            left -= target[k]
    assert all(abs(by.target[k] - t) < 1e-6 * max(1, t) for k, t in target.items())
    edge = mixing.plan(documents(spark)).toPandas()
    assert len(edge) == documents(spark).count() and mixing.plan(documents(spark, empty=True)).count() == 0


def test_mixing_clashing_columns_and_repeated_rows(spark, monkeypatch):
    rows = [(i % 20, f"text {i % 20} " * (1 + i % 7), f"s{i % 3}", i, "perm", "copy", "copies", "e") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own int, perm string, copy string, copies string, mix_epoch string")
    for strata in (mixing.STRATUM, 10):
        monkeypatch.setattr(mixing, "STRATUM", strata)
        plan, out = mixing.plan(docs).toPandas(), mixing.mix(docs)
        assert out.columns == [*docs.columns, "mix_epoch_", "mix_shard", "mix_place"]
        got = out.toPandas()
        assert len(got) == sum(len(c) for c in plan.copies) and set(got.perm) == {"perm"} and set(got["copy"]) == {"copy"} and set(got.copies) == {"copies"}
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    fine = mixing.plan(docs.dropDuplicates(["doc_id"])).toPandas().groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((fine.target - fine.taken).abs() <= 28).all()
    assert mixing.mix(docs, places=False).columns == docs.columns and mixing.mix(documents(spark, empty=True)).count() == 0


def test_pieces(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model())
    texts = ["", " ", "  lead and trail  ", "▁marks▁ ▁▁", "tab\tand\nline\r\n", "日本語 émoji 🎉🎉 \u0000 x", "<s> </s> <unk> <0x41>", "a" * 1000, LONG[:5000], None]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" ▁abé<\n0") for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    for common, join_rest in ((pieces.COMMON_CHUNKS, False), (40, False), (40, True), (0, True)):
        monkeypatch.setattr(pieces, "COMMON_CHUNKS", common)
        got = pieces.encode_decode(docs, join_rest=join_rest).collect()
        assert len(got) == len(texts) + 1
        assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in got} == {i: (ids := sp.encode(t or ""), sp.decode(ids)) for i, t in enumerate(texts)}
    coded = pieces.encode(documents(spark))
    assert coded.count() == documents(spark).count() == pieces.decode(coded).count() and pieces.encode(documents(spark, empty=True)).count() == 0


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(lines.SPACE))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for n, (i, ls) in enumerate(split):
        for k in {key(x) for x in ls}:
            holders.setdefault(k, []).append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    gone = lambda i, x: last.get(key(x)) is not None and last[key(x)] != i
    return sorted(((i, "\n".join(x for x in ls if not gone(i, x)), len(ls), sum(gone(i, x) for x in ls)) for i, ls in split), key=repr)


def test_lines(spark, monkeypatch):
    docs = documents(spark)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    take = lambda d: sorted(map(tuple, d.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert take(lines.dedup_lines(docs)) == want
    monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    assert take(lines.dedup_lines(docs, pass_bytes=1)) == want
    assert lines.dedup_lines(documents(spark, empty=True)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    h = lines.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(20_000)) and len(lines.PerfectHash.build(keys[:0]).index(keys)) == 20_000


def brute_repeats(rows, length=100):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen and seen[w] != (i, p):
                gone[p : p + length] = b"\1" * length
            seen.setdefault(w, (i, p))
        out[i] = (len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(90, 160))) for _ in range(6)]
    rows = [(1, "a" * 500), (2, "ab" * 300), (3, "abcdefg" * 100 + "x" * 40 + "abcdefg" * 50), (4, "a" * 99), (5, None), (6, ""), (7, "z" * 50 + "abcdefg" * 40), (8, "é" * 200), (9, LONG), (10, LONG)]
    rows += [(k, "".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(rng.randint(1, 6)))) for k in range(11, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute_repeats(rows)
    assert suffix.drop_repeats(documents(spark)).count() == documents(spark).count() and suffix.drop_repeats(documents(spark, empty=True)).count() == 0


def test_maximal_repeats():
    a = b"the quick brown fox jumps over the lazy dog"
    got = {(size, tuple(sorted(places))) for size, places in suffix.maximal_repeats([b"1" + a + b"2", b"3" + a + b"4", b"5" + a[:20] + b"6"], 10)}
    assert got == {(len(a), ((0, 1), (1, 1))), (20, ((0, 1), (1, 1), (2, 1)))}


def test_sharding(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), documents(spark)):
        texts, out = docs.toPandas(), sharding.shard(docs).toPandas()
        n = out.groupby("shard").size().reindex(range(24), fill_value=0)
        assert len(out) == len(texts) and n.max() - n.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
        assert sorted(out.text_crc32) == sorted(zlib.crc32((t or "").encode()) for t in texts.text) and out["size"].sum() == sum(len((t or "").encode()) + 8 for t in texts.text)
    assert sharding.shard(documents(spark, empty=True)).count() == 0


def test_sharding_keeps_copies_together(spark):
    docs = spark.createDataFrame([(i, f"text {i // 4}" if i < 400 else f"own {i}") for i in range(4800)], "doc_id long, text string")
    out = sharding.shard(docs).toPandas().set_index("doc_id").shard
    assert sum(out[4 * g : 4 * g + 3].nunique() > 1 for g in range(100)) <= 5


def test_sharding_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(i, "one text" if i < 600 else f"own {i}") for i in range(1200)], "doc_id long, text string")
    out = sharding.shard(docs).toPandas()
    n = out.groupby("shard").size()
    assert len(out) == 1200 and len(n) == 24 and n.max() - n.min() <= 1


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path[:0] = [{str(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))!r}]
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()
from vantage.llm import embedding, language
e = s.createDataFrame([(i, 1, [1.0, i / 100.0]) for i in range(6)], 'vec_id long, label int, embedding array<double>')
assert embedding.near_links(e).agg(F.max('n_links')).first()[0] == 5
d = s.createDataFrame([(i, 'ein kleiner text' if i % 2 else 'some small text', 'de' if i % 2 else 'en') for i in range(8)], 'doc_id long, text string, lang string')
net = language.train(d, F.lit(True))
assert language.identify(d, net).where('score > 0').count() == 8
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300).returncode == 0


def test_quality(spark):
    rows = quality.query(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert rows.score.between(0, 1).all() and (rows[rows.held_out].predicted == rows[rows.held_out].quality).mean() >= 0.85
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for labs in (labels, labels.limit(0)):
        out = quality.score(documents(spark), quality.train(documents(spark), labs))
        assert out.count() == documents(spark).count() and out.where("quality_score between 0 and 1").count() == out.count()


def test_language(spark):
    rows = language.query(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and rows.score.between(0, 1).all()
    net = language.train(documents(spark), F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(spark), net).collect()}
    assert got[3] == got[4] == got[5] == got[9] == "und" and got[1] in ("en", "de", "fr")
    none = language.train(documents(spark, empty=True), F.lit(True))
    assert none is None and {r["lang_pred"] for r in language.identify(documents(spark), none).collect()} == {"und"}


def test_language_learns_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language.Network, "fit", lambda net, seqs, y: seen.extend(zip(seqs, y, strict=True)))
    rows = [(k, " ".join([f"licence{i}" for i in range(60)] + [f"{lang}{i}" for i in range(600)]), lang) for k, lang in enumerate(("de", "en"))]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for k, lang in enumerate(net.langs):
        words = [s for s, y in seen if y == k]
        assert len(words) == 660 and sum(s.startswith(f" {lang}".encode()) for s in words) == 600


def test_long_words_are_cut_between_characters():
    word = ("ä€𝄞x" * 200).encode()
    parts = language.windows(word)
    assert b"".join(parts) == b" " + word + b" " and all(len(x) <= language.STEPS and x.decode() is not None for x in parts)


def test_gradient_is_exact():
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language.padded([b" ab ", b"xyz", b"q"])
    y = np.array([0, 1, 1])
    loss = lambda: -(net.log_probs(x, mask)[:, np.arange(3), y] * mask).sum() / mask.sum()
    g = net.gradient(x, mask, y)
    for name, at in (("out", (3, 1)), ("fu", (2, 5)), ("bu", (1, 40)), ("fx", (97, 7)), ("bc", (20,))):
        old = net.p[name][at]
        ends = []
        for e in (1e-3, -1e-3):
            net.p[name][at] = old + e
            ends.append(loss())
        net.p[name][at] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[name][at]) < 1e-4


def test_near_duplicate_stage_is_brute_force(spark):
    docs = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent, ids, joined = {i: i for i in sets}, sorted(sets), 0
    for n, b in enumerate(ids):
        for a in ids[:n]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)], joined = min(x, y), joined + 1
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert joined and got == [i for i in ids if find(parent, i) == i]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    for empty in (False, True):
        edge = documents(spark, empty).drop("lang").withColumns({"quality_score": F.lit("mine"), "lang": F.lit("en")})
        rows = edge.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, edge, SF)
            assert (out.columns == edge.columns or name == "sentencepiece") and (empty or out.count() <= 2 * rows), name
            if not empty and name != "sentencepiece" and out.count():
                assert {tuple(r) for r in out.select("quality_score", "n_dropped", "shard", "fp").collect()} == {("mine", "z", "x", "y")}, name
            assert not empty or out.count() == 0
    out = corpus_pipeline.run(spark, SF).toPandas()
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.public_model())
    assert 0 < out.doc_id.nunique() <= n and all(list(r.ids) == sp.encode(r.decoded) for r in out.head(20).itertuples())
