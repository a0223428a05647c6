"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vantage.functions import columns as C
from vantage.functions import geometry as G
from vantage.operators import matching as M
from vantage.operators import relational as R

from .common import connected_components, cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# --- matching: even vec_ids are one view, odd ones the other ---


def view(s: SparkSession, d: str, parity: int, v=None) -> DataFrame:
    e = table(s, d, "embeddings").where(F.col("vec_id") % 2 == parity)
    return e.select(F.col("vec_id").alias("id"), (v if v is not None else F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


SIDES = """WITH a AS (SELECT vec_id AS id, {v} AS v FROM embeddings WHERE vec_id % 2 = {p}),
b AS (SELECT vec_id AS id, {v} AS v FROM embeddings WHERE vec_id % 2 = {o}),
r AS (SELECT a.id AS q, b.id AS i, list_inner_product(a.v, b.v) AS ip FROM a JOIN b ON list_inner_product(a.v, b.v) >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ip DESC, i DESC) AS r FROM r),
t AS (SELECT a.id AS q, coalesce(max(i) FILTER (r = 1), 0) AS i1, coalesce(max(ip) FILTER (r = 1), 0) AS p1,
  coalesce(max(i) FILTER (r = 2), 0) AS i2, coalesce(max(ip) FILTER (r = 2), 0) AS p2 FROM a LEFT JOIN k ON k.q = a.id GROUP BY a.id)"""
DOUBLES = "[CAST(x AS DOUBLE) FOR x IN embedding]"
SHORTS = "[round(greatest(least(CAST(x AS DOUBLE), 1), -1) * 127) FOR x IN embedding]"


def float_two(parity: int) -> str:
    return SIDES.format(v=DOUBLES, p=parity, o=1 - parity) + ", f AS (SELECT q, i1, greatest(0, 2 - 2 * p1) AS d1, i2, greatest(0, 2 - 2 * p2) AS d2 FROM t)"


@query(float_two(0) + " SELECT q, i1, round(d1, 6) AS d1, i2, round(d2, 6) AS d2 FROM f")
def nn_top2_float(s, d):
    out = M.nearest_two(view(s, d, 0), view(s, d, 1))
    return out.select("q", "i1", F.round("d1", 6).alias("d1"), "i2", F.round("d2", 6).alias("d2"))


@query(SIDES.format(v=SHORTS, p=0, o=1) + " SELECT q, i1, 32258 - 2 * least(p1, 16129) AS d1, i2, 32258 - 2 * least(p2, 16129) AS d2 FROM t")
def nn_top2_int16(s, d):
    v = M.int16_descriptor(F.col("embedding"))
    return M.nearest_two(view(s, d, 0, v), view(s, d, 1, v), "int16").select("q", "i1", "d1", "i2", "d2")


@query(float_two(0) + " SELECT q AS i, i1 AS j, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM f WHERE d1 <= 0.9 * d2")
def oneway_match_ratio(s, d):
    out = M.ratio_test(M.nearest_two(view(s, d, 0), view(s, d, 1)), 0.9)
    return out.select("i", "j", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


def both_ways(s, d):
    return M.mutual(*(M.ratio_test(M.nearest_two(view(s, d, p), view(s, d, 1 - p)), 1.0) for p in (0, 1)))


MUTUAL = "WITH m12 AS (" + float_two(0) + " SELECT q AS i, i1 AS j FROM f WHERE d1 <= d2), m21 AS (" + float_two(1) + " SELECT q AS i, i1 AS j FROM f WHERE d1 <= d2), u AS (SELECT m12.i, m12.j FROM m12 JOIN m21 ON m12.i = m21.j AND m12.j = m21.i)"


@query(MUTUAL + " SELECT i, j FROM u")
def mutual_match(s, d):
    return both_ways(s, d)


@query(MUTUAL + " SELECT count(*) AS n FROM u")
def count_consistent(s, d):
    return both_ways(s, d).agg(F.count(F.lit(1)).alias("n"))


@query(MUTUAL + " SELECT i, j FROM u UNION ALL SELECT i + 1000000, j + 1000000 FROM u")
def combine_results(s, d):
    m = both_ways(s, d)
    return M.combine(m, m, 1_000_000, 1_000_000)


@query("WITH v AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT a.label AS v1, b.label AS v2, a.n * b.n AS pairs FROM v a JOIN v b ON a.label > b.label AND b.label + 3 >= a.label")
def view_pairs_band(s, d):
    v = table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a, step = v.select(F.col("label").alias("v1"), F.col("n").alias("a")), F.explode(F.array(*(F.lit(k) for k in (1, 2, 3))))
    return a.withColumn("k", step).withColumn("v2", F.col("v1") - F.col("k")).join(v.select(F.col("label").alias("v2"), F.col("n").alias("b")), "v2").select("v1", "v2", (F.col("a") * F.col("b")).alias("pairs"))


@query(MUTUAL.replace("FROM embeddings WHERE", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id DESC) AS rank FROM embeddings) WHERE rank <= 100) e WHERE") + " SELECT i, j FROM u")
def lowres_gate(s, d):
    """Mutual matches of the 100 features of the largest ids of each view: the limit is the gate's."""
    ranked = [view(s, d, p).withColumn("size", F.col("id").cast("double")) for p in (0, 1)]
    return M.lowres_matches(*ranked, "size", 100, 1.0)


UNNEST = "u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


@query(f"WITH {UNNEST} SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM u GROUP BY pos")
def avg_descriptor(s, d):
    return table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


@query(f"WITH {UNNEST}, m AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY pos) SELECT vec_id, round(sum(abs(x - m)), 6) AS l1 FROM u JOIN m USING (pos) GROUP BY vec_id")
def zero_mean_desc(s, d):
    e = table(s, d, "embeddings")
    mean = [r["m"] for r in e.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos").collect()]  # one row for each dimension
    centred = F.zip_with("embedding", F.array(*(F.lit(x) for x in mean)), lambda x, m: x.cast("double") - m)
    return e.select("vec_id", F.round(F.aggregate(centred, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


HASH = "(" + " + ".join(f"CASE WHEN embedding[{k % 64 + 1}] > embedding[{(7 * k + 3) % 64 + 1}] THEN {1 << k} ELSE 0 END" for k in range(16)) + ")"
HASHED = f"WITH h AS (SELECT vec_id, CAST({HASH} AS BIGINT) AS h FROM embeddings)"


def hashed(s, d):
    return table(s, d, "embeddings").select("vec_id", M.sign_hash(F.col("embedding"), 16, 64).alias("h"))


@query(HASHED + " SELECT h & 255 AS bucket, count(*) AS n, min(vec_id) AS first FROM h GROUP BY 1")
def lsh_buckets(s, d):
    return hashed(s, d).groupBy(F.col("h").bitwiseAND(F.lit(255).cast("long")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


CANDIDATES = HASHED + ", c AS (SELECT a.vec_id AS q, b.vec_id AS c, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS ham FROM h a JOIN h b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND ((a.h & 255) = (b.h & 255) OR (a.h >> 8) = (b.h >> 8)))"


def lsh(s, d):
    g = hashed(s, d).withColumn("g", F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col("h").bitwiseAND(F.lit(255).cast("long")).alias("b")), F.struct(F.lit(1).alias("g"), F.shiftright("h", 8).alias("b")))))
    a, b = (g.where(F.col("vec_id") % 2 == p).select(F.col("vec_id").alias(n), F.col("h").alias(f"h{n}"), "g") for p, n in ((0, "q"), (1, "c")))
    return a.join(b, "g").select("q", "c", F.bit_count(F.col("hq").bitwiseXOR(F.col("hc"))).alias("ham")).distinct()


@query(CANDIDATES + " SELECT q, c, ham FROM c")
def lsh_candidates(s, d):
    return lsh(s, d)


@query(CANDIDATES + ", k AS (SELECT *, count(*) OVER (PARTITION BY q ORDER BY ham) - count(*) OVER (PARTITION BY q, ham) AS b, row_number() OVER (PARTITION BY q ORDER BY ham, c) AS r FROM c) SELECT q, c, ham FROM k WHERE b < 6 AND r <= 10")
def lsh_rank(s, d):
    return M.top_hamming_levels(lsh(s, d))


# --- tracks and bundles: orders are tracks, suppliers are views, line items are observations ---


@query("WITH RECURSIVE " + MUTUAL[5 : MUTUAL.index(", u AS (")] + ", b AS (SELECT i AS u, j AS v FROM m12 UNION SELECT j, i FROM m12 UNION SELECT i, j FROM m21 UNION SELECT j, i FROM m21), r AS (SELECT u, u AS w FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.w = b.u) SELECT u AS node, min(w) AS component FROM r GROUP BY u")
def tracks_components(s, d):
    """Tracks of the matches of every feature with its nearest one of the other view, in both directions."""
    ways = [M.ratio_test(M.nearest_two(view(s, d, p), view(s, d, 1 - p)), 1.0).select(F.col("i").alias("u"), F.col("j").alias("v")) for p in (0, 1)]
    return connected_components(ways[0].union(ways[1]))


@query("WITH t AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_suppkey)) SELECT l_orderkey AS track, row_number() OVER (ORDER BY l_orderkey) - 1 AS new_id FROM t")
def tracks_conflict_filter(s, d):
    return R.valid_tracks(table(s, d, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("l_orderkey", "track")


@query("SELECT l_orderkey AS track, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS r, CAST(floor(avg(l_linenumber) + 0.5) AS BIGINT) AS g FROM lineitem GROUP BY 1")
def track_color_mean(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(F.floor(F.avg("l_quantity") + 0.5).alias("r"), F.floor(F.avg("l_linenumber") + 0.5).alias("g"))


PAIRS = "p AS (SELECT a.s AS v1, b.s AS v2, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2)"


@query(f"WITH {PAIRS} SELECT v1, v2, n FROM p")
def candidate_pairs(s, d):
    return R.view_pairs(table(s, d, "lineitem"), "l_orderkey", "l_suppkey")


LOGISTIC = "greatest(0, least(1, 2 / (1 + exp({})) - 1))"


@query(f"WITH {PAIRS}, q AS (SELECT *, floor(n * ((v1 * 7 + v2 * 13) % 100) / 100.0) AS inliers, (v1 + v2) % 12 AS angle FROM p) SELECT v1, v2, round({LOGISTIC.format('(20 - n) * 6 / 200.0')} * {LOGISTIC.format('(1 - angle) * 6 / 8.0')} * {LOGISTIC.format('(inliers / n - 0.7) * 6 / 0.4')}, 9) AS score FROM q")
def pair_score(s, d):
    """Scores of view pairs by their matches, with made-up numbers of inliers and angles."""
    p = R.view_pairs(table(s, d, "lineitem"), "l_orderkey", "l_suppkey")
    inliers = F.floor(F.col("n") * ((F.col("v1") * 7 + F.col("v2") * 13) % 100) / 100.0)
    return p.select("v1", "v2", F.round(G.pair_score(F.col("n").cast("double"), inliers.cast("double"), ((F.col("v1") + F.col("v2")) % 12).cast("double")), 9).alias("score"))


@query("SELECT l_suppkey AS view, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 6")
def next_views(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("view")).agg(F.countDistinct("l_orderkey").alias("n")).where("n > 6")


@query("WITH e AS (SELECT l_orderkey AS track, avg(l_discount * l_discount) AS err FROM lineitem GROUP BY 1), k AS (SELECT err, row_number() OVER (ORDER BY err) AS r, count(*) OVER () AS n FROM e) SELECT track, round(err, 9) AS err FROM e WHERE err > 1.7321 * (SELECT err FROM k WHERE r = n // 2 + 1)")
def large_error_tracks(s, d):
    """Mean squared errors of tracks above 1.7321 times the upper median (the default is 10 times)."""
    e = cut(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(F.avg(F.col("l_discount") * F.col("l_discount")).alias("err")), "errors")
    return R.large_errors(e, "err", 1.7321).withColumn("err", F.round("err", 9))


@query(
    "WITH o AS (SELECT l_suppkey, CAST(l_discount AS DOUBLE) AS u, CAST(l_tax AS DOUBLE) AS v, 1 + s_nationkey / 25.0 AS f, s_suppkey / 10.0 AS a, p_size / 10.0 AS x, p_retailprice % 7 AS y, p_partkey % 11 AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), "
    "c AS (SELECT *, (cos(a) * x - sin(a) * y + 0.5) / (z + 20) AS px, (sin(a) * x + cos(a) * y - 0.5) / (z + 20) AS py FROM o), w AS (SELECT *, 1 + 0.05 * (px * px + py * py) + 0.01 * pow(px * px + py * py, 2) AS warp FROM c) "
    "SELECT l_suppkey AS camera, count(*) AS n, round(sum(pow(f * warp * px - u, 2) + pow(f * warp * py - v, 2)) / count(*), 6) AS mse FROM w GROUP BY 1"
)
def reprojection_mse(s, d):
    """Line items are observations, parts are points and suppliers cameras with a rotation about their axis and distortion."""
    o = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_tax").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice"), "l_partkey")
    a, zero, one = F.col("l_suppkey") / 10.0, F.lit(0.0), F.lit(1.0)
    cam = G.camera(1 + F.col("s_nationkey") / 25.0, rot=[F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one], trans=[F.lit(0.5), F.lit(-0.5), F.lit(20.0)])
    p, _ = G.projected(cam, [F.col("p_size") / 10.0, F.col("p_retailprice").cast("double") % 7, (F.col("l_partkey") % 11).cast("double")], F.lit(0.05), F.lit(0.01))
    e = [p[0] - F.col("l_discount").cast("double"), p[1] - F.col("l_tax").cast("double")]
    return o.groupBy(F.col("l_suppkey").alias("camera")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(e[0] * e[0] + e[1] * e[1]) / F.count(F.lit(1)), 6).alias("mse"))


@query("WITH g AS (SELECT avg(c_acctbal) AS mx, avg(c_custkey) AS my, avg(c_nationkey) AS mz, 10 / greatest(max(c_acctbal) - min(c_acctbal), max(c_custkey) - min(c_custkey), max(c_nationkey) - min(c_nationkey)) AS k FROM customer) SELECT c_custkey, round((c_acctbal - mx) * k, 6) AS x, round((c_custkey - my) * k, 6) AS y, round((c_nationkey - mz) * k, 6) AS z FROM customer, g")
def normalize_scene(s, d):
    """Camera centres with their mean at the origin and a largest extent of 10."""
    c = table(s, d, "customer")
    axes = ("c_acctbal", "c_custkey", "c_nationkey")
    g = c.agg(*(f(x).cast("double") for x in axes for f in (F.avg, F.min, F.max))).first()
    extent = max((g[3 * i + 2] or 0) - (g[3 * i + 1] or 0) for i in range(3))
    return c.select("c_custkey", *(F.round((F.col(x) - F.lit(g[3 * i])) * (10 / extent if extent else 1.0), 6).alias(n) for i, (x, n) in enumerate(zip(axes, "xyz", strict=True))))


@query("SELECT o_orderkey AS track, count(l_suppkey) FILTER (l_suppkey <> 1) AS refs FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bundle_delete_camera(s, d):
    refs = table(s, d, "lineitem").where("l_suppkey <> 1").groupBy(F.col("l_orderkey").alias("track")).agg(F.count(F.lit(1)).alias("refs"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("track")).join(refs, "track", "left").fillna(0, ["refs"])


@query("SELECT count(*) AS cameras, count(*) FILTER (c_acctbal > 0) AS valid FROM customer")
def num_valid_cameras(s, d):
    return table(s, d, "customer").agg(F.count(F.lit(1)).alias("cameras"), F.count_if(F.col("c_acctbal") > 0).alias("valid"))


@query("SELECT c_nationkey AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mx, round(avg(c_custkey), 6) AS my, round(avg(c_acctbal * c_custkey) - avg(c_acctbal) * avg(c_custkey), 3) AS cov FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def similarity_cov(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")
    return c.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mx"), F.round(F.avg("c_custkey"), 6).alias("my"), F.round(F.avg(F.col("c_acctbal") * F.col("c_custkey")) - F.avg("c_acctbal") * F.avg("c_custkey"), 3).alias("cov"))


@query("WITH RECURSIVE g AS (SELECT l_suppkey AS view, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT view, n, CAST(1 AS INTEGER) AS pick FROM g ORDER BY n DESC, view LIMIT 1")
def greedy_first(s, d):
    picks = R.greedy_views(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", 1)
    return s.createDataFrame([(v, n, i + 1) for i, (v, n) in enumerate(picks)], "view long, n long, pick int")


PICKS = "WITH x0 AS (SELECT DISTINCT l_suppkey AS view, l_orderkey AS t FROM lineitem)" + "".join(f", g{k + 1} AS (SELECT view, count(*) AS n, CAST({k + 1} AS INTEGER) AS pick FROM x{k} GROUP BY 1 ORDER BY n DESC, view LIMIT 1), x{k + 1} AS (SELECT * FROM x{k} WHERE t NOT IN (SELECT t FROM x{k} WHERE view IN (SELECT view FROM g{k + 1})))" for k in range(4))


@query(PICKS + " SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4")
def greedy_topk(s, d):
    picks = R.greedy_views(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", 4)
    return s.createDataFrame([(v, n, i + 1) for i, (v, n) in enumerate(picks)], "view long, n long, pick int")


@query("SELECT o_orderkey, CAST(coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def correspondence_offsets(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey", "left").fillna(0, ["n"])
    return o.select("o_orderkey", F.coalesce(F.sum("n").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))


@query(f"WITH {PAIRS} SELECT printf('\"%d\" -- \"%d\" [weight=%d];', v1, v2, n) AS line FROM p")
def matching_graph_dot(s, d):
    return R.view_pairs(table(s, d, "lineitem"), "l_orderkey", "l_suppkey").select(F.format_string('"%d" -- "%d" [weight=%d];', "v1", "v2", "n").alias("line"))


# --- meshes: line items are faces over part numbers ---

FACES = "f AS (SELECT l_orderkey * 10 + l_linenumber AS fid, l_partkey AS v0, l_suppkey AS v1, l_orderkey % 2000 + 1 AS v2 FROM lineitem)"
EDGES = "e AS (SELECT DISTINCT fid, least(a, b) AS e1, greatest(a, b) AS e2 FROM (SELECT fid, v0 AS a, v1 AS b FROM f UNION ALL SELECT fid, v1, v2 FROM f UNION ALL SELECT fid, v2, v0 FROM f) WHERE a <> b)"


def faces(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), F.col("l_partkey").alias("v0"), F.col("l_suppkey").alias("v1"), (F.col("l_orderkey") % 2000 + 1).alias("v2"))


@query(f"WITH {FACES}, {EDGES}, n AS (SELECT vid, count(DISTINCT o) AS n_neighbours FROM (SELECT e1 AS vid, e2 AS o FROM e UNION ALL SELECT e2, e1 FROM e) GROUP BY vid), c AS (SELECT vid, count(DISTINCT fid) AS n_faces FROM (SELECT fid, v0 AS vid FROM f UNION ALL SELECT fid, v1 FROM f UNION ALL SELECT fid, v2 FROM f) GROUP BY vid) SELECT vid, n_faces, coalesce(n_neighbours, 0) AS n_neighbours FROM c LEFT JOIN n USING (vid)")
def mesh_adjacency(s, d):
    return R.adjacency(faces(s, d))


@query(f"WITH {FACES} SELECT p_partkey AS vid FROM part WHERE p_partkey NOT IN (SELECT v0 FROM f UNION SELECT v1 FROM f UNION SELECT v2 FROM f)")
def mesh_unreferenced(s, d):
    return R.unreferenced(table(s, d, "part").select(F.col("p_partkey").alias("vid")), faces(s, d))


@query("WITH n AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS ls FROM lineitem GROUP BY 1) SELECT l_orderkey * 8 + CAST(unnest(ls) AS BIGINT) AS vid FROM n WHERE len(ls) > 4")
def mesh_components(s, d):
    """Line items as vertices; each three that follow each other in an order form a face. Parts of four vertices and fewer
    go."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("vid")).distinct()
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    f = li.select(F.col("vid").alias("fid"), F.col("vid").alias("v0"), F.lead("vid", 1).over(w).alias("v1"), F.lead("vid", 2).over(w).alias("v2")).where("v2 is not null")
    return R.delete_small_components(li.select("vid"), f, 4)


@query(f"WITH {FACES}, k AS (SELECT p_partkey AS vid, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_size > 10) SELECT fid, a.n AS v0, b.n AS v1, c.n AS v2 FROM f JOIN k a ON a.vid = v0 JOIN k b ON b.vid = v1 JOIN k c ON c.vid = v2")
def delete_vertices_fix_faces(s, d):
    v = table(s, d, "part").select(F.col("p_partkey").alias("vid"), "p_size")
    return R.renumber(v, faces(s, d), F.col("p_size") <= 10)


@query(f"WITH {FACES} SELECT fid FROM f WHERE NOT (v0 = v1 AND v0 = v2)")
def invalid_faces(s, d):
    return R.delete_invalid_faces(faces(s, d)).select("fid")


@query(f"WITH {FACES}, {EDGES} SELECT e1, e2, count(*) AS n_faces, min(fid) AS first FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def edge_faces(s, d):
    return R.edges(faces(s, d)).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_faces"), F.min("fid").alias("first")).where("n_faces > 1")


@query(f"WITH {FACES}, {EDGES}, u AS (SELECT DISTINCT e1, e2 FROM e), b AS (SELECT e1 AS vid, e2 AS o FROM u UNION ALL SELECT e2, e1 FROM u) SELECT vid, CASE WHEN count(*) < 3 THEN 0 ELSE round(avg(abs(vid - o)), 6) END AS scale FROM b GROUP BY vid")
def vertex_scale(s, d):
    e = R.edges(faces(s, d)).select("e1", "e2").distinct()
    b = e.select(F.col("e1").alias("vid"), F.col("e2").alias("o")).union(e.select("e2", "e1"))
    return b.groupBy("vid").agg(F.when(F.count(F.lit(1)) < 3, 0.0).otherwise(F.round(F.avg(F.abs(F.col("vid") - F.col("o"))), 6)).alias("scale"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05 AND l_extendedprice BETWEEN 1000 AND 30000")
def aabb_filter(s, d):
    return table(s, d, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_discount").between(0.02, 0.05) & F.col("l_extendedprice").between(1000, 30000)).select("l_orderkey", "l_linenumber")


@query("SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1, min(l_extendedprice) AS z0, max(l_extendedprice) AS z1 FROM lineitem")
def aabb_global(s, d):
    return table(s, d, "lineitem").agg(*(f(c).alias(n) for c, a, b in (("l_quantity", "x0", "x1"), ("l_discount", "y0", "y1"), ("l_extendedprice", "z0", "z1")) for f, n in ((F.min, a), (F.max, b))))


@query("WITH g AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS p, max(l_extendedprice) AS q, min(l_discount) AS u, max(l_discount) AS v FROM lineitem), w AS (SELECT *, greatest(b - a, q - p, v - u) AS w FROM g) SELECT l_orderkey, l_linenumber, round((l_quantity - (a + b) / 2) / w, 9) AS x, round((l_extendedprice - (p + q) / 2) / w, 9) AS y, round((l_discount - (u + v) / 2) / w, 9) AS z FROM lineitem, w")
def scale_and_center(s, d):
    """The box's middle at the origin and its largest side 1."""
    li, axes = table(s, d, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")
    g = li.agg(*(f(c).cast("double") for c in axes for f in (F.min, F.max))).first()
    side = max((g[2 * i + 1] or 0) - (g[2 * i] or 0) for i in range(3)) or 1.0
    return li.select("l_orderkey", "l_linenumber", *(F.round((F.col(c) - F.lit(((g[2 * i] or 0) + (g[2 * i + 1] or 0)) / 2)) / side, 9).alias(n) for i, (c, n) in enumerate(zip(axes, "xyz", strict=True))))


# --- rasters: (line number, supplier) is a grid of summed quantities ---

GRID = "g AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS x, l_suppkey - 1 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), z AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM g), p AS (SELECT x, y, coalesce(v, 0) AS v FROM (SELECT x, y FROM (SELECT unnest(range(w)) AS x FROM z), (SELECT unnest(range(h)) AS y FROM z)) LEFT JOIN g USING (x, y))"


def grid(s, d):
    g = table(s, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("x"), (F.col("l_suppkey") - 1).alias("y")).agg(F.sum("l_quantity").alias("v"))
    w, h = (m + 1 for m in g.agg(F.max("x"), F.max("y")).first())
    full = s.range(h).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("x"))
    return full.join(g, ["x", "y"], "left").fillna(0.0, ["v"]), w, h


@query(f"WITH {GRID} SELECT x, y, sum(r) OVER (PARTITION BY x ORDER BY y) AS s FROM (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS r FROM p)")
def integral_image(s, d):
    return R.integral(grid(s, d)[0]).select("x", "y", "s")


@query(f"WITH {GRID} SELECT x // 3 AS bx, y // 10 AS by, sum(v) AS s FROM p GROUP BY 1, 2")
def box_sum(s, d):
    return grid(s, d)[0].groupBy(F.floor(F.col("x") / 3).alias("bx"), F.floor(F.col("y") / 10).alias("by")).agg(F.sum("v").alias("s"))


@query(f"WITH {GRID} SELECT x // 2 AS x, y // 2 AS y, round(sum(v * CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END * CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END) / 4, 6) AS v FROM p, z GROUP BY x // 2, y // 2")
def half_size(s, d):
    p, w, h = grid(s, d)
    return R.half_size(p, w, h).withColumn("v", F.round("v", 6))


@query(f"WITH {GRID}, a AS (SELECT x, y, lead(v) OVER r - lag(v) OVER r AS sl, lag(v) OVER r + 2 * v + lead(v) OVER r AS sm FROM p WINDOW r AS (PARTITION BY y ORDER BY x)), b AS (SELECT x, y, lag(sl) OVER c + 2 * sl + lead(sl) OVER c AS gx, lead(sm) OVER c - lag(sm) OVER c AS gy FROM a WINDOW c AS (PARTITION BY x ORDER BY y)) SELECT x, y, CASE WHEN x = 0 OR y = 0 OR x = w - 1 OR y = h - 1 THEN 0 ELSE round(least(255, sqrt(gx * gx + gy * gy)), 6) END AS g FROM b, z")
def sobel(s, d):
    p, w, h = grid(s, d)
    return R.sobel(p, w, h).withColumn("g", F.round("g", 6))


@query("SELECT event_id, round((value - a) / (b - a), 9) AS v FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) g")
def float_normalize(s, d):
    return R.normalised(table(s, d, "events").select("event_id", "value"), "value", "v").select("event_id", F.round("v", 9).alias("v"))


@query("SELECT CAST(floor(log10(1 + 9 * (value - a) / (b - a)) * 63) AS BIGINT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) g GROUP BY 1")
def log_histogram(s, d):
    v = R.normalised(table(s, d, "events").select("value"), "value", "v")
    return v.groupBy(F.floor(F.log10(1 + 9 * F.col("v")) * 63).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) SELECT max(value) FILTER (r = n // 10 + 1) AS p10, max(value) FILTER (r = 9 * n // 10 + 1) AS p90 FROM k")
def percentile_p10_p90(s, d):
    e = table(s, d, "events")
    n = e.where("value is not null").count()
    return s.createDataFrame([tuple(R.order_statistics(e, "value", [n // 10, 9 * n // 10]))], "p10 double, p90 double")


@query("WITH k AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) SELECT event_id, value FROM events WHERE value > (SELECT value FROM k WHERE r = CAST(floor(0.75 * n) AS BIGINT) + 1)")
def conf_filter_percentile(s, d):
    e = table(s, d, "events").select("event_id", "value")
    n = e.where("value is not null").count()
    least = R.order_statistics(e, "value", [int(0.75 * n)])[0]
    return e.where(F.col("value") > F.lit(least))


# --- samples and voxels ---


@query("SELECT count(*) FILTER (value <= 5) AS small, count(*) FILTER (value > 5 AND value > 100) AS large, count(*) FILTER (value > 5 AND value <= 100) AS kept FROM events")
def sample_filter(s, d):
    v = F.col("value")
    return table(s, d, "events").agg(F.count_if(v <= 5).alias("small"), F.count_if((v > 5) & (v > 100)).alias("large"), F.count_if((v > 5) & (v <= 100)).alias("kept"))


LEVEL = "CAST(floor(log2(1024 / value)) AS BIGINT)"


@query(f"SELECT event_id, {LEVEL} AS level FROM events WHERE value > 0")
def octree_level(s, d):
    return table(s, d, "events").where("value > 0").select("event_id", F.floor(F.log2(1024 / F.col("value"))).alias("level"))


@query(f"SELECT {LEVEL} AS level, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
def octree_hist(s, d):
    return octree_level(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT (CAST(l_quantity AS BIGINT) << 42) | (CAST(floor(l_discount * 100 + 0.5) AS BIGINT) << 21) | CAST(l_linenumber AS BIGINT) AS voxel FROM lineitem")
def voxel_keys(s, d):
    x, y = F.shiftleft(F.col("l_quantity").cast("long"), 42), F.shiftleft(F.floor(F.col("l_discount") * 100 + 0.5), 21)
    return table(s, d, "lineitem").select(x.bitwiseOR(y).bitwiseOR(F.col("l_linenumber").cast("long")).alias("voxel")).distinct()


@query("SELECT p_partkey AS pid, count(*) AS n, round(sum(s_acctbal * (1 - abs(p_retailprice - s_suppkey * 20) / 15.0)), 4) AS f FROM part JOIN supplier ON abs(p_retailprice - s_suppkey * 20) <= 15.0 GROUP BY 1")
def influence_sum(s, d):
    points = table(s, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("p"))
    samples = table(s, d, "supplier").select((F.col("s_suppkey") * 20).cast("double").alias("s"), F.col("s_acctbal").alias("value"))
    return R.range_sums(samples, points, 15.0).withColumn("f", F.round("f", 4))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, round(sum(l_discount * l_discount), 4) AS squares, round(sum(abs(l_tax - 0.04)), 4) AS absolute FROM lineitem GROUP BY 1")
def weighted_mean(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("mean"), F.round(F.sum(F.col("l_discount") * F.col("l_discount")), 4).alias("squares"), F.round(F.sum(F.abs(F.col("l_tax") - 0.04)), 4).alias("absolute"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS lo, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS hi FROM orders) SELECT o_orderpriority, max(o_orderkey) FILTER (lo = 1) AS argmin, max(o_orderkey) FILTER (hi = 1) AS argmax FROM k GROUP BY 1")
def argmin_argmax(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("argmin"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("argmax"))


COO = "m AS (SELECT l_suppkey % 50 AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT j AS i, i AS j, v FROM m)"


def coo(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {COO} SELECT m.i, t.j, sum(m.v * t.v) AS v FROM m JOIN t ON m.j = t.i GROUP BY 1, 2")
def sparse_matmul(s, d):
    m = coo(s, d)
    return R.sparse_multiply(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query(f"WITH {COO} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT i, j, -v FROM t) GROUP BY 1, 2")
def sparse_subtract(s, d):
    m = coo(s, d)
    return R.sparse_subtract(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


# --- strings and colours ---


@query("SELECT p_partkey, string_split(p_type, ' ') AS words, len(string_split(p_name, ' ')) AS n FROM part")
def split_tokens(s, d):
    return table(s, d, "part").select("p_partkey", C.split_tokens(F.col("p_type"), " ", True).alias("words"), F.size(C.split_tokens(F.col("p_name"), " ", True)).cast("long").alias("n"))


@query("SELECT p_partkey, upper(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+', ' ', 'g')) AS model FROM part")
def simplify_model(s, d):
    return table(s, d, "part").select("p_partkey", C.simplify(F.col("p_name")).alias("model"))


@query("SELECT doc_id, format('{:,}', n_chars * 1000) AS s FROM documents")
def punctate(s, d):
    return table(s, d, "documents").select("doc_id", C.punctate((F.col("n_chars") * 1000).cast("string")).alias("s"))


@query("SELECT doc_id, CASE WHEN length(source || lang || source) <= 8 THEN source || lang || source ELSE substr(source || lang || source, 1, 5) || '...' END AS s FROM documents")
def ellipsize(s, d):
    return table(s, d, "documents").select("doc_id", C.ellipsize(F.concat("source", "lang", "source"), 8).alias("s"))


@query("WITH k AS (SELECT n_nationkey AS k, unnest(CASE WHEN n_regionkey <= n_nationkey THEN range(n_regionkey, n_nationkey + 1) ELSE range(n_nationkey, n_regionkey + 1) END) AS id FROM nation) SELECT k, count(*) + 1 AS n, CAST(sum(id) + 99 AS BIGINT) AS total FROM k GROUP BY k")
def id_ranges(s, d):
    ids = C.id_ranges(F.format_string("%d-%d,99", "n_regionkey", "n_nationkey"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k"), ids.alias("ids")).select("k", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, 'view_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.mve' AS name, source || '.png' AS png FROM documents")
def image_names(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("view_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".mve")).alias("name"), C.replace_extension(F.concat("source", F.lit(".jpg")), "png").alias("png"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '/+$', ''), '^.*/', '') AS base FROM pages")
def path_basename(s, d):
    return table(s, d, "pages").select("page_id", C.basename(F.col("url")).alias("base"))


@query("SELECT b.item_id, regexp_replace(b.text, '[ \\t]+', ' ', 'g') AS s, lower(b.text) AS low, upper(substr(b.text, 1, 4)) AS up FROM benchmark b")
def normalize_text(s, d):
    return table(s, d, "benchmark").select("item_id", C.normalize_spaces(F.col("text")).alias("s"), C.lower_letters(F.col("text")).alias("low"), C.upper_letters(F.left("text", F.lit(4))).alias("up"))


RGB = "c AS (SELECT p_partkey, p_size / 50.0 AS r, p_retailprice / 3000.0 AS g, (p_partkey % 256) / 255.0 AS b FROM part)"


def rgb(s, d):
    return table(s, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("r"), (F.col("p_retailprice") / 3000.0).alias("g"), (F.col("p_partkey") % 256 / 255.0).alias("b"))


@query("WITH c AS (SELECT p_partkey, p_size / 50.0 AS v FROM part) SELECT p_partkey, round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * power(v, 1 / 2.4) - 0.055 END, 9) AS srgb, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE power((v + 0.055) / 1.055, 2.4) END, 9) AS linear FROM c")
def gamma_srgb(s, d):
    v = F.col("p_size") / 50.0
    return table(s, d, "part").select("p_partkey", F.round(C.gamma_srgb(v), 9).alias("srgb"), F.round(C.gamma_inv_srgb(v), 9).alias("linear"))


@query(f"WITH {RGB} SELECT p_partkey, round(greatest(r, g, b), 9) AS maximum, round((greatest(r, g, b) + least(r, g, b)) / 2, 9) AS lightness, round(0.21 * r + 0.72 * g + 0.07 * b, 9) AS luminosity, round(0.30 * r + 0.59 * g + 0.11 * b, 9) AS luminance, round((r + g + b) / 3, 9) AS average FROM c")
def desaturate(s, d):
    return rgb(s, d).select("p_partkey", *(F.round(C.desaturate(k, F.col("r"), F.col("g"), F.col("b")), 9).alias(k) for k in ("maximum", "lightness", "luminosity", "luminance", "average")))


@query(f"WITH {RGB} SELECT p_partkey, round(0.299 * r + 0.587 * g + 0.114 * b, 9) AS y, round(-0.168736 * r - 0.331264 * g + 0.5 * b, 9) AS cb, round(0.5 * r - 0.418688 * g - 0.081312 * b, 9) AS cr FROM c")
def ycbcr(s, d):
    return rgb(s, d).select("p_partkey", *(F.round(C.weighted(w, F.col("r"), F.col("g"), F.col("b")), 9).alias(n) for w, n in zip(C.RGB_TO_YCBCR, ("y", "cb", "cr"), strict=True)))


@query(f"WITH {RGB}, x AS (SELECT p_partkey, 0.4124 * r + 0.3576 * g + 0.1805 * b AS x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, 0.0193 * r + 0.1192 * g + 0.9505 * b AS z FROM c) SELECT p_partkey, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(x / (x + y + z), 9) AS cx FROM x")
def xyz(s, d):
    x = rgb(s, d).select("p_partkey", *(C.weighted(w, F.col("r"), F.col("g"), F.col("b")).alias(n) for w, n in zip(C.SRGB_TO_XYZ, "xyz", strict=True)))
    return x.select("p_partkey", *(F.round(n, 9).alias(n) for n in "xyz"), F.round(C.xyz_to_xyy(F.col("x"), F.col("y"), F.col("z"))[0], 9).alias("cx"))


@query("SELECT p_partkey, CAST(floor(greatest(least(p_size / 40.0, 1), 0) * 255 + 0.5) AS INTEGER) AS byte, round(exp(-(p_size * p_size) / 200.0), 9) AS gauss, round(sin(p_size) / p_size, 9) AS sinc, CAST(bit_count(p_partkey) AS INTEGER) AS bits FROM part")
def scalar_math(s, d):
    v = F.col("p_size").cast("double")
    return table(s, d, "part").select("p_partkey", C.float_to_byte(v / 40.0).alias("byte"), F.round(C.gaussian(v, 10.0), 9).alias("gauss"), F.round(C.sinc(v), 9).alias("sinc"), F.bit_count("p_partkey").alias("bits"))


@query("WITH k AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1) SELECT p_partkey, first FROM part LEFT JOIN k ON upper(regexp_replace(part.p_brand, '[^A-Za-z0-9]+', ' ', 'g')) = upper(regexp_replace(k.p_brand, '[^A-Za-z0-9]+', ' ', 'g'))")
def camera_lookup(s, d):
    p = table(s, d, "part").select("p_partkey", C.simplify(F.col("p_brand")).alias("model"))
    return p.join(p.groupBy("model").agg(F.min("p_partkey").alias("first")), "model", "left").select("p_partkey", "first")
