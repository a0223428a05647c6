"""Queries of formats and of further table operators, each with its SQL: texts and binaries are made from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import geometry as G
from vantage.operators import estimators as E
from vantage.operators import octree as O
from vantage.sources import bundles, ply, records, scenes, text, writers

from . import catalog_surfaces as S
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("SELECT c_custkey, trim(c_name) AS name, CAST(c_custkey AS VARCHAR) AS key, '7' AS last, CAST(NULL AS VARCHAR) AS dropped, CAST(3 AS BIGINT) AS n FROM customer")
def parse_ini(s, d):
    """Settings texts with comments, blank lines, a repeated key and a last line without a line break."""
    t = F.concat(F.lit("# first\n[view]\nname =  "), F.col("c_name"), F.lit(" \n\nid="), F.col("c_custkey").cast("string"), F.lit("\n[b]\nx = 1\nx = 7\n[c]\ny = 2"))
    m = table(s, d, "customer").select("c_custkey", text.parse_ini(t).alias("m"))
    at = lambda k: F.element_at("m", k)
    return m.select("c_custkey", at("view.name").alias("name"), at("view.id").alias("key"), at("b.x").alias("last"), at("c.y").alias("dropped"), F.size(F.map_keys("m")).cast("long").alias("n"))


@query("SELECT c_custkey, chr(10) || '[a]' || chr(10) || 'z = ' || CAST(c_custkey AS VARCHAR) || chr(10) || chr(10) || '[b]' || chr(10) || 'name = ' || trim(c_name) || chr(10) AS text FROM customer")
def write_ini(s, d):
    return table(s, d, "customer").select("c_custkey", writers.write_ini(F.create_map(F.lit("b.name"), F.col("c_name"), F.lit("a.z"), F.col("c_custkey").cast("string"))).alias("text"))


@query("SELECT c_custkey, c_name AS payload, CAST(octet_length(encode(c_name)) + 18 AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS broken FROM customer")
def blob_files(s, d):
    """Values packed as files and taken out again."""
    content = scenes.blob_content(F.encode("c_name", "UTF-8"))
    c = table(s, d, "customer").select("c_custkey", content.alias("f"))
    return c.select("c_custkey", scenes.blob_payload(F.col("f")).cast("string").alias("payload"), F.octet_length("f").cast("long").alias("bytes"), scenes.blob_payload(F.substring(F.col("f"), 1, 20)).cast("string").alias("broken"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS width, CAST(p_partkey % 1000 AS INTEGER) AS height, 3 AS channels, CASE WHEN p_partkey % 2 = 0 THEN 'uint8' ELSE 'float32' END AS type FROM part")
def image_headers(s, d):
    """The sizes in the first bytes of image files."""
    little = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), 7 - 2 * b, 2) for b in range(4))))
    kind = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(9)
    f = F.concat(F.lit(bytearray(scenes.IMAGE_MARK)), little(F.col("p_size")), little(F.col("p_partkey") % 1000), little(F.lit(3)), little(kind), F.encode("p_name", "UTF-8"))
    return table(s, d, "part").select("p_partkey", scenes.native_header(f).alias("h")).select("p_partkey", "h.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nvm' WHEN 1 THEN 'photosynther' WHEN 2 THEN 'bundler' END AS kind, CASE p_size % 3 WHEN 0 THEN 'ply' WHEN 1 THEN 'binary points' END AS mesh FROM part")
def file_kinds(s, d):
    from vantage.sources import files

    head = F.get(F.array(*map(F.lit, ("NVM_V3 x\n", "drews 1.0\n1 1", "# Bundle file v0.3\n", "drews 1.0x\n"))), (F.col("p_partkey") % 4).cast("int"))
    name = F.get(F.array(*map(F.lit, ("a/b.PLY", "b.bnpts", "c.txt"))), F.col("p_size") % 3)
    return table(s, d, "part").select("p_partkey", bundles.detect_bundle(F.encode(head, "UTF-8")).alias("kind"), files.mesh_format(name).alias("mesh"))


MESH = "v AS (SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([0, 1, 2]) AS vid, p_size FROM part)"
XYZ = "CAST(p_size AS VARCHAR) || '.0 ' || CAST(vid AS VARCHAR) || '.5 0.25'"


def triangles(s, d):
    """A triangle for each part."""
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size")
    v = p.select("path", F.explode(F.array(*map(F.lit, range(3)))).alias("vid"), F.col("p_size").cast("double").alias("x")).select("path", "vid", "x", (F.col("vid") + 0.5).alias("y"), F.lit(0.25).alias("z"))
    return v, p.select("path", F.lit(0).alias("fid"), F.lit(0).alias("v0"), F.lit(1).alias("v1"), F.lit(2).alias("v2"))


@query(f"WITH {MESH} SELECT path, 1 AS part, CAST(vid AS BIGINT) AS at, 'v ' || {XYZ} AS line FROM v UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 0, 'f 1 2 3' FROM part")
def obj_lines(s, d):
    return writers.mesh_lines(*triangles(s, d), "obj")


@query(f"WITH {MESH} SELECT path, 3 AS part, CAST(vid AS BIGINT) AS at, {XYZ} AS line FROM v UNION ALL SELECT CAST(p_partkey AS VARCHAR), k, 0, CASE k WHEN 0 THEN 'Shape \"trianglemesh\"' || chr(10) || '\"integer indices\" [' WHEN 1 THEN '0 1 2' WHEN 2 THEN ']' || chr(10) || '\"point P\" [' ELSE ']' END FROM part, (VALUES (0), (1), (2), (4)) k(k)")
def renderer_lines(s, d):
    return records.pbrt_lines(*triangles(s, d))


@query(
    "WITH c AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS cam, n_nationkey AS k FROM nation), p AS (SELECT s_nationkey AS k, s_suppkey AS point FROM supplier), j AS (SELECT n_regionkey AS r, point FROM p JOIN nation ON n_nationkey = k) "
    "SELECT CAST(r AS VARCHAR) AS path, 0 AS part, CAST(0 AS BIGINT) AS at, 'drews 1.0' || chr(10) || CAST((SELECT count(*) FROM c WHERE c.r = q.r) AS VARCHAR) || ' ' || CAST((SELECT count(*) FROM j WHERE j.r = q.r) AS VARCHAR) AS line FROM (SELECT DISTINCT r FROM c) q "
    "UNION ALL SELECT CAST(r AS VARCHAR), 1, cam, CASE WHEN k = 0 THEN '0 0 0' || chr(10) || '0 0 0' || chr(10) || '0 0 0' || chr(10) || '0 0 0' || chr(10) || '0 0 0' ELSE CAST(k AS VARCHAR) || '.5 0 0.125' || chr(10) || '1 0 0' || chr(10) || '0 1 0' || chr(10) || '0 0 1' || chr(10) || CAST(k AS VARCHAR) || ' -2 1e-05' END FROM c "
    "UNION ALL SELECT CAST(r AS VARCHAR), 2, point, CAST(point AS VARCHAR) || ' 0.5 -3' || chr(10) || '255 128 0' || chr(10) || '1 0 ' || CAST(point AS VARCHAR) || ' 0' FROM j"
)
def bundle_lines(s, d):
    """A bundle for each region: nations are cameras, suppliers points."""
    from pyspark.sql import Window as W

    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    eye = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    cams = n.select(F.col("n_regionkey").cast("string").alias("path"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("cam"), F.when(k == 0, 0.0).otherwise(k + 0.5).alias("flen"), F.lit(0.0).alias("k1"), F.lit(0.125).alias("k2"), eye.alias("rot"), F.array(k.cast("double"), F.lit(-2.0), F.lit(1e-5)).alias("trans"))
    sup = table(s, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    ref = F.array(F.struct(F.lit(0).alias("view"), F.col("s_suppkey").cast("int").alias("feature"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    pts = sup.select(F.col("n_regionkey").cast("string").alias("path"), F.col("s_suppkey").cast("long").alias("point"), F.array(F.col("s_suppkey").cast("double"), F.lit(0.5), F.lit(-3.0)).alias("pos"), F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("color"), ref.alias("refs"))
    return bundles.bundle_lines(cams, pts)


@query("WITH v AS (SELECT o_custkey AS view, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT view, CAST(coalesce(sum(n) OVER (ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM v) SELECT first + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, o_totalprice AS x, CAST(o_orderkey % 10 AS DOUBLE) AS y FROM orders JOIN a ON view = o_custkey")
def correspondence_lines(s, d):
    """Orders are pixels of their customers' views."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("view_id"), F.col("o_orderkey").alias("vertex"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 10).cast("double").alias("y"))
    views = o.select("view_id").distinct().withColumns({"width": F.lit(1), "height": F.lit(1)})
    return records.correspondence_lines(views, o)[0]


@query(
    "WITH s AS (SELECT event_id, value AS scale, event_id % 7 - 1 AS conf, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS nx FROM events), w AS (SELECT *, CASE WHEN scale <= 0 THEN 'scale' WHEN conf <= 0 THEN 'conf' WHEN nx = 0 THEN 'normal' WHEN scale > 50 THEN 'large' END AS why FROM s) "
    "SELECT event_id AS vid, round(CAST(greatest(scale, 1.5) * 2 AS FLOAT), 3) AS scale, CAST(1 AS DOUBLE) AS nx FROM w WHERE why IS NULL"
)
def processed_samples(s, d):
    """Samples without scale, confidence or normal go, others are bounded, scaled and normalised."""
    e = table(s, d, "events").select(F.lit("e").alias("path"), F.col("event_id").alias("vid"), F.col("value").alias("scale"), (F.col("event_id") % 7 - 1).alias("conf"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(2.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    kept, _ = ply.process_samples(e, 2.0, 1.5, 50.0)
    return kept.select("vid", F.round(F.col("scale"), 3).alias("scale"), F.col("nx").cast("double").alias("nx"))


@query(
    "WITH s AS (SELECT value AS scale, event_id % 7 - 1 AS conf, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS nx FROM events), w AS (SELECT CASE WHEN scale <= 0 THEN 'scale' WHEN conf <= 0 THEN 'conf' WHEN nx = 0 THEN 'normal' WHEN scale > 50 THEN 'large' END AS why FROM s) "
    "SELECT count(*) FILTER (why = 'scale') AS scale, count(*) FILTER (why = 'conf') AS conf, count(*) FILTER (why = 'normal') AS normal, count(*) FILTER (why = 'large') AS large FROM w"
)
def skipped_samples(s, d):
    """How many samples went for which reason."""
    e = table(s, d, "events").select(F.lit("e").alias("path"), F.col("value").alias("scale"), (F.col("event_id") % 7 - 1).alias("conf"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(2.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    return ply.process_samples(e, 2.0, 1.5, 50.0)[1].select("scale", "conf", "normal", "large")


@query(
    "WITH p AS (SELECT c_custkey AS point, c_acctbal / 5000 AS x, CAST(c_custkey % 7 - 3 AS DOUBLE) / 4 AS y, CAST(c_custkey % 5 - 1 AS DOUBLE) AS z, [0, CAST(c_custkey % 3 AS INTEGER)] AS refs FROM customer), r AS (SELECT DISTINCT point, x, y, z, unnest(refs) AS view FROM p), "
    "v AS (SELECT point, view FROM r WHERE z > 0 AND (x - view) / z + 0.5 >= 0 AND (x - view) / z + 0.5 < 1 AND y / z + 0.5 >= 0 AND y / z + 0.5 < 1) SELECT point, view FROM v WHERE view <> 0 AND point IN (SELECT point FROM v WHERE view = 0)"
)
def visible_features(s, d):
    """Customers as points before three cameras in a row."""
    c = F.col("c_custkey")
    p = table(s, d, "customer").select(c.alias("point"), (F.col("c_acctbal") / 5000).alias("x"), ((c % 7 - 3).cast("double") / 4).alias("y"), (c % 5 - 1).cast("double").alias("z"), F.array(F.lit(0), (c % 3).cast("int")).alias("refs"))
    eye = [float(i % 4 == 0) for i in range(9)]
    cams = s.createDataFrame([(v, 1.0, 0.5, 0.5, 1.0, eye, [float(-v), 0.0, 0.0], 10, 10) for v in range(3)], "view int, flen double, ppx double, ppy double, aspect double, rot array<double>, trans array<double>, width int, height int")
    return E.visible_features(p, cams, 0)


TREE = S.NODES + ", u AS (SELECT DISTINCT level - k AS level, path >> CAST(3 * k AS INTEGER) AS path FROM n, range(7) r(k) WHERE k <= level), q AS (SELECT DISTINCT level - 1 AS level, path >> 3 AS path FROM u WHERE level > 0), a AS (SELECT level, path FROM u UNION SELECT level + 1, path * 8 + o FROM q, range(8) r(o))"


@query(TREE + " SELECT CAST(a.level AS INTEGER) AS level, CAST(a.path AS BIGINT) AS path, q.path IS NULL AS leaf FROM a LEFT JOIN q ON q.level = a.level AND q.path = a.path")
def octree_structure(s, d):
    """All nodes of the samples' octree, with all children of inner ones."""
    return O.all_nodes(O.insert_samples(S.samples(s, d), 6))


@query(TREE + " SELECT CAST(a.level + 1 AS INTEGER) AS level, CAST(a.path * 8 + o AS BIGINT) AS path FROM a LEFT JOIN q ON q.level = a.level AND q.path = a.path, range(8) r(o) WHERE q.path IS NULL")
def octree_refined(s, d):
    """The children of all leaves."""
    return O.refine(O.all_nodes(O.insert_samples(S.samples(s, d), 6))).select("level", "path")


@query(S.NODES + " SELECT sid, CAST(least(level, 2) AS INTEGER) AS level, path >> CAST(3 * greatest(0, level - 2) AS INTEGER) AS path FROM n")
def octree_limited(s, d):
    """Samples of deep nodes in their ancestors."""
    return O.limit_level(O.insert_samples(S.samples(s, d), 6), 2).select("sid", "level", "path")


VOLUME = "g AS (SELECT CAST(p_partkey % 8 AS BIGINT) AS x, CAST(p_partkey // 8 % 8 AS BIGINT) AS y, CAST(p_partkey // 64 AS BIGINT) AS z, CAST(p_size - 25 AS DOUBLE) AS v FROM part)"


@query(f"WITH {VOLUME}, c AS (SELECT a.x, a.y, a.z, count(*) AS n, sum(CASE WHEN b.v < 0 THEN CAST(pow(2, (b.x - a.x) + 2 * (b.y - a.y) + 4 * (b.z - a.z)) AS BIGINT) ELSE 0 END) AS mask FROM (SELECT x, y, z FROM g) a JOIN g b ON b.x BETWEEN a.x AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 1 AND b.z BETWEEN a.z AND a.z + 1 GROUP BY 1, 2, 3) SELECT x, y, z, CAST(mask AS INTEGER) AS mask FROM c WHERE n = 8")
def cube_cases(s, d):
    """Which corners of a volume's cubes are below zero."""
    k = F.col("p_partkey").cast("long")
    v = table(s, d, "part").select((k % 8).alias("x"), (F.floor(k / 8) % 8).alias("y"), F.floor(k / 64).alias("z"), (F.col("p_size") - 25).cast("double").alias("v"))
    return O.cubes(v).select("x", "y", "z", O.cube_index(F.col("corners")).alias("mask"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '.5 -1 0.25 1e-05 100 0' AS text, CAST(p_size + 0.5 AS DOUBLE) AS first, CAST(0.25 AS DOUBLE) AS third FROM part")
def rotation_texts(s, d):
    """Numbers as text with ten significant digits, and back."""
    v = [F.col("p_size") + 0.5, *(F.lit(x) for x in (-1.0, 0.25, 1e-5, 100.0, 0.0))]
    t = table(s, d, "part").select("p_partkey", G.rotation_string(v).alias("text"))
    back = G.rotation_of_string(F.col("text"), 6)
    return t.select("p_partkey", "text", back[0].alias("first"), back[2].alias("third"))
