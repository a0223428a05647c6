"""Queries of scalar functions (strings, paths, colours, numbers) and of images, each with its SQL.

An embedding stands for an image of 8 by 8 pixels, so that every row is one image.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vantage.functions import columns as C
from vantage.functions import patches as P
from vantage.operators import images as I

from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# --- strings ---


@query("SELECT c_custkey, printf('%.2f', c_acctbal) AS fixed, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 4 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS filled, CAST(c_custkey AS VARCHAR) AS text, CAST(coalesce(nullif(regexp_extract(c_name, '#0*([0-9]+)', 1), ''), '0') AS INTEGER) AS number, 0 AS none, left(c_name, 3) AS head, right(c_name, 4) AS tail, lower(c_name) AS low, upper(c_name) AS high FROM customer")
def text_numbers(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", C.get_fixed(F.col("c_acctbal"), 2).alias("fixed"), C.get_filled(F.col("c_custkey"), 4).alias("filled"), C.to_text(F.col("c_custkey")).alias("text"), C.convert(F.regexp_replace("c_name", "^[^#]*#", ""), "int").alias("number"), C.convert(F.col("c_name"), "int").alias("none"), C.left(F.col("c_name"), 3).alias("head"), C.right(F.col("c_name"), 4).alias("tail"), C.lowercase(F.col("c_name")).alias("low"), C.uppercase(F.col("c_name")).alias("high"))


@query(
    "WITH n AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) * (o_custkey + 1) AS n FROM orders), v AS (SELECT *, CASE WHEN n < 1000 THEN n * 1.0 WHEN n < 1024000 THEN n / 1024.0 WHEN n < 1048576000 THEN n / 1048576.0 ELSE n / 1073741824.0 END AS v FROM n) "
    "SELECT o_orderkey, (CASE WHEN v >= 10 THEN CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', v) END) || (CASE WHEN n < 1000 THEN ' B' WHEN n < 1024000 THEN ' KB' WHEN n < 1048576000 THEN ' MB' ELSE ' GB' END) AS size FROM v WHERE abs(v * 20 - round(v * 20)) > 0.001"
)
def size_texts(s, d):
    key, customer = F.col("o_orderkey").cast("decimal(20,0)"), F.col("o_custkey").cast("decimal(20,0)") + 1
    # products beyond 64 bits are exact to 38 digits; past those the double is as near as the text can show
    n = F.coalesce(F.try_multiply(F.try_multiply(key, key), customer).cast("double"), key.cast("double") * key.cast("double") * customer.cast("double"))
    v = F.when(n < 1000, n * 1.0).when(n < 1024000, n / 1024.0).when(n < 1048576000, n / 1048576.0).otherwise(n / 1073741824.0)
    return table(s, d, "orders").where(F.abs(v * 20 - F.round(v * 20)) > 0.001).select("o_orderkey", C.size_text(n).alias("size"))


@query(
    "SELECT p_partkey, [p_brand || 'a b', 'x', ''] AS parts, p_brand || 'a b x' AS joined, list_aggregate([p_name], 'string_agg', ' ') AS same, "
    "CASE WHEN length(p_brand) + 1 + 3 <= 12 THEN p_brand || ' end' ELSE p_brand || chr(10) || 'end' END AS wrapped FROM part"
)
def text_tokens(s, d):
    p = table(s, d, "part")
    cmd = F.concat(F.lit('"'), F.col("p_brand"), F.lit('a b" x '))
    parts = C.parse_cmd(cmd)
    return p.select("p_partkey", parts.alias("parts"), C.concat_tokens(parts, 0, 2).alias("joined"), C.concat_tokens(F.array(F.col("p_name")), 0).alias("same"), C.wordwrap(F.concat(F.col("p_brand"), F.lit(" end")), 12).alias("wrapped"))


@query(
    "SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '(.)/$', '\\1') AS clean, 'base/' || CAST(page_id AS VARCHAR) || '.a' AS below, '/abs' AS own, '/cwd/x.JPG' AS whole, true AS absolute, 'dir.d/file' AS bare, page_id % 2 = 0 AS jpeg FROM pages"
)
def paths(s, d):
    p = table(s, d, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".a/"))
    return p.select("page_id", C.sanitize_path(F.col("url")).alias("clean"), C.join_path(F.lit("base//"), name).alias("below"), C.join_path(F.lit("x"), F.lit("/abs/")).alias("own"), C.abspath(F.lit("x.JPG"), "/cwd").alias("whole"), C.is_absolute(F.lit("/a")).alias("absolute"), C.remove_extension(F.lit("dir.d/file.tar")).alias("bare"), C.has_jpeg_extension(F.when(F.col("page_id") % 2 == 0, "A.JpEg").otherwise("a.jpx")).alias("jpeg"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 0 END AS bytes, CASE p_size % 4 WHEN 0 THEN 'float' WHEN 1 THEN 'uint16' WHEN 2 THEN 'double' END AS name FROM part")
def type_names(s, d):
    own = F.get(F.array(*map(F.lit, ("float32", "uint16", "float64", "text"))), F.col("p_size") % 4)
    name = C.name_of_type(own)
    return table(s, d, "part").select("p_partkey", C.size_of_type(F.coalesce(name, own)).alias("bytes"), name.alias("name"))


# --- numbers and colours: three values from 0 to 1 of each part ---

RGB = "WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS r, (CAST(p_retailprice AS DOUBLE) % 100) / 100 AS g, CAST(p_partkey % 97 AS DOUBLE) / 97 AS b FROM part)"


def colors(s, d):
    return table(s, d, "part").select("p_partkey", (F.col("p_size").cast("double") / 50).alias("r"), ((F.col("p_retailprice").cast("double") % 100) / 100).alias("g"), ((F.col("p_partkey") % 97).cast("double") / 97).alias("b"))


@query(RGB + " SELECT p_partkey, round(exp(-r / 0.5), 9) AS xx, round(exp(-(r * r / 0.5 + g * g / 2)), 9) AS two, CASE WHEN 9 * r - 4 > 0 THEN floor(9 * r - 3.5) ELSE ceil(9 * r - 4.5) END + 0.0 AS rounded, round(0.25 * r + 0.75 * g, 9) AS mixed, CAST(floor(255 * (0.25 * r + 0.75 * g) + 0.5) AS INTEGER) AS byte, round(pow(r, 5), 9) AS power, CASE WHEN r * 100 - 60 < 3 THEN 63 - r * 100 WHEN r * 100 - 60 > 20 THEN 100 - r * 100 ELSE r * 100 - 60 END AS mirrored FROM t")
def scalar_functions(s, d):
    r, g = F.col("r"), F.col("g")
    out = {"xx": F.round(C.gaussian_xx(r, 0.5), 9), "two": F.round(C.gaussian_2d(r, g, 0.5, 1.0), 9), "rounded": C.round_half_away(9 * r - 4), "mixed": F.round(C.interpolate([r, g], [0.25, 0.75]), 9), "byte": C.interpolate([255 * C.interpolate([r, g], [0.25, 0.75])], [1.0], True), "power": F.round(C.fastpow(r, 5), 9), "mirrored": C.bound_mirror(r * 100 - 60, 3, 20)}
    return colors(s, d).select("p_partkey", *(c.alias(n) for n, c in out.items()))


@query(
    "WITH t AS (SELECT o_orderkey, CAST(o_orderkey * 7919 % 65536 AS INTEGER) AS raw, CAST(o_custkey % 256 AS INTEGER) AS a, CAST(o_orderkey % 256 AS INTEGER) AS b FROM orders) SELECT o_orderkey, least(255, abs(raw - 30000)) AS whole, CAST(floor(255.0 * (least(60000, greatest(1000, raw)) - 1000) / 59000.0) AS INTEGER) AS byte, round(raw / 65535.0, 9) AS unit, round(pow(raw / 65535.0, 2.2), 9) AS gamma, CAST(floor(pow(a / 255.0, 0.5) * 255 + 0.5) AS INTEGER) AS curve, (a - b + 256) % 256 AS wrapped, abs(a - b) AS apart, CAST(bit_count(raw) AS INTEGER) AS ones FROM t"
)
def pixel_values(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 65536).cast("int").alias("raw"), (F.col("o_custkey") % 256).cast("int").alias("a"), (F.col("o_orderkey") % 256).cast("int").alias("b"))
    raw, a, b = F.col("raw"), F.col("a"), F.col("b")
    out = {"whole": C.int_to_byte(raw - 30000), "byte": C.raw_to_byte(raw, 1000, 60000), "unit": F.round(C.raw_to_float(raw), 9), "gamma": F.round(C.gamma_correct(C.raw_to_float(raw), 2.2), 9), "curve": C.gamma_correct_byte(a, 0.5), "wrapped": C.subtract_byte(a, b), "apart": C.difference(a, b), "ones": C.popcount(raw)}
    return o.select("o_orderkey", *(c.alias(n) for n, c in out.items()))


@query(
    RGB + " SELECT p_partkey, round(3.2410 * r - 1.5374 * g - 0.4986 * b, 6) + 0.0 AS red, round(-0.9692 * r + 1.8760 * g + 0.0416 * b, 6) + 0.0 AS green, round(0.0556 * r - 0.2040 * g + 1.0570 * b, 6) + 0.0 AS blue, round(-0.168736 * r - 0.331264 * g + 0.5 * b + 0.5, 6) + 0.0 AS cb, round(0.5 * r - 0.418688 * g - 0.081312 * b + 0.5, 6) + 0.0 AS cr, round(r + 1.402 * (b - 0.5), 6) + 0.0 AS yr, round(r - 0.34414 * (g - 0.5) - 0.71414 * (b - 0.5), 6) + 0.0 AS yg, "
    "round(CASE WHEN g = 0 THEN 0 ELSE r * b / g END, 4) + 0.0 AS x, round(CASE WHEN g = 0 THEN 0 ELSE b END, 6) + 0.0 AS y, round(CASE WHEN g = 0 THEN 0 ELSE (1 - r - g) * b / g END, 4) + 0.0 AS z, round(b * 3, 6) + 0.0 AS grey, CASE WHEN b < 0.2 THEN 255 WHEN b > 0.8 THEN 0 ELSE CAST(floor(pow((b - 0.2) / (0.8 - 0.2), 0.5) * 255 + 0.5) AS INTEGER) END AS toned FROM t"
)
def color_spaces(s, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    red, green, blue = C.color_matrix(C.XYZ_TO_SRGB, r, g, b)
    _, cb, cr = C.rgb_to_ycbcr(r, g, b)
    yr, yg, _ = C.ycbcr_to_rgb(r, g, b)
    x, y, z = C.xyy_to_xyz(r, g, b)
    out = {"red": (red, 6), "green": (green, 6), "blue": (blue, 6), "cb": (cb, 6), "cr": (cr, 6), "yr": (yr, 6), "yg": (yg, 6), "x": (x, 4), "y": (y, 6), "z": (z, 4), "grey": (sum(C.reduce_alpha([*C.expand_grayscale(b), r])), 6)}
    toned = F.get(C.tone_map(b, 0.2, 0.8, 0.5, True), F.lit(2))
    return colors(s, d).select("p_partkey", *(F.round(c, n).alias(k) for k, (c, n) in out.items()), F.when(b > 0.8, F.lit(0)).otherwise(toned).alias("toned"))


# --- images ---

SIZE = 8
PIXELS = "WITH p AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) // 8 AS y, (generate_subscripts(embedding, 1) - 1) % 8 AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
SUMS = "SELECT vec_id, count(*) AS pixels, round(sum(v * (1 + x + 3 * y)), 4) + 0.0 AS total FROM {} GROUP BY vec_id"


def image_rows(s, d):
    """Each embedding as an image of doubles."""
    pack = F.transform("embedding", lambda x: x.cast("double"))
    e = table(s, d, "embeddings").select("vec_id", pack.alias("v"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = [np.array(v, float).tobytes() for v in b.column(1).to_pylist()]
            n = len(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([SIZE] * n, pa.int32()), pa.array([SIZE] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(["float64"] * n), pa.array(data, pa.binary())], names=["vec_id", "width", "height", "channels", "type", "data"])

    return e.mapInArrow(run, f"vec_id {dict(e.dtypes)['vec_id']}, width int, height int, channels int, type string, data binary")


def image_sums(images):
    """vec_id, pixels and the sum of the values weighted by place, of each image."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, total = [], []
            for r in b.to_pylist():
                v = I.array_of(r)[..., 0]
                n.append(v.size)
                total.append(round(float((v * (1 + np.arange(v.shape[1]) + 3 * np.arange(v.shape[0])[:, None])).sum()), 4) + 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(total)], names=["vec_id", "pixels", "total"])

    return images.mapInArrow(run, f"vec_id {dict(images.dtypes)['vec_id']}, pixels long, total double")


def image_query(sql: str, kernel):
    """A query of one kernel: sql makes pixels o (vec_id, x, y, v)."""

    def register(f):
        QUERIES[f.__name__] = lambda s, d: image_sums(I.on_images(image_rows(s, d), kernel))
        SQL[f.__name__] = PIXELS + ", " + sql + " " + SUMS.format("o")
        return f

    return register


@image_query("o AS (SELECT vec_id, 7 - y AS x, 7 - x AS y, v FROM p)", lambda v: I.rotate(I.rotate(v, "swap"), "180"))
def image_turns():
    """Rows and columns swapped, then turned around."""


@image_query("o AS (SELECT vec_id, 7 - y AS x, 7 - x AS y, v FROM p)", lambda v: I.flip(I.rotate(v, "cw"), vertical=True))
def image_flips():
    """A quarter turn clockwise, flipped."""


@image_query("g AS (SELECT vec_id, y, x FROM (SELECT DISTINCT vec_id FROM p), range(6) a(y), range(7) b(x)), o AS (SELECT g.vec_id, g.x, g.y, coalesce(p.v, 0.5) AS v FROM g LEFT JOIN p ON p.vec_id = g.vec_id AND p.x = g.x - 2 AND p.y = g.y + 4)", lambda v: I.crop(v, 7, 6, -2, 4, 0.5))
def image_crop():
    """A part and what lies outside."""


@image_query("o AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM p GROUP BY ALL)", I.half_size)
def image_half_size():
    """Means of 2 by 2 pixels."""


@image_query("o AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, v FROM p WHERE x % 2 = 0 AND y % 2 = 0)", I.half_size_subsample)
def image_subsample():
    """Every second pixel."""


GRID = "g AS (SELECT vec_id, y, x FROM (SELECT DISTINCT vec_id FROM p), range({h}) a(y), range({w}) b(x))"
NEAR = "least(7, greatest(0, {}))"
W4 = [math.exp(-((i - 0.5) ** 2) / (2 * 0.75)) for i in (-1, 0, 1, 2)]


@image_query(
    GRID.format(h=4, w=4) + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({W4[i + 1]!r} AS DOUBLE))" for i in (-1, 0, 1, 2)) + f") k(i, w)), o AS (SELECT g.vec_id, g.x, g.y, sum(p.v * a.w * b.w) / sum(a.w * b.w) AS v FROM g, k a, k b, p WHERE p.vec_id = g.vec_id AND p.x = {NEAR.format('2 * g.x + a.i')} AND p.y = {NEAR.format('2 * g.y + b.i')} GROUP BY g.vec_id, g.x, g.y)",
    I.half_size_gaussian,
)
def image_half_size_gaussian():
    """Gaussian weights of 4 by 4 pixels."""


@image_query(GRID.format(h=16, w=16) + f", k AS (SELECT * FROM (VALUES (0, CAST(0.75 AS DOUBLE)), (1, CAST(0.25 AS DOUBLE))) k(i, w)), o AS (SELECT g.vec_id, g.x, g.y, sum(p.v * a.w * b.w) AS v FROM g, k a, k b, p WHERE p.vec_id = g.vec_id AND p.x = {NEAR.format('g.x // 2 + a.i * (2 * (g.x % 2) - 1)')} AND p.y = {NEAR.format('g.y // 2 + b.i * (2 * (g.y % 2) - 1)')} GROUP BY g.vec_id, g.x, g.y)", I.double_size)
def image_double_size():
    """Twice as large, by quarters."""


@image_query(GRID.format(h=16, w=16) + f", k AS (SELECT unnest([0, 1]) AS i), o AS (SELECT g.vec_id, g.x, g.y, avg(p.v) AS v FROM g, k a, k b, p WHERE p.vec_id = g.vec_id AND p.x = {NEAR.format('(g.x + a.i) // 2')} AND p.y = {NEAR.format('(g.y + b.i) // 2')} GROUP BY g.vec_id, g.x, g.y)", I.double_size_supersample)
def image_supersample():
    """Twice as large, by means."""


@image_query(GRID.format(h=5, w=6) + ", o AS (SELECT g.vec_id, g.x, g.y, p.v FROM g JOIN p ON p.vec_id = g.vec_id AND p.x = CAST(floor((g.x + 0.5) * 8 / 6) AS BIGINT) AND p.y = CAST(floor((g.y + 0.5) * 8 / 5) AS BIGINT))", lambda v: I.rescale(v, "nearest", 6, 5))
def image_nearest():
    """6 by 5 pixels, the nearest ones."""


LINEAR = "s AS (SELECT *, {x} AS fx, {y} AS fy FROM g), o AS (SELECT s.vec_id, s.x, s.y, sum(p.v * greatest(0, 1 - abs(p.x - least(7, greatest(0, fx)))) * greatest(0, 1 - abs(p.y - least(7, greatest(0, fy))))) AS v FROM s JOIN p ON p.vec_id = s.vec_id{inside} GROUP BY s.vec_id, s.x, s.y)"


@image_query(GRID.format(h=12, w=10) + ", " + LINEAR.format(x="(x + 0.5) * 8 / 10 - 0.5", y="(y + 0.5) * 8 / 12 - 0.5", inside=""), lambda v: I.rescale(v, "linear", 10, 12))
def image_linear():
    """10 by 12 pixels, bilinear."""


R = "(pow((x + 0.5 - 4) / 8, 2) + pow((y + 0.5 - 4) / 8, 2)) / 1.44"
FACTOR = f"(1 - 0.3 * {R} + 0.1 * pow({R}, 2))"


@image_query(GRID.format(h=8, w=8) + ", " + LINEAR.format(x=f"(x + 0.5 - 4) * {FACTOR} + 3.5", y=f"(y + 0.5 - 4) * {FACTOR} + 3.5", inside=""), lambda v: I.undistort_k2k4(v, 1.2, -0.3, 0.1))
def image_undistort():
    """Radial distortion of two terms taken out."""


WG = [math.exp(-(i**2) / (2 * 0.8**2)) for i in range(-3, 4)]


@image_query(
    GRID.format(h=8, w=8) + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({WG[i + 3]!r} AS DOUBLE))" for i in range(-3, 4)) + f") k(i, w)), o AS (SELECT g.vec_id, g.x, g.y, sum(p.v * a.w * b.w) / sum(a.w * b.w) AS v FROM g, k a, k b, p WHERE p.vec_id = g.vec_id AND p.x = {NEAR.format('g.x + a.i')} AND p.y = {NEAR.format('g.y + b.i')} GROUP BY g.vec_id, g.x, g.y)",
    lambda v: I.blur_gaussian(v, 0.8),
)
def image_blur():
    """A Gaussian of 0.8 pixels."""


@query(PIXELS + ", o AS (SELECT a.vec_id, a.x, a.y, abs(a.v - b.v) + (a.v - b.v) AS v FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.x = 7 - a.x AND b.y = a.y) " + SUMS.format("o"))
def image_difference(s, d):
    """An image against its mirror image: distance and difference."""
    a = image_rows(s, d)
    return image_sums(I.on_pairs(a, I.on_images(a, lambda v: I.flip(v, horizontal=True)), "vec_id", lambda x, y: I.difference(x, y) + I.subtract(x, y)))


@query(PIXELS + ", l AS (SELECT vec_id, x, y, CASE WHEN x IN (2, 3) AND y IN (2, 3, 4) THEN 1.0 WHEN (x - y = 0) THEN 2.0 ELSE v END AS v FROM p) " + SUMS.format("l"))
def image_drawing(s, d):
    """A diagonal and a rectangle drawn into each image."""
    return image_sums(I.on_images(image_rows(s, d), lambda v: I.draw_rectangle(I.draw_line(v, 0, 0, 7, 7, 2.0), 3, 4, 2, 2, 1.0)))


# --- patches: ten colour samples in the first 30 values of an embedding against the next 30 ---

SAMPLES = "WITH s AS (SELECT vec_id, CAST(i AS BIGINT) AS i, i % 3 AS c, CAST(embedding[i + 1] AS DOUBLE) AS a, CAST(embedding[i + 31] AS DOUBLE) AS b, 1.0 / (1 + i // 3) AS w FROM embeddings, range(30) r(i)), m AS (SELECT vec_id, c, avg(a) AS ma, avg(b) AS mb, sum(a * b) / sum(b * b) AS k FROM s GROUP BY 1, 2), j AS (SELECT s.*, ma, mb, k FROM s JOIN m ON m.vec_id = s.vec_id AND m.c = s.c)"


@query(SAMPLES + " SELECT vec_id, round(sum((a - ma) * (b - mb)) / sqrt(sum(pow(a - ma, 2)) * sum(pow(b - mb, 2))), 6) + 0.0 AS ncc, round(sum(abs(2 * b - a)), 6) AS sad, round(sum(pow(k * b - a, 2)), 6) AS ssd, round(max(k) FILTER (c = 1), 4) + 0.0 AS green, round(sum(w * pow(k * b - a, 2)), 6) AS weighted, round(sum(w * pow(k * b, 2)), 6) AS slope FROM j GROUP BY vec_id")
def patch_differences(s, d):
    """Correlation and distances of two patches, with the colour scale that brings them nearest."""
    a, b = F.slice("embedding", 1, 30), F.slice("embedding", 31, 30)
    e = table(s, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    k = P.color_scale(F.col("a"), F.col("b"))
    e = e.select("vec_id", "a", "b", *(x.alias(f"k{i}") for i, x in enumerate(k)))
    two, k = [F.lit(2.0)] * 3, [F.col(f"k{i}") for i in range(3)]
    weights = F.array(*(F.lit(1.0 / (1 + i)) for i in range(10)))
    out = {"ncc": P.ncc(F.col("a"), F.col("b")) , "sad": P.sad(F.col("a"), F.col("b"), two), "ssd": P.ssd(F.col("a"), F.col("b"), k), "weighted": P.objective(F.col("a"), F.col("b"), k, weights), "slope": P.derivative_norm(F.col("b"), k, weights)}
    return e.select("vec_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in out.items()), (F.round("k1", 4) + 0.0).alias("green"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 OR p_retailprice % 10 / 10 < 0.2 THEN 0 ELSE ((p_size / 50.0 + 0.8) / 2 - 0.6) / 0.4 END, 6) + 0.0 AS confidence, round((CASE WHEN p_size < 10 THEN pow(p_size / 10.0, 2) ELSE 1 END) * (CASE WHEN p_retailprice / 500 > 2 THEN 1000 / p_retailprice WHEN p_retailprice / 500 > 1 THEN 1 ELSE p_retailprice / 500 END) * (CASE WHEN p_partkey % 20 < 10 THEN pow(p_partkey % 20 / 10.0, 2) ELSE 1 END), 6) AS benefit FROM part")
def view_scores(s, d):
    """Confidences of patches and what further views are worth."""
    p, size, price = table(s, d, "part"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    conf = P.confidence(F.array(size / 50.0, F.lit(0.8)), 0.6, price % 10 / 10, F.col("p_size") % 5 != 0)
    benefit = P.view_benefit(size, price, F.lit(500.0), F.array((F.col("p_partkey") % 20).cast("double")))
    return p.select("p_partkey", (F.round(conf, 6) + 0.0).alias("confidence"), F.round(benefit, 6).alias("benefit"))
