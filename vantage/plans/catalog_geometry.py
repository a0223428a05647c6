"""Queries of vectors, matrices, geometry, cameras and estimators, on points taken from the embeddings, each with its SQL.

The SQL is written from the definitions, with its own expressions for vectors as lists of terms.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vantage.functions import geometry as G
from vantage.functions import vectors as V
from vantage.operators import estimators as E

from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


#: The first 24 components of each embedding as e0 to e23.
TERMS = "WITH t AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(24)) + " FROM embeddings)"


def terms(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(24)))


def at(i: int, n: int = 3) -> list:
    return [F.col(f"e{k}") for k in range(i, i + n)]


def named(columns: dict, digits: int | None = 6) -> list:
    return [(F.round(c, digits) + 0.0 if digits is not None else c).alias(n) for n, c in columns.items()]


# --- the same in SQL ---


def q(i: int, n: int = 3) -> list[str]:
    return [f"e{k}" for k in range(i, i + n)]


def q_sum(xs) -> str:
    return "(" + " + ".join(xs) + ")"


def q_dot(a, b) -> str:
    return q_sum(f"({x})*({y})" for x, y in zip(a, b, strict=True))


def q_sub(a, b) -> list[str]:
    return [f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True)]


def q_cross(a, b) -> list[str]:
    return [f"(({a[1]})*({b[2]}) - ({a[2]})*({b[1]}))", f"(({a[2]})*({b[0]}) - ({a[0]})*({b[2]}))", f"(({a[0]})*({b[1]}) - ({a[1]})*({b[0]}))"]


def q_norm(a) -> str:
    return f"sqrt({q_dot(a, a)})"


def q_unit(a) -> list[str]:
    return [f"(({x}) / {q_norm(a)})" for x in a]


def q_mul(a, b, inner: int) -> list[str]:
    rows, cols = len(a) // inner, len(b) // inner
    return [q_sum(f"({a[i * inner + k]})*({b[k * cols + j]})" for k in range(inner)) for i in range(rows) for j in range(cols)]


def q_round(columns: dict, digits: int | None = 6, rest: str = "FROM t") -> str:
    return TERMS + " SELECT vec_id, " + ", ".join((f"round({c}, {digits}) + 0.0" if digits is not None else c) + f" AS {n}" for n, c in columns.items()) + " " + rest


LIST = "[CAST(x AS DOUBLE) FOR x IN embedding]"


@query(f"SELECT vec_id, list_min({LIST}) AS low, list_max({LIST}) AS high, round(list_sum({LIST}), 6) + 0.0 AS total, round(list_sum([abs(x) FOR x IN {LIST}]), 6) + 0.0 AS l1, round(list_product({LIST}[1:6]) * 1e6, 6) + 0.0 AS product, round(sqrt(list_sum([x * x FOR x IN {LIST}])), 6) + 0.0 AS l2, round(list_sum([x * x FOR x IN {LIST}]), 6) + 0.0 AS l2_squared FROM embeddings")
def vector_reductions(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", V.array_min(e).alias("low"), V.array_max(e).alias("high"), *named({"total": V.array_sum(e), "l1": V.array_abs_sum(e), "product": V.array_product(F.slice(e, 1, 6)) * 1e6, "l2": V.array_norm(e), "l2_squared": V.array_square_norm(e)}))


@query(
    f"WITH t AS (SELECT vec_id, {LIST} AS v, {LIST}[1:8] AS a, {LIST}[9:16] AS b FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum([x * x FOR x IN v])), 6) + 0.0 AS unit0, round(abs(v[2]), 6) + 0.0 AS abs1, round(-v[3], 6) + 0.0 AS neg2, "
    "round(list_sum([a[i] * b[i] FOR i IN range(1, 9)]), 6) + 0.0 AS dot, round(a[8] * b[8], 6) + 0.0 AS prod7, round(a[1] / b[1], 4) + 0.0 AS ratio0, list_max([abs(a[i] - b[i]) FOR i IN range(1, 9)]) <= 0.3 AS similar, false AS has_nan, round(2 * v[5] + 1, 6) + 0.0 AS applied, list_sort(v)[1] AS first, list_reverse_sort(v)[2] AS second, a[3] AS moved, a[8] AS source0 FROM t"
)
def vector_maps(s, d):
    e, a, b = F.col("embedding"), F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)
    to = F.array(*(F.lit((i * 3 + 1) % 8) for i in range(8)))
    get = lambda c, i: F.get(c, F.lit(i))
    out = {"unit0": get(V.array_normalize(e), 0), "abs1": get(V.array_abs(e), 1), "neg2": get(V.array_negate(e), 2), "dot": V.array_sum(V.array_cw_mult(a, b)), "prod7": get(V.array_cw_mult(a, b), 7)}
    plain = {"similar": V.array_is_similar(a, b, 0.3), "has_nan": V.array_any_nan(e), "first": get(V.array_sorted(V.doubles(e)), 0), "second": get(V.array_sorted(V.doubles(e), True), 1), "moved": get(V.array_permute(V.doubles(a), to), 7), "source0": get(V.array_permute_math(V.doubles(a), F.reverse(F.sequence(F.lit(0), F.lit(7)))), 0)}
    return table(s, d, "embeddings").select("vec_id", *named(out), F.round(get(V.array_cw_div(a, b), 0), 4).alias("ratio0"), F.round(get(V.array_apply(e, lambda x: 2 * x + 1), 4), 6).alias("applied"), *named(plain, None))


@query(q_round({**{f"c{i}": x for i, x in enumerate(q_cross(q(0), q(3)))}, **{f"n{i}": x for i, x in enumerate(q_unit(q(6)))}, "low": "least(e0, e1, e2)", "mid": "list_sort([e0, e1, e2])[2]", "high": "greatest(e0, e1, e2)"}))
def vector_cross(s, d):
    low, mid, high = V.sort_three(*at(0))
    return terms(s, d).select("vec_id", *named({**{f"c{i}": x for i, x in enumerate(V.cross(at(0), at(3)))}, **{f"n{i}": x for i, x in enumerate(V.normalize(at(6)))}, "low": low, "mid": mid, "high": high}))


M, N = q(0, 9), q(9, 9)
MN = q_mul(M, N, 3)


@query(
    q_round(
        {**{f"p{i}": x for i, x in enumerate(MN)}, "v1": q_dot(M[3:6], q(18)), "t01": "e3", "ata": q_dot([M[0], M[3], M[6]], [M[1], M[4], M[7]]), "row": q_sum(M[3:6]), "col": q_sum(M[1::3]), "h": "e0 + 2*e1 + 3*e2 + 4*e18", "v": "e6 + e7 + e8 + e18 + e19 + e20", "dr": "e0 + e1 + e2 + e6 + e7 + e8", "dc": "e0 + e2 + e3 + e5 + e6 + e8", "low": f"least({', '.join(M)})", "high": f"greatest({', '.join(M)})", "tr": "e0 + e4 + e8", "diag": "e0*e4*e8"}
    )
)
def matrix_products(s, d):
    m, n, v = at(0, 9), at(9, 9), at(18)
    h = V.hstack(m, v, 3)
    diag = V.from_diagonal(V.diagonal(m, 3))
    return terms(s, d).select(
        "vec_id",
        *named({**{f"p{i}": x for i, x in enumerate(V.mat_mult(m, n, 3))}, "v1": V.mat_vec(m, v)[1], "t01": V.transposed(m, 3)[1], "ata": V.transpose_multiply(m, 3)[1], "row": V.total(V.mat_row(m, 1, 3)), "col": V.total(V.mat_col(m, 1, 3)), "h": V.total((k + 1) * x for k, x in enumerate(h[:4])), "v": V.total(V.vstack(m, v)[6:]), "dr": V.total(V.delete_row(m, 1, 3)), "dc": V.total(V.delete_col(m, 1, 3)), "low": V.mat_minimum(m), "high": V.mat_maximum(m), "tr": V.trace(m, 3), "diag": V.determinant(diag, 3)}),
    )


DET3 = q_dot(q(0), q_cross(q(3), q(6)))


def q_det(m: list[str], n: int) -> str:
    if n == 1:
        return m[0]
    return q_sum(f"({'-' if j % 2 else ''}1)*({m[j]})*({q_det([m[r * n + c] for r in range(1, n) for c in range(n) if c != j], n - 1)})" for j in range(n))


ROWS = [[f"e{4 * r + c} + {2 if r == c else 0}" for c in range(4)] for r in range(4)]
FLAT4 = [x for r in ROWS for x in r]


@query(q_round({"det": DET3, "det4": q_det(FLAT4, 4), "i00": f"{q_det([FLAT4[4 * r + c] for r in (1, 2, 3) for c in (1, 2, 3)], 3)} / {q_det(FLAT4, 4)}", "i31": f"{q_det([FLAT4[4 * r + c] for r in (0, 2, 3) for c in (0, 1, 2)], 3)} / {q_det(FLAT4, 4)}", "one": "CAST(1 AS DOUBLE)", "zero": "CAST(0 AS DOUBLE)"}))
def matrix_inverses(s, d):
    m = [x + (2.0 if i % 5 == 0 else 0.0) for i, x in enumerate(at(0, 16))]
    inv = V.inverse(m, 4)
    three = [m[4 * i + j] for i in range(3) for j in range(3)]
    both = V.mat_mult(three, V.inverse(three, 3, V.determinant(three, 3)), 3)
    return terms(s, d).select("vec_id", *named({"det": V.determinant(at(0, 9), 3), "det4": V.determinant(m, 4), "i00": inv[0], "i31": inv[13], "one": both[4], "zero": both[1] + 0.0 * both[2] + F.lit(0.0)}, 6)).withColumn("zero", F.abs("zero"))


U = q_unit(q(0))
ROT = [f"(CASE WHEN {i} = {j} THEN cos(e3) ELSE 0 END + (1 - cos(e3))*{U[i]}*{U[j]} + sin(e3)*({sign}))" for i in range(3) for j, sign in enumerate([["0", f"-{U[2]}", U[1]], [U[2], "0", f"-{U[0]}"], [f"-{U[1]}", U[0], "0"]][i])]


@query(q_round({**{f"r{i}": x for i, x in enumerate(ROT)}, "inv3": "-" + q_dot([ROT[0], ROT[3], ROT[6]], q(4)), "identity": "CAST(1 AS DOUBLE)", "f0": "(1 + abs(e5)) / (2 + e6)", "f11": "-2.0 * (9 + e7) * (1 + abs(e5)) / (9 + e7 - (1 + abs(e5)))", "quat0": "cos(e3 / 2)", "turned": q_dot(ROT[:3], q(4)), "angle": "abs(e3)"}))
def rotations(s, d):
    axis = V.normalize(at(0))
    r = V.axis_angle_matrix(axis, F.col("e3"))
    rigid = [*r[:3], F.col("e4"), *r[3:6], F.col("e5"), *r[6:], F.col("e6"), *(F.lit(float(i == 3)) for i in range(4))]
    inv = V.invert_rigid(rigid)
    f = V.frustum(1 + F.abs("e5"), 9 + F.col("e7"), 3 + F.col("e8"), 2 + F.col("e6"))
    quat = V.quaternion(axis, F.col("e3"))
    same = V.is_identity(V.mat_mult(rigid, inv, 4), 4, 1e-9).cast("double")
    back = V.axis_angle(V.quaternion_of(r))
    return terms(s, d).select("vec_id", *named({**{f"r{i}": x for i, x in enumerate(r)}, "inv3": inv[3], "identity": same, "f0": f[0], "f11": f[11], "quat0": quat[0], "turned": V.rotate(quat, at(4))[0], "angle": back[3]}))


EYE = q_unit(q(3))
X = q_unit(q_cross(q(6), [f"(-{x})" for x in EYE]))
Y = q_cross([f"(-{x})" for x in EYE], X)


@query(q_round({**{f"x{i}": x for i, x in enumerate(X)}, **{f"y{i}": x for i, x in enumerate(Y)}, "z0": f"-{EYE[0]}", "tx": "-" + q_dot(X, q(0)), "tz": q_dot(EYE, q(0)), "moved": f"{q_dot(Y, q(9))} - {q_dot(Y, q(0))}"}))
def look_at(s, d):
    m = V.look_at(at(0), V.normalize(at(3)), at(6))
    return terms(s, d).select("vec_id", *named({**{f"x{i}": m[i] for i in range(3)}, **{f"y{i}": m[4 + i] for i in range(3)}, "z0": m[8], "tx": m[3], "tz": m[11], "moved": V.transform_point(m, at(9))[1]}))


A, B, C, D, P = q(0), q(3), q(6), q(9), q(12)
SIX = f"({q_dot(q_sub(B, A), q_cross(q_sub(C, A), q_sub(D, A)))})"
OFFSET = [f"(({q_dot(q_sub(D, A), q_sub(D, A))})*{x} + ({q_dot(q_sub(C, A), q_sub(C, A))})*{y} + ({q_dot(q_sub(B, A), q_sub(B, A))})*{z}) / (2*{SIX})" for x, y, z in zip(q_cross(q_sub(B, A), q_sub(C, A)), q_cross(q_sub(D, A), q_sub(B, A)), q_cross(q_sub(C, A), q_sub(D, A)), strict=True)]
AREAS = [f"0.5*{q_norm(q_cross(q_sub(y, x), q_sub(z, x)))}" for x, y, z in ((A, B, C), (A, B, D), (A, C, D), (B, C, D))]


@query(
    q_round(
        {"area": AREAS[0], "volume": f"-{SIX} / 6", "positive": f"CASE WHEN {SIX} < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END", "inner": f"3 * abs({SIX} / 6) / ({q_sum(AREAS)})", "plane": q_dot(q_sub(P, A), q_unit(q_cross(q_sub(B, A), q_sub(C, A)))), "bary_a": f"{q_dot(q_sub(B, P), q_cross(q_sub(C, P), q_sub(D, P)))} / {SIX}", "coplanar": f"CASE WHEN abs({q_dot(q_unit(q_sub(B, A)), q_unit(q_cross(q_sub(C, A), q_sub(D, A))))}) <= 0.4 THEN CAST(1 AS DOUBLE) ELSE 0 END"}, 4
    )
)
def tetrahedra(s, d):
    a, b, c, e, p = (at(3 * i) for i in range(5))
    n, off = G.plane_through(a, b, c)
    out = {"area": G.triangle_area(a, b, c), "volume": G.tetrahedron_volume(a, b, c, e), "positive": (G.tetrahedron_orientation(a, b, c, e) > 0).cast("double"), "inner": G.insphere_radius(a, b, c, e), "plane": G.plane_distance(n, off, p), "bary_a": G.tetrahedron_bary(a, b, c, e, p)[0], "coplanar": G.points_coplanar(a, b, c, e, 0.4).cast("double")}
    return terms(s, d).select("vec_id", *named(out, 4))


@query(q_round({"cx": f"e0 + {OFFSET[0]}", "radius": q_norm(OFFSET), "test": f"{q_dot(OFFSET, OFFSET)} - {q_dot(q_sub(q_sub(P, A), OFFSET), q_sub(q_sub(P, A), OFFSET))}", "apart": "CAST(0 AS DOUBLE)"}, 4, f"FROM t WHERE abs({SIX}) > 0.001"))
def circumspheres(s, d):
    a, b, c, e, p = (at(3 * i) for i in range(5))
    centre, radius = G.circumsphere_centre(a, b, c, e), G.circumsphere_radius(a, b, c, e)
    apart = F.abs(F.round(V.norm(V.sub(e, centre)) - radius, 4))
    big = F.abs(6 * G.tetrahedron_volume(a, b, c, e)) > 0.001
    return terms(s, d).where(big).select("vec_id", *named({"cx": centre[0], "radius": radius, "test": G.circumsphere_test(a, b, c, e, p), "apart": apart}, 4))


def q_least(xs) -> str:
    return f"least({', '.join(xs)})"


def q_greatest(xs) -> str:
    return f"greatest({', '.join(xs)})"


CORNERS = [[f"({x}0.1)" for x in ("-" if c >> i & 1 else "" for i in range(3))] for c in range(8)]
PLANE = [f"{q_dot(A, q_sub(k, B))}" for k in CORNERS]
EDGES = [q_sub(B, A), q_sub(C, B), q_sub(A, C)]
AXES = [q_cross([str(float(k == i)) for k in range(3)], e) for e in EDGES for i in range(3)] + [[str(float(k == i)) for k in range(3)] for i in range(3)] + [q_cross(EDGES[0], EDGES[1])]
SAT = " AND ".join(f"({q_least([q_dot(x, v) for v in (A, B, C)])} <= 0.1*{q_sum(f'abs({k})' for k in x)} AND {q_greatest([q_dot(x, v) for v in (A, B, C)])} >= -0.1*{q_sum(f'abs({k})' for k in x)})" for x in AXES)
ENTER = q_greatest([f"least((-0.2 - e{i}) / e{i + 3}, (0.2 - e{i}) / e{i + 3})" for i in range(3)])
LEAVE = q_least([f"greatest((-0.2 - e{i}) / e{i + 3}, (0.2 - e{i}) / e{i + 3})" for i in range(3)])


@query(TERMS + f" SELECT vec_id, e0 BETWEEN -0.1 AND 0.1 AND e1 BETWEEN -0.1 AND 0.1 AND e2 BETWEEN -0.1 AND 0.1 AS point_in, {' AND '.join(f'e{i} - 0.1 <= e{i + 3} + 0.05 AND e{i} + 0.1 >= e{i + 3} - 0.05' for i in range(3))} AS boxes, {q_least(PLANE)} <= 0 AND {q_greatest(PLANE)} >= 0 AS plane, {SAT} AS triangle, {ENTER} <= {LEAVE} AND {LEAVE} > 0 AS ray FROM t WHERE e3 <> 0 AND e4 <> 0 AND e5 <> 0")
def box_overlaps(s, d):
    half = [F.lit(0.1)] * 3
    a, b, c = at(0), at(3), at(6)
    box = lambda v, h: ([x - h for x in v], [x + h for x in v])
    out = {"point_in": G.point_box_overlap(a, [F.lit(-0.1)] * 3, half), "boxes": G.box_box_overlap(*box(a, 0.1), *box(b, 0.05)), "plane": G.plane_box_overlap(a, b, half), "triangle": G.triangle_box_overlap([F.lit(0.0)] * 3, half, a, b, c), "ray": G.ray_box_overlap(a, b, [F.lit(-0.2)] * 3, [F.lit(0.2)] * 3)}
    return terms(s, d).where("e3 <> 0 and e4 <> 0 and e5 <> 0").select("vec_id", *named(out, None))


RAY = [f"({q_dot(q_sub(C, A), q_cross(q_sub(D, A), [f'(-({x}))' for x in B]))})"]
NORMAL = q_cross(q_sub(C, A), q_sub(D, A))
HIT = f"({q_dot(q_sub(A, ['0.0'] * 3), NORMAL)} / {q_dot(B, NORMAL)})"
AT = [f"({HIT}*({x}))" for x in B]


def q_same_side(u, v) -> str:
    return f"{q_dot(q_cross(q_sub(v, u), q_sub(AT, u)), NORMAL)} >= 0"


GAP = q_cross(B, D)


@query(TERMS + f" SELECT vec_id, round(CASE WHEN {q_same_side(A, C)} AND {q_same_side(C, D)} AND {q_same_side(D, A)} THEN {HIT} ELSE 0 END, 4) + 0.0 AS t, round({q_dot(q_cross(q_sub(C, A), D), GAP)} / {q_dot(GAP, GAP)}, 4) + 0.0 AS near1, round({q_dot(q_cross(q_sub(C, A), B), GAP)} / {q_dot(GAP, GAP)}, 4) + 0.0 AS near2 FROM t WHERE {q_dot(GAP, GAP)} > 0.0001 AND abs({q_dot(B, NORMAL)}) > 0.001")
def ray_hits(s, d):
    a, b, c, e = (at(3 * i) for i in range(4))
    hit = G.ray_triangle_intersect([F.lit(0.0)] * 3, b, a, c, e)
    near = G.ray_ray_intersect(a, b, c, e)
    n = V.cross(V.sub(c, a), V.sub(e, a))
    safe = (V.square_norm(V.cross(b, e)) > 0.0001) & (F.abs(V.dot(b, n)) > 0.001)
    return terms(s, d).where(safe).select("vec_id", *named({"t": hit, "near1": near[0], "near2": near[1]}, 4))


T01 = "(0.5 + e12)"
BERNSTEIN = [f"{k}*pow(1 - {T01}, {3 - i})*pow({T01}, {i})" for i, k in enumerate((1, 3, 3, 1))]


@query(q_round({**{f"b{k}": q_sum(f"{w}*e{3 * i + k}" for i, w in enumerate(BERNSTEIN)) for k in range(3)}, "spline": q_sum(f"{w}*e{3 * i}" for i, w in enumerate(BERNSTEIN)), "linear": f"CASE WHEN {T01} < 0.5 THEN (1 - 2*{T01})*e0 + 2*{T01}*e3 ELSE (2 - 2*{T01})*e3 + (2*{T01} - 1)*e6 END"}, 6, f"FROM t WHERE {T01} BETWEEN 0 AND 1"))
def curves(s, d):
    points, t = [at(3 * i) for i in range(4)], 0.5 + F.col("e12")
    knots = G.uniform_knots(4, 3, 0.0, 1.0)
    line = G.bspline(points[:3], G.uniform_knots(3, 1, 0.0, 1.0), 1, t)
    return terms(s, d).where((t >= 0) & (t <= 1)).select("vec_id", *named({**{f"b{k}": x for k, x in enumerate(G.bezier(points, t))}, "spline": G.bspline(points, knots, 3, t)[0], "linear": line[0]}))


FL, ASP = "(1 + abs(e8))", "(1 + e9 / 2)"
AX = f"CASE WHEN 640.0 / 480 * {ASP} < 1 THEN {FL} * 480 / {ASP} ELSE {FL} * 640 END"
AY = f"CASE WHEN 640.0 / 480 * {ASP} < 1 THEN {FL} * 480 ELSE {FL} * 640 * {ASP} END"
TRANS = q(4)
SEEN = [f"({q_dot(ROT[3 * i : 3 * i + 3], q(10))} + {TRANS[i]})" for i in range(3)]


def camera_of_terms() -> dict:
    return G.camera(1 + F.abs("e8"), 0.5 + F.col("e13") / 10, 0.5, 1 + F.col("e9") / 2, V.axis_angle_matrix(V.normalize(at(0)), F.col("e3")), at(4))


@query(
    q_round(
        {**{f"pos{j}": "-" + q_dot(ROT[j::3], TRANS) for j in range(3)}, "dir2": ROT[8], "w7": TRANS[1], "c1": ROT[3], "k0": AX, "k2": "640 * (0.5 + e13 / 10)", "k4": AY, "ik0": f"1 / ({AX})", "ik5": f"-240.0 / ({AY})", "depth": SEEN[2], "px": f"{FL} * (1 + 0.1 * (pow({SEEN[0]} / {SEEN[2]}, 2) + pow({SEEN[1]} / {SEEN[2]}, 2)) + 0.01 * pow(pow({SEEN[0]} / {SEEN[2]}, 2) + pow({SEEN[1]} / {SEEN[2]}, 2), 2)) * {SEEN[0]} / {SEEN[2]}", "front": f"CASE WHEN {SEEN[2]} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END"},
        4, f"FROM t WHERE abs({SEEN[2]}) > 0.05",
    )
)
def cameras(s, d):
    cam = camera_of_terms()
    pos, k, ik = G.camera_position(cam), G.calibration(cam, 640, 480), G.inverse_calibration(cam, 640, 480)
    seen, depth = G.projected(cam, at(10), F.lit(0.1), F.lit(0.01))
    out = {**{f"pos{j}": pos[j] for j in range(3)}, "dir2": G.viewing_direction(cam)[2], "w7": G.world_to_camera(cam)[7], "c1": G.camera_to_world(cam)[1], "k0": k[0], "k2": k[2], "k4": k[4], "ik0": ik[0], "ik5": ik[5], "depth": depth, "px": seen[0], "front": G.consistent_pose(cam["rot"], cam["trans"], at(10)).cast("double")}
    return terms(s, d).where(F.abs(depth) > 0.05).select("vec_id", *named(out, 4))


RAYS = ["((e0 + 0.5 - 0.5*10) / 12)", "((e1 + 0.5 - 0.5*10) / 12)"]
LEN = f"sqrt(pow({RAYS[0]}, 2) + pow({RAYS[1]}, 2) + 1)"


@query(
    q_round(
        {"foot": f"(1.0 / 12) * (2 + e2) / {LEN}", "p0": f"{RAYS[0]} / {LEN} * (2 + e2)", "p2": f"(2 + e2) / {LEN}", "ray": f"(2 + e2) * {LEN}", "back": f"(2 + e2) / {LEN}", "jump": "CASE WHEN abs(e2 - e3) > 0.2 * (CASE WHEN e3 < e2 THEN 0.6 ELSE 0.4 END) THEN CAST(1 AS DOUBLE) ELSE 0 END",
         "thin": f"CASE WHEN degrees(least({', '.join(f'acos(-({q_dot(q_unit(x), q_unit(y))}))' for x, y in ((EDGES[0], EDGES[1]), (EDGES[1], EDGES[2]), (EDGES[2], EDGES[0])))})) < 40 THEN CAST(1 AS DOUBLE) ELSE 0 END"}
    )
)
def depth_pixels(s, d):
    inv = G.inverse_calibration(G.camera(1.2), 10, 10)
    x, y, depth = F.col("e0"), F.col("e1"), 2 + F.col("e2")
    p = G.pixel_position(x, y, depth, inv)
    out = {"foot": G.pixel_footprint(x, y, depth, inv), "p0": p[0], "p2": p[2], "ray": G.depth_to_ray_length(x, y, depth, inv), "back": G.depth_to_ray_length(x, y, depth, inv, False), "jump": G.depth_discontinuity(F.lit(0.4), F.col("e2"), F.lit(0.6), F.col("e3"), 0.2).cast("double"), "thin": G.thin_triangle(at(0), at(3), at(6), 40.0).cast("double")}
    return terms(s, d).select("vec_id", *named(out))


ANGLE = f"degrees(acos({q_dot(q_unit(q_sub(A, B)), q_unit(q_sub(A, C)))}))"


@query(q_round({"angle": ANGLE, "weight": f"exp(-pow({ANGLE} - 20, 2) / (2 * pow(CASE WHEN {ANGLE} <= 20 THEN 5 ELSE 15 END, 2)))", "seen": "CASE WHEN e2 + 0.3 > 0 AND e0 / (e2 + 0.3) + 0.5 >= 0 AND e0 / (e2 + 0.3) + 0.5 < 1 AND e1 / (e2 + 0.3) + 0.5 >= 0 AND e1 / (e2 + 0.3) + 0.5 < 1 THEN CAST(1 AS DOUBLE) ELSE 0 END"}))
def view_angles(s, d):
    angle = G.parallax(at(0), at(3), at(6))
    cam = G.camera(1.0, trans=[F.lit(0.0), F.lit(0.0), F.lit(0.3)])
    return terms(s, d).select("vec_id", *named({"angle": angle, "weight": G.parallax_weight(angle), "seen": G.in_frustum(cam, at(0), 100, 100).cast("double")}))


SQ = "sqrt(greatest(0, pow(e1 / e2, 2) / 4 - e0 / e2))"
CLIP = "least(1, greatest(0, {}))"


@query(
    q_round(
        {"linear": CLIP.format("-e0 / (e1 - e0)"), "square": f"CASE WHEN abs(-e1/e2/2 + {SQ} - 0.5) < abs(-e1/e2/2 - {SQ} - 0.5) THEN -e1/e2/2 + {SQ} ELSE -e1/e2/2 - {SQ} END", "residual": "CAST(0 AS DOUBLE)"}, 4, "FROM t WHERE abs(e2) > 0.01 AND abs(e3) > 0.01 AND abs(e1 - e0) > 0.01"
    )
)
def roots(s, d):
    a = at(0, 4)
    # A cubic's root is checked by what is left: e0 + e1 x + e2 x^2 + e3 x^3 over the size of its terms.
    x = G.root_cubic(*a)
    left = F.abs(a[0] + a[1] * x + a[2] * x * x + a[3] * x * x * x) / (F.abs(a[0]) + F.abs(a[1] * x) + F.abs(a[2] * x * x) + F.abs(a[3] * x * x * x))
    out = {"linear": G.interpolate_root(a[0], a[1], a[2], a[3]), "square": G.root_square(a[0], a[1], a[2]), "residual": F.round(left, 4)}
    return terms(s, d).where("abs(e2) > 0.01 and abs(e3) > 0.01 and abs(e1 - e0) > 0.01").select("vec_id", *named(out, 4))


def q_hermite(kind: str) -> str:
    rise = "(e1 - e0)"
    return {"scaling": ("e0", f"(2 * e2 * {rise} / (e2 + e3))", f"(3 * {rise} - (2 * e2 + e3) * 2 * {rise} / (e2 + e3))"), "lsderiv": ("e0", f"((e2 - e3) / 2 + {rise})", "((e3 - e2) / 2)")}[kind]


def q_square(a0: str, a1: str, a2: str) -> str:
    half, width = f"(-({a1}) / ({a2}) / 2)", f"sqrt(greatest(0, pow({a1} / {a2}, 2) / 4 - {a0} / {a2}))"
    return CLIP.format(f"CASE WHEN abs({half} + {width} - 0.5) < abs({half} - {width} - 0.5) THEN {half} + {width} ELSE {half} - {width} END")


@query(q_round({k: q_square(*q_hermite(k)) for k in ("scaling", "lsderiv")}, 4, "FROM t WHERE abs(e2 + e3) > 0.01 AND abs(e3 - e2) > 0.01 AND abs(e1 - e0) > 0.01"))
def crossings(s, d):
    return terms(s, d).where("abs(e2 + e3) > 0.01 and abs(e3 - e2) > 0.01 and abs(e1 - e0) > 0.01").select("vec_id", *named({k: G.interpolate_root(*at(0, 4), k) for k in ("scaling", "lsderiv")}, 4))


NRM = q_unit(q(3))
LOCAL_X = q_dot(NRM, q_sub(q(0), q(6)))
R2 = q_dot(q_sub(q(0), q(6)), q_sub(q(0), q(6)))
SC = "(0.1 + abs(e9))"


@query(q_round({"value": f"{LOCAL_X} * exp(-{R2} / (2 * {SC} * {SC})) / (2 * pi() * pow({SC}, 4))", "weight": f"CASE WHEN sqrt({R2}) / {SC} >= 3 THEN 0 ELSE 1 - 2.0/3 * {R2} / pow({SC}, 2) + 8.0/27 * pow({R2} / pow({SC}, 2), 1.5) - 1.0/27 * pow({R2} / pow({SC}, 2), 2) END", "gradient": f"(pow({SC}, 2) - pow(e0, 2)) * exp(-(e0*e0 + e1*e1 + e2*e2) / (2 * {SC} * {SC})) / (2 * pi() * pow({SC}, 6))"}, 4))
def surface_functions(s, d):
    scale = 0.1 + F.abs("e9")
    value, weight = G.surface_sample(at(0), at(6), V.normalize(at(3)), scale)
    return terms(s, d).select("vec_id", *named({"value": value, "weight": weight, "gradient": G.surface_basis_gradient(scale, at(0))[0]}, 4))


AXIS = "((((p >> ({i})) & 1) * 4 + ((p >> ({i} + 3)) & 1) * 8 + ((p >> ({i} + 6)) & 1) * 16) // 4 + ((c >> {i}) & 1))"
KEY = "((CAST({} AS BIGINT) << 17))"


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 512 AS BIGINT) AS p, CAST(l_suppkey % 8 AS BIGINT) AS c FROM lineitem), k AS (SELECT *, " + ", ".join(f"(CAST({AXIS.format(i=i)} AS BIGINT) * 131072) AS a{i}" for i in range(3)) + " FROM t) "
    "SELECT l_orderkey, l_linenumber, a0 + a1 * 2097152 + a2 * 4398046511104 AS key, round(1 - 2 + 4 * a1 / 1048576.0, 6) AS y FROM k"
)
def voxel_corners(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 512).alias("p"), (F.col("l_suppkey") % 8).alias("c"))
    t = t.withColumn("key", G.voxel_key(3, F.col("p"), F.col("c")))
    return t.select("l_orderkey", "l_linenumber", "key", F.round(G.voxel_position(F.col("key"), [F.lit(0.0), F.lit(1.0), F.lit(0.0)], F.lit(4.0))[1], 6).alias("y"))


FP = [q_sum([f"e{3 * i}*e9", f"e{3 * i + 1}*e10", f"e{3 * i + 2}"]) for i in range(3)]
FQ = [q_sum([f"e{i}*e11", f"e{3 + i}*e12", f"e{6 + i}"]) for i in range(3)]


@query(q_round({"sampson": f"pow(e11*{FP[0]} + e12*{FP[1]} + {FP[2]}, 2) / (pow({FP[0]}, 2) + pow({FP[1]}, 2) + pow({FQ[0]}, 2) + pow({FQ[1]}, 2))", "essential": "-(e2*e3) + e1*e6"}))
def epipolar(s, d):
    f = at(0, 9)
    move = G.fundamental_of_motion(f, at(0))
    return terms(s, d).select("vec_id", *named({"sampson": G.sampson_distance(f, at(9, 2), at(11, 2)), "essential": move[0]}))


H0 = [[f"(e{3 * i + j} + {2.0 if i == j else 0.0})" for j in range(3)] for i in range(3)]


def q_apply(m, x, y) -> list[str]:
    r = [f"(({m[i][0]})*({x}) + ({m[i][1]})*({y}) + ({m[i][2]}))" for i in range(3)]
    return [f"({r[0]} / {r[2]})", f"({r[1]} / {r[2]})"]


ADJ = [[q_sum([f"({H0[(j + 1) % 3][(i + 1) % 3]})*({H0[(j + 2) % 3][(i + 2) % 3]})", f"-({H0[(j + 1) % 3][(i + 2) % 3]})*({H0[(j + 2) % 3][(i + 1) % 3]})"]) for j in range(3)] for i in range(3)]
GO, BACK = q_apply(H0, "e9", "e10"), q_apply(ADJ, "e11", "e12")


@query(q_round({"error": f"0.5 * (pow({GO[0]} - e11, 2) + pow({GO[1]} - e12, 2) + pow({BACK[0]} - e9, 2) + pow({BACK[1]} - e10, 2))"}, 4))
def transfer_error(s, d):
    h = [x + (2.0 if i % 4 == 0 else 0.0) for i, x in enumerate(at(0, 9))]
    return terms(s, d).select("vec_id", *named({"error": G.symmetric_transfer_error(h, at(9, 2), at(11, 2))}, 4))


@query("SELECT p_partkey, round(CASE WHEN p_size > 25 AND p_retailprice % 7 >= 1 THEN p_size / (p_retailprice % 7) WHEN p_size % 5 > 0 THEN (p_size % 5) / 35.0 ELSE 1 END, 6) AS flen, CASE WHEN p_size > 25 AND p_retailprice % 7 >= 1 THEN 'database' WHEN p_size % 5 > 0 THEN '35mm' ELSE 'fallback' END AS method, CAST(round(ln(1 - 0.99) / ln(1 - pow(p_size / 60.0, 3))) AS INTEGER) AS rounds FROM part")
def focal_lengths(s, d):
    p = table(s, d, "part")
    size = F.col("p_size").cast("double")
    sensor = F.col("p_retailprice").cast("double") % 7
    flen, method = G.focal_length(F.when(F.col("p_size") > 25, size), F.when(sensor >= 1, sensor), (F.col("p_size") % 5).cast("double"))
    return p.select("p_partkey", F.round(flen, 6).alias("flen"), method.alias("method"), G.ransac_iterations(size / 60.0, 3, 0.99).alias("rounds"))


# --- decompositions and estimators, on problems whose answer is known ---


def nine(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double")).alias("m"))


@query(q_round({"squares": q_dot(M, M), "product": f"abs({DET3})", "first": q_norm([M[0], M[3], M[6]]), "diagonal": f"abs({DET3})", "inverse": f"({q_cross(q(3), q(6))[0]}) / {DET3}"}, 4, f"FROM t WHERE abs({DET3}) > 0.0001"))
def decompositions(s, d):
    m = E.matrix_pseudo_inverse(E.matrix_qr(E.matrix_svd(nine(s, d), "m", 3, 3), "m", 3, 3), "m", 3, 3)
    get = lambda c, i: F.get(c, F.lit(i))
    out = {"squares": V.array_square_norm(F.col("s")), "product": V.array_product(F.col("s")), "first": get("r", 0), "diagonal": get("r", 0) * get("r", 4) * get("r", 8), "inverse": get("pinv", 0)}
    det = V.determinant(V.parts(F.col("m"), 9), 3)
    return m.where(F.abs(det) > 0.0001).select("vec_id", *named(out, 4))


COS, SIN = round(math.cos(0.5), 15), round(math.sin(0.5), 15)


@query(f"SELECT label, count(*) AS n, CAST(round({COS}, 6) AS DOUBLE) AS r0, CAST(round({-SIN}, 6) AS DOUBLE) AS r1, CAST(round({SIN}, 6) AS DOUBLE) AS r3, CAST(2 AS DOUBLE) AS scale, CAST(1 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS y, CAST(3 AS DOUBLE) AS z FROM embeddings GROUP BY label")
def similarity_of_points(s, d):
    """Points of each label, turned by half a radian about z, doubled and moved."""
    p = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    moved = [2 * (COS * p[0] - SIN * p[1]) + 1, 2 * (SIN * p[0] + COS * p[1]) + 2, 2 * p[2] + 3]
    t = E.similarity_transforms(table(s, d, "embeddings").select("label", F.array(*p).alias("p"), F.array(*moved).alias("q")), "label")
    get = lambda c, i: F.get(c, F.lit(i))
    return t.select("label", "n", *named({"r0": get("rot", 0), "r1": get("rot", 1), "r3": get("rot", 3), "scale": F.col("scale"), "x": get("trans", 0), "y": get("trans", 1), "z": get("trans", 2)}))


@query("SELECT label, count(*) AS inliers, CAST(1.2 AS DOUBLE) AS h0, CAST(0.1 AS DOUBLE) AS h1, CAST(0.05 AS DOUBLE) AS h2, CAST(-0.1 AS DOUBLE) AS h3, CAST(0.9 AS DOUBLE) AS h4, CAST(0.2 AS DOUBLE) AS h6, CAST(1 AS DOUBLE) AS h8 FROM embeddings GROUP BY label")
def homographies(s, d):
    """Points of each label and their images under one homography."""
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in range(2))
    w = 0.2 * x - 0.1 * y + 1
    m = table(s, d, "embeddings").select("label", x.alias("x1"), y.alias("y1"), ((1.2 * x + 0.1 * y + 0.05) / w).alias("x2"), ((-0.1 * x + 0.9 * y - 0.02) / w).alias("y2"))
    get = lambda i: F.get("h", F.lit(i))
    return E.estimate_homography(m, "label", rounds=20).select("label", "inliers", *named({f"h{i}": get(i) for i in (0, 1, 2, 3, 4, 6, 8)}, 4))


VIEW = [COS, 0.0, SIN, 0.0, 1.0, 0.0, -SIN, 0.0, COS, 0.1, -0.2, 5.0]


def seen_by(p: list, r: list[float]) -> list:
    q3 = [sum(r[3 * i + j] * p[j] for j in range(3)) + r[9 + i] for i in range(3)]
    return [q3[0] / q3[2], q3[1] / q3[2]]


@query(f"SELECT label, count(*) AS inliers, {', '.join(f'CAST({round(VIEW[i], 4)} AS DOUBLE) AS r{i}' for i in range(12))} FROM embeddings GROUP BY label")
def view_poses(s, d):
    """World points of each label and where one camera sees them."""
    p = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    u, v = seen_by(p, VIEW)
    refs = table(s, d, "embeddings").select("label", *(x.alias(n) for x, n in zip([*p, u, v], ["x", "y", "z", "u", "v"], strict=True)))
    got = E.estimate_pose(refs, "label", rounds=30, threshold=1e-4)
    return got.select("label", "inliers", *(F.round(F.get("rot", F.lit(i)), 4).alias(f"r{i}") for i in range(9)), *(F.round(F.get("trans", F.lit(i)), 4).alias(f"r{9 + i}") for i in range(3))).select("label", "inliers", *((F.col(f"r{i}") + 0.0).alias(f"r{i}") for i in range(12)))


@query("SELECT label, count(*) AS inliers, true AS rank_two FROM embeddings GROUP BY label HAVING count(*) >= 8")
def fundamental_matrices(s, d):
    """World points of each label as two cameras see them; all matches fit, and the matrix is singular."""
    p = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    a, b = seen_by(p, [1.0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 4.0]), seen_by(p, VIEW)
    m = table(s, d, "embeddings").select("label", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    got = E.estimate_fundamental(m, "label", rounds=20)
    return got.select("label", "inliers", (F.abs(V.determinant(V.parts(F.col("f"), 9), 3)) < 1e-9).alias("rank_two"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE), 4) + 0.0 AS y, round(CAST(embedding[3] AS DOUBLE), 4) + 0.0 AS z, 1 AS outliers FROM embeddings")
def triangulated_tracks(s, d):
    """Each point as three cameras see it, one of them wrongly."""
    p = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    views = [[1.0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 4.0], VIEW, [1.0, 0, 0, 0, 1, 0, 0, 0, 1, 1.0, 0.5, 5.0]]
    seen = [seen_by(p, v) for v in views]
    seen[2] = [seen[2][0] + 0.4, seen[2][1] - 0.3]
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("view"), u.alias("u"), w.alias("v"), F.array(*map(F.lit, v[:9])).cast("array<double>").alias("rot"), F.array(*map(F.lit, v[9:])).cast("array<double>").alias("trans")) for k, (v, (u, w)) in enumerate(zip(views, seen, strict=True))))
    refs = table(s, d, "embeddings").select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.*")
    got = E.triangulate_tracks(refs, "vec_id", threshold=1e-3)
    return got.select("vec_id", *(F.round(F.get("point", F.lit(i)), 4).alias(c) for i, c in enumerate("xyz")), F.size("outliers").alias("outliers"))
