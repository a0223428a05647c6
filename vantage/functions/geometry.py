"""Geometry, cameras, depth and implicit-surface functions on columns, in the conventions of vectors.py.

A camera is a dictionary of its columns: flen, ppx, ppy, aspect, rot (9) and trans (3), by default those of an ideal camera
at the origin. Focal lengths and principal points are in units of the larger image side and of width and height.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, add, cross, cross_matrix, determinant, dot, inverse, let, mat_mult, mat_row, mat_vec, norm, normalize, num, scale, square_norm, sub, total, transposed

# --- tetrahedra, triangles, planes ---


def tetrahedron_sides(a: Vec, b: Vec, c: Vec, d: Vec) -> tuple[Vec, Vec, Vec]:
    return sub(b, a), sub(c, a), sub(d, a)


def circumcentre_offset(a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    """From a to the centre of the sphere through four points."""
    u, v, w = tetrahedron_sides(a, b, c, d)
    n = add(add(scale(cross(u, v), square_norm(w)), scale(cross(w, u), square_norm(v))), scale(cross(v, w), square_norm(u)))
    return scale(n, 1 / F.nullif(2 * dot(u, cross(v, w)), F.lit(0.0)))


def circumsphere_centre(a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    return add(a, circumcentre_offset(a, b, c, d))


def circumsphere_radius(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return norm(circumcentre_offset(a, b, c, d))


def circumsphere_test(a: Vec, b: Vec, c: Vec, d: Vec, p: Vec) -> Column:
    """Squared radius less the point's squared distance from the centre: positive inside."""
    o = circumcentre_offset(a, b, c, d)
    return square_norm(o) - square_norm(sub(p, add(a, o)))


def insphere_radius(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Three volumes over the surface."""
    u, v, w = tetrahedron_sides(a, b, c, d)
    faces = [cross(v, w), cross(w, u), cross(u, v)]
    return F.abs(dot(u, faces[0])) / (total(norm(f) for f in faces) + norm(add(add(*faces[:2]), faces[2])))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def tetrahedron_orientation(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return dot(sub(c, a), cross(sub(b, a), sub(d, c)))


def tetrahedron_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return tetrahedron_orientation(a, b, c, d) / 6


def tetrahedron_bary(a: Vec, b: Vec, c: Vec, d: Vec, p: Vec) -> Vec:
    """The weights of a, b and c in p; d has the rest."""
    sides = [sub(x, d) for x in (a, b, c)]
    return mat_vec(inverse([sides[j][i] for i in range(3) for j in range(3)], 3), sub(p, d))


def points_coplanar(a: Vec, b: Vec, c: Vec, d: Vec, cosine: float) -> Column:
    """Whether the cosine between one side and the normal of the other two is at most the given one."""
    u, v, w = tetrahedron_sides(a, b, c, d)
    return F.abs(dot(normalize(u), normalize(cross(v, w)))) <= cosine


def plane_through(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    n = normalize(cross(sub(b, a), sub(c, a)))
    return n, dot(a, n)


def plane_distance(n: Vec, d: Column, p: Vec) -> Column:
    return dot(p, n) - d


# --- overlaps ---


def every(conditions) -> Column:
    return functools.reduce(operator.and_, conditions)


def point_box_overlap(p: Vec, low: Vec, high: Vec) -> Column:
    return every((x >= a) & (x <= b) for x, a, b in zip(p, low, high, strict=True))


def box_box_overlap(low1: Vec, high1: Vec, low2: Vec, high2: Vec) -> Column:
    return every((a <= d) & (b >= c) for a, b, c, d in zip(low1, high1, low2, high2, strict=True))


def plane_box_overlap(n: Vec, p: Vec, half: Vec) -> Column:
    """A plane through p with normal n and the box of these half sizes about the origin; one that only touches the box's far
    corner overlaps, as the near corner must not be beyond it."""
    reach, at = total(F.abs(x) * h for x, h in zip(n, half, strict=True)), dot(n, p)
    return (-reach - at <= 0) & (reach - at >= 0)


def triangle_box_overlap(centre: Vec, half: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """No separating axis among the box's axes, the triangle's normal and the products of their edges."""
    v = [sub(x, centre) for x in (a, b, c)]
    edges = [sub(v[(i + 1) % 3], v[i]) for i in range(3)]
    meets = []
    for e in edges:
        for k in range(3):
            axis = cross([F.lit(float(k == i)) for i in range(3)], e)
            shadow = [dot(axis, x) for x in v]
            reach = total(F.abs(x) * h for x, h in zip(axis, half, strict=True))
            meets.append((F.least(*shadow) <= reach) & (F.greatest(*shadow) >= -reach))
    meets += [(F.least(*(x[i] for x in v)) <= half[i]) & (F.greatest(*(x[i] for x in v)) >= -half[i]) for i in range(3)]
    return every([*meets, plane_box_overlap(cross(edges[0], edges[1]), v[0], half)])


def ray_box_overlap(origin: Vec, direction: Vec, low: Vec, high: Vec) -> Column:
    """Slabs: the ray enters all before it leaves any, and leaves behind its origin."""
    enter, leave = [], []
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        d0 = F.nullif(d, F.lit(0.0))
        s, t = (a - o) / d0, (b - o) / d0
        inside = (o >= a) & (o <= b)
        far, near = F.lit(float("inf")), F.lit(float("-inf"))
        enter.append(F.when(d == 0, F.when(inside, near).otherwise(far)).otherwise(F.least(s, t)))
        leave.append(F.when(d == 0, F.when(inside, far).otherwise(near)).otherwise(F.greatest(s, t)))
    first, last = F.greatest(*enter), F.least(*leave)
    return (first <= last) & (last > 0)


def ray_triangle_intersect(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """How far along the ray the triangle is hit; 0 where it is not, the least positive double where it is hit at 0."""
    u_side, v_side = sub(b, a), sub(c, a)
    p = cross(direction, v_side)
    det = dot(u_side, p)
    safe = F.nullif(det, F.lit(0.0))
    o = sub(origin, a)
    u = dot(o, p) / safe
    q = cross(o, u_side)
    v, t = dot(direction, q) / safe, dot(v_side, q) / safe
    hit = (F.abs(det) > 1e-14) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1)
    return F.when(F.coalesce(hit, F.lit(False)), F.when(t == 0, F.lit(2.2250738585072014e-308)).otherwise(t)).otherwise(F.lit(0.0))


def ray_ray_intersect(p1: Vec, d1: Vec, p2: Vec, d2: Vec) -> Vec:
    """How far along each of two rays they are nearest; null for parallel rays."""
    n = cross(d1, d2)
    safe, gap = F.nullif(square_norm(n), F.lit(0.0)), sub(p2, p1)
    return [determinant([x[i] for i in range(3) for x in (gap, d, n)], 3) / safe for d in (d2, d1)]


# --- curves ---


def bezier(points: list[Vec], t: Column) -> Vec:
    """The curve of the control points at t, clamped to 0 and 1, by repeated interpolation."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    while len(points) > 1:
        points = [add(scale(a, 1 - t), scale(b, t)) for a, b in zip(points, points[1:], strict=False)]
    return points[0]


def uniform_knots(n_points: int, degree: int, low: float, high: float) -> list[float]:
    """Knots of a spline that starts and ends at its outer points; the last one lies 1 behind, so that `high` is inside."""
    segments = n_points - degree
    inner = [low + i * (high - low) / segments for i in range(segments + 1)]
    return [low] * degree + inner + [high] * (degree - 1) + [high + 1] * (degree > 0)


def spline_basis(knots: list[float], i: int, degree: int, t: Column) -> Column:
    """By the Cox-de Boor recursion; terms of coinciding knots are zero."""
    if degree == 0:
        return F.when((t >= knots[i]) & (t < knots[i + 1]), 1.0).otherwise(0.0)
    out = F.lit(0.0)
    if (d := knots[i + degree] - knots[i]) > 0:
        out = out + (t - knots[i]) / d * spline_basis(knots, i, degree - 1, t)
    if (d := knots[i + degree + 1] - knots[i + 1]) > 0:
        out = out + (knots[i + degree + 1] - t) / d * spline_basis(knots, i + 1, degree - 1, t)
    return out


def bspline(points: list[Vec], knots: list[float], degree: int, t: Column) -> Vec:
    weights = [spline_basis(knots, i, degree, t) for i in range(len(points))]
    return [total(w * p[k] for w, p in zip(weights, points, strict=True)) for k in range(len(points[0]))]


# --- cameras ---


def camera(flen=1.0, ppx=0.5, ppy=0.5, aspect=1.0, rot: Vec | None = None, trans: Vec | None = None) -> dict:
    eye = [F.lit(float(i % 4 == 0)) for i in range(9)]
    return {"flen": num(flen), "ppx": num(ppx), "ppy": num(ppy), "aspect": num(aspect), "rot": rot or eye, "trans": trans or [F.lit(0.0)] * 3}


def camera_position(cam: dict) -> Vec:
    return scale(mat_vec(transposed(cam["rot"], 3), cam["trans"]), -1)


def viewing_direction(cam: dict) -> Vec:
    return mat_row(cam["rot"], 2, 3)


def _affine(rot: Vec, trans: Vec) -> Vec:
    return [x for i in range(3) for x in [*mat_row(rot, i, 3), trans[i]]] + [F.lit(float(i == 3)) for i in range(4)]


def world_to_camera(cam: dict) -> Vec:
    return _affine(cam["rot"], cam["trans"])


def camera_to_world(cam: dict) -> Vec:
    return _affine(transposed(cam["rot"], 3), camera_position(cam))


def focal_pixels(cam: dict, width, height) -> tuple[Column, Column]:
    """Focal lengths in pixels: the larger side counts, by the pixel aspect ratio."""
    w, h, a = num(width), num(height), cam["aspect"]
    portrait = w / h * a < 1
    return F.when(portrait, cam["flen"] * h / a).otherwise(cam["flen"] * w), F.when(portrait, cam["flen"] * h).otherwise(cam["flen"] * w * a)


def calibration(cam: dict, width, height) -> Vec:
    ax, ay = focal_pixels(cam, width, height)
    zero = F.lit(0.0)
    return [ax, zero, num(width) * cam["ppx"], zero, ay, num(height) * cam["ppy"], zero, zero, F.lit(1.0)]


def inverse_calibration(cam: dict, width, height) -> Vec:
    ax, ay = focal_pixels(cam, width, height)
    zero = F.lit(0.0)
    return [1 / ax, zero, -num(width) * cam["ppx"] / ax, zero, 1 / ay, -num(height) * cam["ppy"] / ay, zero, zero, F.lit(1.0)]


def reprojection(src: dict, dst: dict, src_size: tuple, dst_size: tuple) -> tuple[Vec, Vec]:
    """(T, t): a source pixel (x, y, 1) times its depth goes to T p + t in the destination."""
    k = calibration(dst, *dst_size)
    turn = mat_mult(dst["rot"], transposed(src["rot"], 3), 3)
    return mat_mult(mat_mult(k, turn, 3), inverse_calibration(src, *src_size), 3), mat_vec(k, sub(dst["trans"], mat_vec(turn, src["trans"])))


def significant(x: Column, digits: int) -> Column:
    """The text of a double with at most so many significant digits and no zeros behind them, with an exponent below 1e-4
    and from 10**digits on."""
    scaled = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(scaled, "e([+-]\\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(scaled, "e.*$", ""), "\\.?0+$", "")
    fixed = F.lit(None).cast("string")
    for places in range(digits + 4):
        fixed = F.when(F.lit(digits - 1) - exponent == places, F.format_string(f"%.{places}f", x)).otherwise(fixed)
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, "\\.?0+$", "")).otherwise(fixed)
    power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= digits), power).otherwise(fixed)


def rotation_string(v: Vec) -> Column:
    """Components with ten significant digits, one space between."""
    return F.concat_ws(" ", *(significant(x, 10) for x in v))


def rotation_of_string(s: Column, n: int = 9) -> Vec:
    """The first n numbers of a string; null where there are fewer."""
    words = F.filter(F.split(s, "\\s+"), lambda x: x != "")
    return [F.get(words, F.lit(i)).try_cast("double") for i in range(n)]


def with_transformation(cam: dict, m: Vec) -> dict:
    """The camera with rotation and translation of a 4 x 4 matrix."""
    return cam | {"rot": [m[4 * i + j] for i in range(3) for j in range(3)], "trans": [m[3], m[7], m[11]]}


def projected(cam: dict, p: Vec, k1: Column | None = None, k2: Column | None = None) -> tuple[Vec, Column]:
    """The image point (in units of the focal length's) and depth of a world point, with radial distortion if given."""
    q = add(mat_vec(cam["rot"], p), cam["trans"])
    z = F.nullif(q[2], F.lit(0.0))
    x, y = q[0] / z, q[1] / z
    warp = F.lit(1.0)
    if k1 is not None:
        r2 = x * x + y * y
        warp = 1 + r2 * (k1 + r2 * k2)
    return [cam["flen"] * warp * x, cam["flen"] * warp * y], q[2]


# --- depth maps ---


def pixel_ray(x: Column, y: Column, inv: Vec) -> Vec:
    """Through the centre of a pixel, by the inverse calibration."""
    return mat_vec(inv, [x.cast("double") + 0.5, y.cast("double") + 0.5, F.lit(1.0)])


def pixel_footprint(x: Column, y: Column, depth: Column, inv: Vec) -> Column:
    """The width that a pixel covers at its depth."""
    return inv[0] * depth / norm(pixel_ray(x, y, inv))


def pixel_position(x: Column, y: Column, depth: Column, inv: Vec) -> Vec:
    return scale(normalize(pixel_ray(x, y, inv)), depth)


def depth_to_ray_length(x: Column, y: Column, depth: Column, inv: Vec, to_ray: bool = True) -> Column:
    """Depth along the optical axis to depth along the ray, or back."""
    length = norm(pixel_ray(x, y, inv))
    return depth * length if to_ray else depth / length


def depth_discontinuity(width1: Column, depth1: Column, width2: Column, depth2: Column, factor: float, diagonal: bool = False) -> Column:
    """Whether depths of neighbours differ by more than `factor` widths of the nearer pixel (the square root of two more on
    diagonals)."""
    factor = factor * (math.sqrt(2) if diagonal else 1)
    return F.abs(depth1 - depth2) > F.when(depth2 < depth1, width2).otherwise(width1) * factor


def thin_triangle(a: Vec, b: Vec, c: Vec, degrees: float = 15.0) -> Column:
    """Whether the smallest angle of a triangle is under so many degrees."""
    e = [normalize(sub(q, p)) for p, q in ((a, b), (b, c), (c, a))]
    return F.least(*(F.acos(-dot(e[i], e[(i + 1) % 3])) for i in range(3))) < math.radians(degrees)


# --- views ---


def parallax(p: Vec, camera1: Vec, camera2: Vec) -> Column:
    """The angle in degrees at a point between two camera positions."""
    c = dot(normalize(sub(p, camera1)), normalize(sub(p, camera2)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def parallax_weight(degrees: Column) -> Column:
    """A bell about 20 degrees, narrower below; 0 outside 0 to 180."""
    s = F.when(degrees <= 20, 5.0).otherwise(15.0)
    return F.when((degrees < 0) | (degrees > 180), 0.0).otherwise(F.exp(-(degrees - 20) * (degrees - 20) / (2 * s * s)))


def in_frustum(cam: dict, p: Vec, width, height) -> Column:
    """Whether a world point lies in front of a camera and projects into its image."""
    q = add(mat_vec(cam["rot"], p), cam["trans"])
    k = calibration(cam, width, height)
    z = F.nullif(q[2], F.lit(0.0))
    x, y = k[0] * q[0] / z + k[2], k[4] * q[1] / z + k[5]
    return F.coalesce((q[2] > 0) & (x >= 0) & (x < num(width)) & (y >= 0) & (y < num(height)), F.lit(False))


# --- implicit surfaces ---


def root_linear(a0: Column, a1: Column) -> Column:
    return -a0 / F.nullif(a1, F.lit(0.0))


def root_square(a0: Column, a1: Column, a2: Column, tiny: float = 1e-8) -> Column:
    """Of the roots of a0 + a1 x + a2 x^2 the one nearer to a half; the linear one where a2 vanishes."""

    def roots(v: Vec) -> Column:
        half, width, line, flat = v
        r, s = half + width, half - width
        return F.when(flat > 0, line).when(F.abs(r - 0.5) < F.abs(s - 0.5), r).otherwise(s)

    def scaled(v: Vec) -> Column:
        half = -v[1] / 2
        return let([half, F.sqrt(F.greatest(F.lit(0.0), half * half - v[0])), v[2], v[3]], roots)

    safe = F.when(F.abs(a2) >= tiny, a2)
    return let([a0 / safe, a1 / safe, root_linear(a0, a1), F.when(F.abs(a2) < tiny, 1.0).otherwise(0.0)], scaled)


def root_cubic(a0: Column, a1: Column, a2: Column, a3: Column, tiny: float = 1e-8) -> Column:
    """A root of the cubic: of three real ones the only one in 0 to 1, or else the middle one."""

    def three(v: Vec) -> Column:
        low, high, b2 = v
        middle = -(low + high + b2)
        inside = [(x >= 0) & (x <= 1) for x in (high, middle, low)]
        n = total(x.cast("int") for x in inside)
        return F.when(n != 1, middle).when(inside[0], high).when(inside[1], middle).otherwise(low)

    def depressed(v: Vec) -> Column:
        p, q, d, b2 = v
        m = F.sqrt(F.when(p < 0, -p / 3))
        theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 3 * q / (-2 * p * m)))) / 3
        by_angle = let([m, theta, b2], lambda t: let([-2 * t[0] * F.cos(t[1]) - t[2] / 3, 2 * t[0] * F.cos(F.lit(math.pi / 3) - t[1]) - t[2] / 3, t[2]], three))
        c = F.pow(F.sqrt(F.greatest(d, F.lit(0.0)) / 108) + F.abs(q) / 2, F.lit(1 / 3))
        by_power = let([c, p, q, b2], lambda t: F.when(t[2] >= 0, -1.0).otherwise(1.0) * (t[0] - t[1] / (3 * F.nullif(t[0], F.lit(0.0)))) - t[3] / 3)
        # The simple root beside a double one stays in the depressed variable.
        double = F.when(F.abs(p) < tiny, b2 / 3).otherwise(3 * q / F.nullif(p, F.lit(0.0)))
        return F.when(d < 0, by_angle).when(d > 0, by_power).otherwise(double)

    def reduced(v: Vec) -> Column:
        b0, b1, b2 = v
        p, q = b1 - b2 * b2 / 3, b0 - b1 * b2 / 3 + 2 * b2 * b2 * b2 / 27
        return let([p, q, b2], lambda t: let([t[0], t[1], 4 * t[0] * t[0] * t[0] + 27 * t[1] * t[1], t[2]], depressed))

    safe = F.when(F.abs(a3) >= tiny, a3)
    return F.when(F.abs(a3) < tiny, root_square(a0, a1, a2)).otherwise(let([a0 / safe, a1 / safe, a2 / safe], reduced))


def interpolate_root(v0: Column, v1: Column, d0: Column, d1: Column, kind: str = "linear") -> Column:
    """Where between 0 and 1 a function crosses zero, by its values and derivatives at both ends."""
    rise = v1 - v0
    if kind == "linear":
        root = root_linear(v0, rise)
    elif kind == "scaling":
        s = 2 * rise / F.nullif(d0 + d1, F.lit(0.0))
        root = root_square(v0, d0 * s, 3 * rise - (2 * d0 + d1) * s)
    elif kind == "lsderiv":
        root = root_square(v0, (d0 - d1) / 2 + rise, (d1 - d0) / 2)
    elif kind == "cubic":
        root = root_cubic(v0, d0, 3 * rise - 2 * d0 - d1, d0 + d1 - 2 * rise)
    else:
        raise ValueError(f"no interpolation {kind!r}")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), root))


def frame_of_normal(n: Vec) -> Vec:
    """A rotation that turns the unit normal to the x axis."""
    ref = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    u = normalize(cross(n, ref))
    usual = [*n, *u, *cross(n, u)]
    near = lambda s: every(F.abs(x - s * r) <= 0.001 for x, r in zip(n, ref, strict=True))
    same = [float(i % 4 == 0) for i in range(9)]
    turned = [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    return [F.when(near(1.0), F.lit(a)).when(near(-1.0), F.lit(b)).otherwise(x) for a, b, x in zip(same, turned, usual, strict=True)]


def surface_basis(s: Column, p: Vec) -> Column:
    """x times a Gaussian of width s, over 2 pi s^4."""
    return p[0] * F.exp(-square_norm(p) / (2 * s * s)) / (2 * math.pi * s * s * s * s)


def surface_basis_gradient(s: Column, p: Vec) -> Vec:
    g = F.exp(-square_norm(p) / (2 * s * s)) / (2 * math.pi * s * s * s * s * s * s)
    return [(s * s - p[0] * p[0]) * g, -p[0] * p[1] * g, -p[0] * p[2] * g]


def surface_weight(s: Column, p: Vec) -> Column:
    """1 - 2/3 r^2 + 8/27 r^3 - 1/27 r^4 with r the distance in units of s; 0 from 3 on."""
    return let([norm(p) / s], lambda v: F.when(v[0] >= 3, 0.0).otherwise(1 - 2 / 3 * v[0] * v[0] + 8 / 27 * v[0] * v[0] * v[0] - 1 / 27 * v[0] * v[0] * v[0] * v[0]))


def surface_sample(p: Vec, sample: Vec, normal: Vec, s: Column) -> tuple[Column, Column]:
    """(value, weight) of a sample's basis functions at a point."""

    def local(v: Vec, f) -> Column:
        return let([*v[:6], v[6]], lambda t: let([*mat_vec(frame_of_normal(t[:3]), t[3:6]), t[6]], lambda x: f(x[3], x[:3])))

    given = [*normal, *sub(p, sample), s]
    return local(given, surface_basis), local(given, surface_weight)


def voxel_key(level: int, path: Column, corner: Column) -> Column:
    """Key of a node's corner: 21 bits for each axis at the finest level, so that nodes of all levels share their corners."""
    axes = []
    for i in range(3):
        at = F.lit(0).cast("long")
        for step in range(level - 1, -1, -1):
            bit = F.shiftright(path.cast("long"), 3 * step + i).bitwiseAND(F.lit(1).cast("long"))
            at = at * 2 + bit
        at = at + F.shiftright(corner.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
        axes.append(F.shiftleft(F.shiftleft(at, 20 - level), 21 * i))
    return axes[0].bitwiseOR(axes[1]).bitwiseOR(axes[2])


def voxel_position(key: Column, centre: Vec, size: Column) -> Vec:
    offset = [F.shiftright(key, 21 * i).bitwiseAND(F.lit(0x1FFFFF).cast("long")).cast("double") / float(1 << 20) for i in range(3)]
    return [c - size / 2 + o * size for c, o in zip(centre, offset, strict=True)]


def interpolate_voxel(a: dict, wa: Column, b: dict, wb: Column) -> dict:
    """value and scale (and further fields) mixed by weight, conf the smaller one."""
    return {k: F.least(a[k], b[k]) if k == "conf" else wa * a[k] + wb * b[k] for k in a}


# --- two views ---


def sampson_distance(f: Vec, p: Vec, q: Vec) -> Column:
    """The first-order distance of a match (p in the first image, q in the second) from a fundamental matrix."""
    one = F.lit(1.0)
    fp, fq = mat_vec(f, [*p, one]), mat_vec(transposed(f, 3), [*q, one])
    return dot([*q, one], fp) * dot([*q, one], fp) / F.nullif(fp[0] * fp[0] + fp[1] * fp[1] + fq[0] * fq[0] + fq[1] * fq[1], F.lit(0.0))


def symmetric_transfer_error(h: Vec, p: Vec, q: Vec) -> Column:
    """Half of the squared distances of a match after the homography and its inverse."""

    def apply(m: Vec, x: Vec) -> Vec:
        y = mat_vec(m, [*x, F.lit(1.0)])
        z = F.nullif(y[2], F.lit(0.0))
        return [y[0] / z, y[1] / z]

    return 0.5 * (square_norm(sub(p, apply(inverse(h, 3), q))) + square_norm(sub(q, apply(h, p))))


def fundamental_of_motion(rot: Vec, trans: Vec) -> Vec:
    """Of a calibrated second camera beside one at the origin: [t]x R."""
    return mat_mult(cross_matrix(trans), rot, 3)


def consistent_pose(rot: Vec, trans: Vec, p: Vec) -> Column:
    """Whether a world point lies in front of a camera."""
    return dot(mat_row(rot, 2, 3), p) + trans[2] > 0


def focal_length(exif_mm: Column, sensor_mm: Column, film_mm: Column) -> tuple[Column, Column]:
    """(focal length in units of the sensor's width, how it is known): from the database's sensor, the 35 mm equivalent, or 1."""
    by_sensor, by_film = F.coalesce((exif_mm > 0) & (sensor_mm > 0), F.lit(False)), F.coalesce(film_mm > 0, F.lit(False))
    return F.when(by_sensor, exif_mm / sensor_mm).when(by_film, film_mm / 35.0).otherwise(1.0), F.when(by_sensor, "database").when(by_film, "35mm").otherwise("fallback")


def ransac_iterations(inliers: Column, samples: int, success: float) -> Column:
    good = F.lit(1.0)
    for _ in range(samples):
        good = good * inliers
    return F.round(F.lit(math.log(1 - success)) / F.log(1 - good)).cast("int")


def pair_score(matches: Column, inliers: Column, angle: Column) -> Column:
    """Of a pair of views for the start: matches (20 least, 200 good), angle in degrees (1 and 8), and the share of the
    matches that a homography explains (0.7 most, 0.4 good), each a clamped logistic term."""
    term = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 / (1.0 + F.exp(x)) - 1.0))
    share = inliers / matches
    return term((20.0 - matches) * 6.0 / 200.0) * term((1.0 - angle) * 6.0 / 8.0) * term((share - 0.7) * 6.0 / 0.4)
