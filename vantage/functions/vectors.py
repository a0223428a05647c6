"""Vectors, matrices and quaternions as columns.

A vector is a list of Columns, a matrix of n rows and m columns a list of n * m Columns, row by row; a quaternion is
(w, x, y, z). `parts` takes them out of an array column and `pack` puts them back. All expressions are plain arithmetic, so
they stay in generated code and null in any component gives null. Functions on array columns of any length say so.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def parts(c: Column, n: int, at: int = 0) -> Vec:
    """n components of an array column as doubles, from index `at` on."""
    return [F.get(c, F.lit(at + i)).cast("double") for i in range(n)]


def pack(v: Vec) -> Column:
    return F.array(*v)


def total(terms) -> Column:
    return functools.reduce(operator.add, terms)


def let(values: Vec, body: Callable[[Vec], Column]) -> Column:
    """body of the values, each computed once: without it, an expression that stands in many places is written out in each."""
    return F.get(F.transform(F.array(F.array(*values)), lambda a: body([F.get(a, F.lit(i)) for i in range(len(values))])), F.lit(0))


# --- arrays of any length ---


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def array_abs_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def array_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x.cast("double"))


def array_square_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def array_norm(a: Column) -> Column:
    return F.sqrt(array_square_norm(a))


def array_min(a: Column) -> Column:
    return F.array_min(doubles(a))


def array_max(a: Column) -> Column:
    return F.array_max(doubles(a))


def array_normalize(a: Column) -> Column:
    """Divided by the norm; null components for the zero vector."""
    n = F.nullif(array_norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def array_abs(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x.cast("double")))


def array_negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x.cast("double"))


def array_apply(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, lambda x: f(x.cast("double")))


def array_cw_mult(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def array_cw_div(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)))


def array_is_similar(a: Column, b: Column, epsilon: float) -> Column:
    """Whether no component differs by more than epsilon."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= epsilon), lambda ok: ok)


def array_any_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x.cast("double")))


def array_sorted(a: Column, descending: bool = False) -> Column:
    return F.sort_array(a, not descending)


def array_permute(a: Column, target: Column) -> Column:
    """The element at i moves to target[i] (from 0)."""
    return F.transform(F.array_sort(F.arrays_zip(target.alias("t"), a.alias("x"))), lambda p: p["x"])


def array_permute_math(a: Column, source: Column) -> Column:
    """The element at source[i] (from 0) comes to i."""
    return F.transform(source, lambda i: F.get(a, i))


# --- vectors ---


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vec, s) -> Vec:
    return [x * num(s) for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return total(x * y for x, y in zip(a, b, strict=True))


def square_norm(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(square_norm(a))


def normalize(a: Vec) -> Vec:
    n = F.nullif(norm(a), F.lit(0.0))
    return [x / n for x in a]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def is_similar(a: Vec, b: Vec, epsilon: float) -> Column:
    return functools.reduce(operator.and_, (F.abs(x - y) <= epsilon for x, y in zip(a, b, strict=True)))


def sort_three(a: Column, b: Column, c: Column) -> Vec:
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return [low, a + b + c - low - high, high]


# --- matrices ---


def identity(n: int) -> Vec:
    return [F.lit(float(i == j)) for i in range(n) for j in range(n)]


def mat_row(m: Vec, i: int, columns: int) -> Vec:
    return m[i * columns : (i + 1) * columns]


def mat_col(m: Vec, j: int, columns: int) -> Vec:
    return m[j::columns]


def mat_mult(a: Vec, b: Vec, inner: int) -> Vec:
    """The product of matrices whose inner dimension is `inner`."""
    rows, columns = len(a) // inner, len(b) // inner
    return [dot(mat_row(a, i, inner), mat_col(b, j, columns)) for i in range(rows) for j in range(columns)]


def mat_vec(m: Vec, v: Vec) -> Vec:
    return mat_mult(m, v, len(v))


def transposed(m: Vec, columns: int) -> Vec:
    return [x for j in range(columns) for x in mat_col(m, j, columns)]


def transpose_multiply(m: Vec, columns: int) -> Vec:
    return mat_mult(transposed(m, columns), m, len(m) // columns)


def hstack(a: Vec, b: Vec, rows: int) -> Vec:
    n, k = len(a) // rows, len(b) // rows
    return [x for i in range(rows) for x in mat_row(a, i, n) + mat_row(b, i, k)]


def vstack(a: Vec, b: Vec) -> Vec:
    return [*a, *b]


def delete_row(m: Vec, i: int, columns: int) -> Vec:
    return m[: i * columns] + m[(i + 1) * columns :]


def delete_col(m: Vec, j: int, columns: int) -> Vec:
    return [x for k, x in enumerate(m) if k % columns != j]


def mat_minimum(m: Vec) -> Column:
    return F.least(*m)


def mat_maximum(m: Vec) -> Column:
    return F.greatest(*m)


def trace(m: Vec, n: int) -> Column:
    return total(m[:: n + 1])


def from_diagonal(v: Vec) -> Vec:
    n = len(v)
    return [v[i] if i == j else F.lit(0.0) for i in range(n) for j in range(n)]


def diagonal(m: Vec, n: int) -> Vec:
    return m[:: n + 1]


def minor(m: Vec, i: int, j: int, n: int) -> Vec:
    return delete_col(delete_row(m, i, n), j, n)


def determinant(m: Vec, n: int) -> Column:
    """By expansion along the first row."""
    if n == 1:
        return m[0]
    if n == 2:
        return m[0] * m[3] - m[1] * m[2]
    return total(m[j] * determinant(minor(m, 0, j, n), n - 1) * (-1.0) ** j for j in range(n))


def inverse(m: Vec, n: int, det: Column | None = None) -> Vec:
    """By the adjugate; null for singular matrices."""
    det = F.nullif(determinant(m, n) if det is None else det, F.lit(0.0))
    if n == 1:
        return [1 / det]
    return [determinant(minor(m, j, i, n), n - 1) * (-1.0) ** (i + j) / det for i in range(n) for j in range(n)]


def invert_rigid(m: Vec) -> Vec:
    """The inverse of a 4 x 4 rotation with translation."""
    r = transposed([m[4 * i + j] for i in range(3) for j in range(3)], 3)
    t = mat_vec(r, [m[3], m[7], m[11]])
    return [x for i in range(3) for x in [*mat_row(r, i, 3), -t[i]]] + [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def is_identity(m: Vec, n: int, epsilon: float = 0.0) -> Column:
    return is_similar(m, identity(n), epsilon)


def axis_angle_matrix(axis: Vec, angle: Column) -> Vec:
    """The rotation about a unit axis: cos I + sin [axis]x + (1 - cos) axis axis^T."""
    c, s = F.cos(angle), F.sin(angle)
    skew = cross_matrix(axis)
    return [(c if i == j else F.lit(0.0)) + skew[3 * i + j] * s + axis[i] * axis[j] * (1 - c) for i in range(3) for j in range(3)]


def cross_matrix(v: Vec) -> Vec:
    """The matrix that multiplies like the cross product with v."""
    zero = F.lit(0.0)
    return [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]


def frustum(near: Column, far: Column, top: Column, right: Column) -> Vec:
    """The 4 x 4 projection of a symmetric view frustum."""
    out = [F.lit(0.0)] * 16
    out[0], out[5] = near / right, near / top
    out[10], out[11], out[14] = (far + near) / (near - far), 2.0 * far * near / (near - far), F.lit(-1.0)
    return out


def look_at(position: Vec, direction: Vec, up: Vec) -> Vec:
    """The 4 x 4 view transformation of a camera that looks along a unit direction."""
    z = scale(direction, -1)
    x = normalize(cross(up, z))
    y = cross(z, x)
    rows = [[*axis, -dot(axis, position)] for axis in (x, y, z)]
    return [c for row in rows for c in row] + [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def transform_point(m: Vec, p: Vec, w: float = 1.0) -> Vec:
    """A 4 x 4 transformation of a point (w = 1) or direction (w = 0)."""
    return [dot(mat_row(m, i, 4)[:3], p) + m[4 * i + 3] * w for i in range(3)]


# --- quaternions ---


def quaternion(axis: Vec, angle: Column) -> Vec:
    return [F.cos(angle / 2), *scale(axis, F.sin(angle / 2))]


def quaternion_product(a: Vec, b: Vec) -> Vec:
    u, v = a[1:], b[1:]
    return [a[0] * b[0] - dot(u, v), *add(add(scale(v, a[0]), scale(u, b[0])), cross(u, v))]


def rotation_matrix(q: Vec) -> Vec:
    """Of a quaternion: (w^2 - |u|^2) I + 2 u u^T + 2 w [u]x."""
    w, u = q[0], q[1:]
    skew = cross_matrix(u)
    return [(w * w - square_norm(u) if i == j else F.lit(0.0)) + 2 * u[i] * u[j] + 2 * w * skew[3 * i + j] for i in range(3) for j in range(3)]


def rotate(q: Vec, v: Vec) -> Vec:
    return mat_vec(rotation_matrix(q), v)


def axis_angle(q: Vec) -> Vec:
    """(axis, angle) of a unit quaternion; the x axis and 0 for no rotation."""
    length = norm(q[1:])
    axis = [F.when(length == 0, F.lit(float(i == 0))).otherwise(x / F.nullif(length, F.lit(0.0))) for i, x in enumerate(q[1:])]
    return [*axis, F.when(length == 0, F.lit(0.0)).otherwise(2 * F.acos(q[0]))]


def quaternion_of(m: Vec) -> Vec:
    """Of a rotation matrix, by its largest component: w for a positive trace, else that of the largest diagonal entry."""
    t = trace(m, 3)

    def led_by(i: int) -> tuple[Vec, Column]:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(1 + m[4 * i] - m[4 * j] - m[4 * k])
        q: list = [None] * 4
        q[0] = (m[3 * k + j] - m[3 * j + k]) / s
        q[1 + i] = s / 4
        q[1 + j], q[1 + k] = (m[3 * i + j] + m[3 * j + i]) / s, (m[3 * i + k] + m[3 * k + i]) / s
        return q

    s = 2 * F.sqrt(t + 1)
    by_w = [s / 4, (m[7] - m[5]) / s, (m[2] - m[6]) / s, (m[3] - m[1]) / s]
    x, y, z = (led_by(i) for i in range(3))
    first, second = (m[0] > m[4]) & (m[0] > m[8]), m[4] > m[8]
    return [F.when(t > 0, by_w[i]).when(first, x[i]).when(second, y[i]).otherwise(z[i]) for i in range(4)]
