"""Linear algebra and geometric estimators: small dense problems, one for each row or group.

The numpy functions take stacks of matrices or arrays of points; `solve_rows` runs one over Arrow batches of a table, all
rows of a batch with the same shape at once, and `solve_groups` one for each group. Random samples are drawn from a
generator seeded by the caller and the group's key, so that reruns and lost executors give the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- decompositions of stacks of matrices (..., n, m) ---


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s (largest first) and v with a = u diag(s) v^T, as thin as a. The largest entry of each column of u is positive."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    v = np.swapaxes(vt, -1, -2)
    at = np.abs(u).argmax(-2)[..., None, :]
    sign = np.where(np.take_along_axis(u, at, -2) < 0, -1.0, 1.0)
    return u * sign, s, v * sign


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q and r with the diagonal of r not negative."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diagonal(r, axis1=-2, axis2=-1) < 0, -1.0, 1.0)
    return q * sign[..., None, :], r * sign[..., :, None]


def pseudo_inverse(a: np.ndarray, tiny: float = 1e-12) -> np.ndarray:
    u, s, v = svd(a)
    safe = np.where(s > tiny, s, np.inf)
    return v / safe[..., None, :] @ np.swapaxes(u, -1, -2)


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, b, v with a = u b v^T and b upper bidiagonal, by Householder reflections of one matrix with n >= m."""
    b, n, m = a.astype(float).copy(), *a.shape
    u, v = np.eye(n), np.eye(m)

    def mirror(x: np.ndarray) -> np.ndarray:
        h = x.copy()
        h[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(h)
        return h / size if size else h

    for k in range(m):
        h = mirror(b[k:, k])
        b[k:] -= 2 * np.outer(h, h @ b[k:])
        u[:, k:] -= 2 * np.outer(u[:, k:] @ h, h)
        if k < m - 2:
            h = mirror(b[k, k + 1 :])
            b[:, k + 1 :] -= 2 * np.outer(b[:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return u, b, v


def cholesky(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(a)


def cholesky_inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of symmetric positive definite matrices."""
    low = np.linalg.inv(cholesky(a))
    return np.swapaxes(low, -1, -2) @ low


def conjugate_gradient(a: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: Callable[[np.ndarray], np.ndarray] | None = None, max_rounds: int = 100, tolerance: float = 1e-20) -> tuple[np.ndarray, int]:
    """x with a(x) = b for a symmetric positive definite operator, and the rounds taken."""
    m = precondition or (lambda r: r)
    x, r = np.zeros_like(b), b.copy()
    z = m(r)
    p, old = z.copy(), r @ z
    for k in range(max_rounds):
        if r @ r <= tolerance:
            return x, k
        q = a(p)
        step = old / (p @ q)
        x, r = x + step * p, r - step * q
        z = m(r)
        new = r @ z
        p, old = z + new / old * p, new
    return x, max_rounds


# --- similarity of point sets ---


def determine_transform(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(rotation, scale, translation) with q = scale rotation p + translation in least squares; None from under three points
    or points on a line."""
    if len(p) < 3:
        return None
    cp, cq = p.mean(0), q.mean(0)
    u, s, v = svd((q - cq).T @ (p - cp) / len(p))
    if s[1] < 1e-12:
        return None
    d = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    rot = u * d @ v.T
    scale = float((s * d).sum() / ((p - cp) ** 2).sum(1).mean())
    return rot, scale, cq - scale * rot @ cp


# --- two views; matches p and q are (n, 2) ---


def homogeneous(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1)


def null_vector(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(a)[2][..., -1, :]


def fundamental_least_squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """F with q^T F p = 0 for eight matches and more."""
    if len(p) < 8:
        raise ValueError("eight matches are needed")
    a = (homogeneous(q)[:, :, None] * homogeneous(p)[:, None, :]).reshape(len(p), 9)
    return null_vector(a).reshape(3, 3)


def fundamental_8_point(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return fundamental_least_squares(p[:8], q[:8])


def enforce_rank_two(f: np.ndarray) -> np.ndarray:
    u, s, v = svd(f)
    s[2] = 0
    return u * s @ v.T


def enforce_essential(e: np.ndarray) -> np.ndarray:
    """Two equal singular values, their mean, and a zero one."""
    u, s, v = svd(e)
    mean = (s[0] + s[1]) / 2
    return u * np.array([mean, mean, 0]) @ v.T


def poses_from_essential(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (rotation, translation of length 1) of the second camera beside one at the origin."""
    u, _, v = svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, t) for r in (u @ w @ v.T, u @ w.T @ v.T) for t in (u[:, 2], -u[:, 2])]


def cross_product_matrix(t: np.ndarray) -> np.ndarray:
    return np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]], float)


def fundamental_from_poses(k1, r1, t1, k2, r2, t2) -> np.ndarray:
    """[e]x P2 P1^+ with the second view's epipole e."""
    p1, p2 = (k @ np.column_stack([r, t]) for k, r, t in ((k1, r1, t1), (k2, r2, t2)))
    centre = np.append(-r1.T @ t1, 1.0)
    return cross_product_matrix(p2 @ centre) @ p2 @ pseudo_inverse(p1)


def sampson_distances(f: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    fp, fq = homogeneous(p) @ f.T, homogeneous(q) @ f
    return (homogeneous(q) * fp).sum(1) ** 2 / ((fp[:, :2] ** 2).sum(1) + (fq[:, :2] ** 2).sum(1))


def homography_dlt(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """H with q ~ H p for four matches and more."""
    if len(p) < 4:
        raise ValueError("four matches are needed")
    x, zero = homogeneous(p), np.zeros((len(p), 3))
    a = np.concatenate([np.hstack([zero, x, -q[:, 1:] * x]), np.hstack([-x, zero, q[:, :1] * x])])
    return null_vector(a).reshape(3, 3)


def transfer_errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    def gap(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        y = homogeneous(a) @ m.T
        return ((y[:, :2] / y[:, 2:] - b) ** 2).sum(1)

    return 0.5 * (gap(h, p, q) + gap(np.linalg.inv(h), q, p))


def ransac(n: int, size: int, rounds: int, rng: np.random.Generator, model: Callable, errors: Callable, threshold: float):
    """(model, inliers) of the sample that explains the most of n observations; the first such."""
    best, inliers = None, np.empty(0, int)
    if n < size:
        return best, inliers
    for _ in range(rounds):
        for m in model(rng.choice(n, size, replace=False)):
            found = np.flatnonzero(errors(m) < threshold)
            if len(found) > len(inliers):
                best, inliers = m, found
    return best, inliers


def ransac_fundamental(p, q, rng, rounds: int = 1000, threshold: float = 0.0015):
    return ransac(len(p), 8, rounds, rng, lambda i: [enforce_rank_two(fundamental_8_point(p[i], q[i]))], lambda f: sampson_distances(f, p, q), threshold**2)


def ransac_homography(p, q, rng, rounds: int = 1000, threshold: float = 0.005):
    def model(i: np.ndarray) -> list[np.ndarray]:
        h = homography_dlt(p[i], q[i])
        return [h / h[2, 2]] if abs(h[2, 2]) > 1e-12 and abs(np.linalg.det(h)) > 1e-12 else []

    return ransac(len(p), 4, rounds, rng, model, lambda h: transfer_errors(h, p, q), threshold**2)


# --- pose of one view ---


def rigid(world: np.ndarray, view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) that moves points of the world to those of the view in least squares."""
    cw, cv = world.mean(0), view.mean(0)
    u, _, vt = np.linalg.svd((view - cv).T @ (world - cw))
    rot = u * np.array([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return rot, cv - rot @ cw


def pose_p3p(points: np.ndarray, rays: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to four (rotation, translation) of a camera that sees three world points along three unit rays; none for points on
    a line. The distances follow from a quartic in the ratio of two of them."""
    if np.linalg.norm(np.cross(points[1] - points[0], points[2] - points[0])) < 1e-10:
        return []
    a2, b2, c2 = (((points[i] - points[j]) ** 2).sum() for i, j in ((1, 2), (0, 2), (0, 1)))
    ca, cb, cc = rays[1] @ rays[2], rays[0] @ rays[2], rays[0] @ rays[1]
    d, s = (a2 - c2) / b2, (a2 + c2) / b2
    quartic = [
        (d - 1) ** 2 - 4 * c2 / b2 * ca**2,
        4 * (d * (1 - d) * cb - (1 - s) * ca * cc + 2 * c2 / b2 * ca**2 * cb),
        2 * (d**2 - 1 + 2 * d**2 * cb**2 + 2 * (b2 - c2) / b2 * ca**2 - 4 * s * ca * cb * cc + 2 * (b2 - a2) / b2 * cc**2),
        4 * (-d * (1 + d) * cb + 2 * a2 / b2 * cc**2 * cb - (1 - s) * ca * cc),
        (1 + d) ** 2 - 4 * a2 / b2 * cc**2,
    ]
    out = []
    for root in np.roots(quartic):
        v, low = root.real, 2 * (cc - root.real * ca)
        size = 1 + v * v - 2 * v * cb
        if abs(root.imag) > 1e-6 * max(1, abs(v)) or v <= 0 or abs(low) < 1e-12 or size <= 0:
            continue
        u = ((d - 1) * v * v - 2 * d * cb * v + 1 + d) / low
        if u > 0:
            out.append(rigid(points, rays * (np.sqrt(b2 / size) * np.array([1, u, v]))[:, None]))
    return out


def reprojection_errors(pose: tuple[np.ndarray, np.ndarray], points: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Squared distances in the calibrated image; infinite behind the camera."""
    x = points @ pose[0].T + pose[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        e = ((x[:, :2] / x[:, 2:] - seen) ** 2).sum(1)
    return np.where(x[:, 2] > 0, e, np.inf)


def ransac_pose(points, seen, rng, rounds: int = 1000, threshold: float = 0.005):
    """From world points and calibrated image points."""
    rays = homogeneous(seen)
    rays = rays / np.linalg.norm(rays, axis=1, keepdims=True)
    return ransac(len(points), 3, rounds, rng, lambda i: pose_p3p(points[i], rays[i]), lambda m: reprojection_errors(m, points, seen), threshold**2)


# --- triangulation ---


def triangulate(poses: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The point of n >= 2 views: poses (n, 3, 4), image points (n, 2)."""
    a = (seen[:, :, None] * poses[:, 2:, :] - poses[:, :2, :]).reshape(-1, 4)
    x = null_vector(a)
    return x[:3] / x[3]


def triangulate_robust(poses: np.ndarray, seen: np.ndarray, threshold: float = 0.01, angle: float = np.radians(1.0), min_views: int = 2):
    """(point, outliers) of the pair of views whose point the fewest views miss by the threshold or more, if its rays meet at
    the angle at least and min_views see it; None where no pair does. poses are calibrated."""
    best = None
    centres = np.array([-p[:, :3].T @ p[:, 3] for p in poses])
    for i in range(len(poses)):
        for j in range(i):
            x = triangulate(poses[[j, i]], seen[[j, i]])
            if not np.isfinite(x).all():
                continue
            a, b = x - centres[i], x - centres[j]
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) > np.cos(angle):
                continue
            e = np.array([reprojection_errors((p[:, :3], p[:, 3]), x[None], s[None])[0] for p, s in zip(poses, seen, strict=True)])
            out = np.flatnonzero(~(e < threshold**2))
            if len(poses) - len(out) >= min_views and (best is None or len(out) < len(best[1])):
                best = x, out
    return best


# --- bundle adjustment ---


def rodrigues(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    if angle == 0:
        return np.eye(3)
    k = cross_product_matrix(w / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def undistorted_radius2(r2: float, k1: float, k2: float) -> float:
    """The squared radius whose distorted one is r2, by bisection."""
    low, high = 0.0, max(2 * r2, 1e-12)
    f = lambda x: x * (1 + k1 * x + k2 * x * x) ** 2 - r2
    while f(high) < 0 and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def undistort_feature(f: np.ndarray, k1: float, k2: float, focal: float) -> np.ndarray:
    r2 = float(f @ f) / focal**2
    return f * np.sqrt(undistorted_radius2(r2, k1, k2) / r2) if r2 > 0 else f


#: A camera's parameters: focal length, two of radial distortion, translation, and the rotation as a vector.
CAMERA = 9


def residuals(cams: np.ndarray, rots: np.ndarray, points: np.ndarray, ci: np.ndarray, pi: np.ndarray, seen: np.ndarray) -> np.ndarray:
    x = np.einsum("nij,nj->ni", rots[ci], points[pi]) + cams[ci, 3:6]
    u = x[:, :2] / x[:, 2:]
    r2 = (u**2).sum(1, keepdims=True)
    f, k1, k2 = (cams[ci, k : k + 1] for k in range(3))
    return f * (1 + k1 * r2 + k2 * r2 * r2) * u - seen


def jacobian(cams: np.ndarray, rots: np.ndarray, points: np.ndarray, ci: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2, 9) by the camera, with the rotation turned further by a small vector, and (n, 2, 3) by the point."""
    rx = np.einsum("nij,nj->ni", rots[ci], points[pi])
    x = rx + cams[ci, 3:6]
    z = x[:, 2:]
    u = x[:, :2] / z
    r2 = (u**2).sum(1, keepdims=True)
    f, k1, k2 = (cams[ci, k : k + 1] for k in range(3))
    warp = 1 + k1 * r2 + k2 * r2 * r2
    slope = (2 * k1 + 4 * k2 * r2)[:, :, None] * u[:, :, None] * u[:, None, :]
    by_u = f[:, :, None] * (warp[:, :, None] * np.eye(2) + slope)
    by_x = by_u @ np.concatenate([np.broadcast_to(np.eye(2), (len(u), 2, 2)) / z[:, :, None], -(u / z)[:, :, None]], axis=2)
    turn = -np.stack([np.stack([0 * rx[:, 0], -rx[:, 2], rx[:, 1]], 1), np.stack([rx[:, 2], 0 * rx[:, 0], -rx[:, 0]], 1), np.stack([-rx[:, 1], rx[:, 0], 0 * rx[:, 0]], 1)], axis=1)
    by_cam = np.concatenate([(warp * u)[:, :, None], (f * r2 * u)[:, :, None], (f * r2 * r2 * u)[:, :, None], by_x, by_x @ turn], axis=2)
    return by_cam, by_x @ rots[ci]


def solve_schur(jc: np.ndarray, jp: np.ndarray, r: np.ndarray, ci: np.ndarray, pi: np.ndarray, n_cams: int, n_points: int, damping: float, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of cameras and points from the normal equations: points are eliminated block by block and the cameras' system
    is solved by conjugate gradients with its diagonal blocks as preconditioner. `fixed`: camera parameters that stay."""
    jc = np.where(fixed, 0.0, jc)
    b, c = np.zeros((n_cams, CAMERA, CAMERA)), np.zeros((n_points, 3, 3))
    np.add.at(b, ci, np.swapaxes(jc, 1, 2) @ jc)
    np.add.at(c, pi, np.swapaxes(jp, 1, 2) @ jp)
    for m in (b, c):
        d = np.arange(m.shape[1])
        m[:, d, d] = m[:, d, d] * (1 + damping) + 1e-12
    e = np.swapaxes(jc, 1, 2) @ jp  # a block for each observation
    gc, gp = np.zeros((n_cams, CAMERA)), np.zeros((n_points, 3))
    np.add.at(gc, ci, -np.einsum("nij,ni->nj", jc, r))
    np.add.at(gp, pi, -np.einsum("nij,ni->nj", jp, r))
    ic = np.linalg.inv(c)

    def to_points(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n_points, 3))
        np.add.at(out, pi, np.einsum("nij,ni->nj", e, x[ci]))
        return out

    def to_cams(y: np.ndarray) -> np.ndarray:
        out = np.zeros((n_cams, CAMERA))
        np.add.at(out, ci, np.einsum("nij,nj->ni", e, y[pi]))
        return out

    by_point = lambda y: np.einsum("nij,nj->ni", ic, y)
    s = lambda x: (np.einsum("nij,nj->ni", b, (v := x.reshape(gc.shape))) - to_cams(by_point(to_points(v)))).ravel()
    ib = np.linalg.inv(b)
    dc, _ = conjugate_gradient(s, (gc - to_cams(by_point(gp))).ravel(), lambda x: np.einsum("nij,nj->ni", ib, x.reshape(gc.shape)).ravel(), 200)
    dc = dc.reshape(gc.shape)
    return dc, by_point(gp - to_points(dc))


def bundle_adjust(cams: np.ndarray, rots: np.ndarray, points: np.ndarray, ci: np.ndarray, pi: np.ndarray, seen: np.ndarray, mode: str = "full", rounds: int = 50, least_gain: float = 1e-4, fixed_intrinsics: bool = False):
    """(cams, rots, points, mean squared error before and after) by Levenberg-Marquardt steps.

    mode: full, cameras (points stay) or points (cameras stay). It ends after `rounds` steps or when the error falls by less
    than least_gain of itself.
    """
    fixed = np.zeros(CAMERA, bool)
    fixed[:3] = fixed_intrinsics
    if mode == "points":
        fixed[:] = True
    mse = first = (residuals(cams, rots, points, ci, pi, seen) ** 2).sum(1).mean()
    damping = 1e-3
    for _ in range(rounds):
        r = residuals(cams, rots, points, ci, pi, seen)
        jc, jp = jacobian(cams, rots, points, ci, pi)
        dc, dp = solve_schur(jc, np.zeros_like(jp) if mode == "cameras" else jp, r, ci, pi, len(cams), len(points), damping, fixed)
        new = cams + np.concatenate([dc[:, :6], 0 * dc[:, 6:]], axis=1), np.array([rodrigues(w) @ m for w, m in zip(dc[:, 6:], rots, strict=True)]), points + dp
        now = (residuals(*new, ci, pi, seen) ** 2).sum(1).mean()
        if now < mse:
            (cams, rots, points), gain, mse, damping = new, (mse - now) / mse, now, damping / 10
            if gain < least_gain:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return cams, rots, points, float(first), float(mse)


# --- over tables ---


def solve_rows(df: DataFrame, column: str, shape: tuple[int, int], kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """df and what the kernel gives for the matrices (rows of `shape`) of an array column; null where the array is null,
    has a null or another length. schema: the added array columns."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            ok = [i for i, v in enumerate(values) if v is not None and len(v) == shape[0] * shape[1] and None not in v]
            made: dict = {n: [None] * len(values) for n in names}
            if ok:
                got = kernel(np.array([values[i] for i in ok], float).reshape(-1, *shape))
                for n in names:
                    for i, x in zip(ok, got[n], strict=True):
                        made[n][i] = np.ravel(x).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[n], pa.list_(pa.float64())) for n in names)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, f"{fields}, {schema}")


def matrix_svd(df: DataFrame, column: str, rows: int, columns: int) -> DataFrame:
    """Adds u, s, v."""
    return solve_rows(df, column, (rows, columns), lambda a: dict(zip("usv", svd(a), strict=True)), "u array<double>, s array<double>, v array<double>")


def matrix_qr(df: DataFrame, column: str, rows: int, columns: int) -> DataFrame:
    """Adds q, r."""
    return solve_rows(df, column, (rows, columns), lambda a: dict(zip("qr", qr(a), strict=True)), "q array<double>, r array<double>")


def matrix_pseudo_inverse(df: DataFrame, column: str, rows: int, columns: int) -> DataFrame:
    """Adds pinv."""
    return solve_rows(df, column, (rows, columns), lambda a: {"pinv": pseudo_inverse(a)}, "pinv array<double>")


def solve_groups(df: DataFrame, key: str, columns: list[str], kernel: Callable[[dict[str, np.ndarray], np.random.Generator], list[dict]], schema: str, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """key and the kernel's rows for each group. Rows of a group come in the order of `order` (by default of the columns), so
    that results don't depend on how they were dealt; rows with a null in the columns are left out."""
    by = order or columns
    names = [x.strip().split()[0] for x in schema.split(",")]
    kind = dict(df.dtypes)[key]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in by])
        k = t.column(key)[0].as_py()
        rng = np.random.default_rng([seed, zlib.crc32(repr(k).encode())])
        rows = kernel({c: t.column(c).to_numpy() for c in columns}, rng)
        return pa.Table.from_pylist([{key: k} | {n: r[n] for n in names} for r in rows], schema=pa.schema([t.schema.field(key), *(pa.field(n, _arrow(x.strip().split(None, 1)[1])) for n, x in zip(names, schema.split(","), strict=True))]))

    used = df.select(key, *dict.fromkeys([*columns, *by])).dropna(subset=[*columns])
    return used.groupBy(key).applyInArrow(run, f"{key} {kind}, {schema}")


def _arrow(kind: str) -> pa.DataType:
    plain = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


MATCH = ["x1", "y1", "x2", "y2"]


def two_views(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([c["x1"], c["y1"]]).astype(float), np.column_stack([c["x2"], c["y2"]]).astype(float)


def estimate_fundamental(matches: DataFrame, key: str, rounds: int = 1000, threshold: float = 0.0015, seed: int = 0) -> DataFrame:
    """matches (key, x1, y1, x2, y2) -> key, f (9), inliers for each pair of views with eight matches and more."""

    def kernel(c, rng):
        f, found = ransac_fundamental(*two_views(c), rng, rounds, threshold)
        return [] if f is None else [{"f": f.ravel().tolist(), "inliers": len(found)}]

    return solve_groups(matches, key, MATCH, kernel, "f array<double>, inliers long", seed)


def estimate_homography(matches: DataFrame, key: str, rounds: int = 1000, threshold: float = 0.005, seed: int = 0) -> DataFrame:
    """matches (key, x1, y1, x2, y2) -> key, h (9, the last one 1), inliers."""

    def kernel(c, rng):
        h, found = ransac_homography(*two_views(c), rng, rounds, threshold)
        return [] if h is None else [{"h": h.ravel().tolist(), "inliers": len(found)}]

    return solve_groups(matches, key, MATCH, kernel, "h array<double>, inliers long", seed)


def estimate_pose(refs: DataFrame, key: str, rounds: int = 1000, threshold: float = 0.005, seed: int = 0) -> DataFrame:
    """refs (key, x, y, z, u, v) of world points and calibrated image points -> key, rot (9), trans (3), inliers."""

    def kernel(c, rng):
        points, seen = np.column_stack([c[k] for k in "xyz"]).astype(float), np.column_stack([c["u"], c["v"]]).astype(float)
        m, found = ransac_pose(points, seen, rng, rounds, threshold)
        return [] if m is None else [{"rot": m[0].ravel().tolist(), "trans": m[1].tolist(), "inliers": len(found)}]

    return solve_groups(refs, key, ["x", "y", "z", "u", "v"], kernel, "rot array<double>, trans array<double>, inliers long", seed)


def triangulate_tracks(refs: DataFrame, track: str, threshold: float = 0.01, degrees: float = 1.0, min_views: int = 2) -> DataFrame:
    """refs (track, view, u, v, rot, trans) of calibrated views -> track, point (3), outliers (views)."""

    def kernel(c, _):
        poses = np.array([np.column_stack([np.array(r, float).reshape(3, 3), t]) for r, t in zip(c["rot"], c["trans"], strict=True)])
        got = triangulate_robust(poses, np.column_stack([c["u"], c["v"]]).astype(float), threshold, np.radians(degrees), min_views) if len(poses) > 1 else None
        return [] if got is None else [{"point": got[0].tolist(), "outliers": [int(c["view"][i]) for i in got[1]]}]

    return solve_groups(refs, track, ["view", "u", "v", "rot", "trans"], kernel, "point array<double>, outliers array<long>", order=["view"])


def similarity_transforms(pairs: DataFrame, key: str) -> DataFrame:
    """pairs (key, p (3), q (3)) -> key, n, rot (9), scale, trans (3) with q = scale rot p + trans; null where the points don't
    determine it. Only sums of each group are gathered, so groups may be of any size."""
    p, q = ([F.get(c, F.lit(i)).cast("double") for i in range(3)] for c in ("p", "q"))
    sums = [F.sum(x).alias(f"p{i}") for i, x in enumerate(p)] + [F.sum(x).alias(f"q{i}") for i, x in enumerate(q)]
    sums += [F.sum(q[i] * p[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)] + [F.sum(sum(x * x for x in p)).alias("pp")]
    made = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums)
    moments = made.select(key, "n", F.array(*(F.col(f"p{i}") for i in range(3)), *(F.col(f"q{i}") for i in range(3)), *(F.col(f"c{i}{j}") for i in range(3) for j in range(3)), F.col("pp"), F.col("n").cast("double")).alias("m"))

    def kernel(a: np.ndarray) -> dict[str, list]:
        out: dict[str, list] = {"t": []}
        for m in a[:, 0]:
            n = m[16]
            cp, cq = m[:3] / n, m[3:6] / n
            u, s, v = svd(m[6:15].reshape(3, 3) / n - np.outer(cq, cp))
            if n < 3 or s[1] < 1e-9 * max(1.0, s[0]):
                out["t"].append(np.full(13, np.nan))
                continue
            d = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
            rot = u * d @ v.T
            scale = (s * d).sum() / (m[15] / n - cp @ cp)
            out["t"].append(np.concatenate([rot.ravel(), [scale], cq - scale * rot @ cp]))
        return out

    got = solve_rows(moments, "m", (1, 17), kernel, "t array<double>")
    bad = F.isnan(F.get("t", F.lit(0)))
    pick = lambda a, n: F.when(~bad, F.slice("t", a, n))
    return got.select(key, "n", pick(1, 9).alias("rot"), F.when(~bad, F.get("t", F.lit(9))).alias("scale"), pick(11, 3).alias("trans"))


def two_view_matching(matches: DataFrame, key: str, least_matches: int = 24, least_inliers: int = 12, rounds: int = 1000, threshold: float = 0.0015, seed: int = 0) -> DataFrame:
    """matches (key of a pair, i, j, x1, y1, x2, y2) -> key, i, j: those that fit the pair's fundamental matrix, of pairs with
    enough matches and enough that fit."""
    counted = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(8, least_matches)).select(key)
    good = matches.join(counted, key, "left_semi")

    def kernel(c, rng):
        p, q = two_views(c)
        _, found = ransac_fundamental(p, q, rng, rounds, threshold)
        return [{"i": int(c["i"][k]), "j": int(c["j"][k])} for k in found] if len(found) >= max(8, least_inliers) else []

    return solve_groups(good, key, ["i", "j", *MATCH], kernel, "i long, j long", seed)


def visible_features(points: DataFrame, cameras: DataFrame, reference: int, low: tuple[float, float, float] | None = None, high: tuple[float, float, float] | None = None) -> DataFrame:
    """points (point, x, y, z, refs: views) and cameras (view, flen, ppx, ppy, aspect, rot, trans, width, height) -> point, view:
    points that the reference view and a further one refer to, in both of their frustums (and in the box, if given)."""
    from vantage.functions import geometry as G

    p = points.where(F.array_contains("refs", reference))
    if low is not None and high is not None:
        p = p.where(G.point_box_overlap([F.col(c) for c in "xyz"], [F.lit(c) for c in low], [F.lit(c) for c in high]))

    def seen():
        cam = G.camera(F.col("flen"), F.col("ppx"), F.col("ppy"), F.col("aspect"), [F.get("rot", F.lit(i)) for i in range(9)], [F.get("trans", F.lit(i)) for i in range(3)])
        return G.in_frustum(cam, [F.col(c).cast("double") for c in "xyz"], F.col("width"), F.col("height"))

    each = p.select("point", "x", "y", "z", F.explode(F.array_distinct("refs")).alias("view")).join(cameras, "view").where(seen()).select("point", "view")
    return each.join(each.where(F.col("view") == reference).select("point"), "point", "left_semi").where(F.col("view") != reference)
