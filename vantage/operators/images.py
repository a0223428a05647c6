"""Images as rows: path, width, height, channels, type and packed data, as vantage.sources.images reads them.

A kernel takes an array (height, width, channels) and gives another one; `on_images` applies it to every row in Arrow
batches, so a corpus of images is spread over the cluster and no image is split. Kernels keep the type of their input:
bytes are rounded half up, floats stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray], np.ndarray]
FIELDS = ("width", "height", "channels", "type", "data")
#: A Gaussian is cut off where it falls to 1/64 of its peak, at so many sigmas.
CUT = 2.884


def array_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["type"])).reshape(row["height"], row["width"], row["channels"])


def fields_of(v: np.ndarray) -> dict:
    v = np.ascontiguousarray(v)
    return {"width": v.shape[1], "height": v.shape[0], "channels": v.shape[2], "type": v.dtype.name, "data": v.tobytes()}


def on_images(images: DataFrame, kernel: Kernel) -> DataFrame:
    """images with each row's image replaced by the kernel's; other columns stay. A null image stays null."""
    schema, names = images.schema, images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image may be large
                row = batch.slice(i, 1).to_pylist()[0]
                if row["data"] is not None:
                    row |= fields_of(kernel(array_of(row)))
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return images.select(*names).mapInArrow(run, schema)


def on_pairs(images: DataFrame, others: DataFrame, key: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key and image: the kernel's of the images of both tables with the same key."""
    own = [c for c in FIELDS if c in images.columns]
    both = images.select(key, *own).join(others.select(key, *(others[c].alias(f"other_{c}") for c in own)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = fields_of(kernel(array_of(row), array_of({c: row[f"other_{c}"] for c in FIELDS})))
                fields = [batch.schema.field(c) for c in (key, *own)]
                yield pa.RecordBatch.from_pylist([{key: row[key]} | out], schema=pa.schema(fields))

    return both.mapInArrow(run, images.select(key, *own).schema)


def typed(v: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Computed values in an image's type: whole numbers rounded half up within their range."""
    if like.dtype.kind == "f":
        return v.astype(like.dtype)
    most = np.iinfo(like.dtype).max
    return np.clip(np.floor(v + 0.5), 0, most).astype(like.dtype)


def take(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixels at rows y and columns x, the nearest one outside."""
    return v[np.clip(y, 0, v.shape[0] - 1)[:, None], np.clip(x, 0, v.shape[1] - 1)[None, :]]


def linear_at(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples (not rounded) at points; outside, those of the border."""
    h, w = v.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    a, b = (x - x0)[..., None], (y - y0)[..., None]
    f = v.astype(float)
    return (1 - b) * ((1 - a) * f[y0, x0] + a * f[y0, x1]) + b * ((1 - a) * f[y1, x0] + a * f[y1, x1])


# --- sizes ---


def half_size(v: np.ndarray) -> np.ndarray:
    """Means of 2 by 2 pixels; at odd ends the last pixel counts twice."""
    y, x = 2 * np.arange((v.shape[0] + 1) // 2), 2 * np.arange((v.shape[1] + 1) // 2)
    f = v.astype(float)
    return typed(sum(take(f, y + i, x + j) for i in (0, 1) for j in (0, 1)) / 4, v)


def half_size_gaussian(v: np.ndarray, sigma: float = math.sqrt(3) / 2) -> np.ndarray:
    """4 by 4 Gaussian weights about each 2 by 2 pixels."""
    y, x = 2 * np.arange((v.shape[0] + 1) // 2), 2 * np.arange((v.shape[1] + 1) // 2)
    f, at = v.astype(float), (-1, 0, 1, 2)
    weight = {(i, j): math.exp(-((i - 0.5) ** 2 + (j - 0.5) ** 2) / (2 * sigma**2)) for i in at for j in at}
    return typed(sum(w * take(f, y + i, x + j) for (i, j), w in weight.items()) / sum(weight.values()), v)


def half_size_subsample(v: np.ndarray) -> np.ndarray:
    return v[::2, ::2]


def double_size(v: np.ndarray) -> np.ndarray:
    """Each output pixel mixes its four nearest by 9/16, 3/16, 3/16 and 1/16; the border counts on."""
    y, x = np.arange(2 * v.shape[0]), np.arange(2 * v.shape[1])
    near_y, near_x = y // 2, x // 2
    far_y, far_x = near_y + np.where(y % 2, 1, -1), near_x + np.where(x % 2, 1, -1)
    f = v.astype(float)
    return typed((9 * take(f, near_y, near_x) + 3 * take(f, near_y, far_x) + 3 * take(f, far_y, near_x) + take(f, far_y, far_x)) / 16, v)


def double_size_supersample(v: np.ndarray) -> np.ndarray:
    """Means of the pixels at (x / 2, (x + 1) / 2) by (y / 2, (y + 1) / 2), in whole numbers."""
    y, x = np.arange(2 * v.shape[0]), np.arange(2 * v.shape[1])
    f = v.astype(float)
    return typed(sum(take(f, a, b) for a in (y // 2, (y + 1) // 2) for b in (x // 2, (x + 1) // 2)) / 4, v)


def rescale_nearest(v: np.ndarray, width: int, height: int) -> np.ndarray:
    return take(v, ((np.arange(height) + 0.5) * v.shape[0] / height).astype(int), ((np.arange(width) + 0.5) * v.shape[1] / width).astype(int))


def rescale_linear(v: np.ndarray, width: int, height: int) -> np.ndarray:
    x, y = (np.arange(width) + 0.5) * v.shape[1] / width - 0.5, (np.arange(height) + 0.5) * v.shape[0] / height - 0.5
    return typed(linear_at(v, *np.meshgrid(x, y)), v)


def gaussian_kernel(v: np.ndarray, x: float, y: float, sigma: float) -> np.ndarray:
    """The weighted mean about a point between pixels (0.5 is the first one's centre); pixels that the kernel cuts count
    in part."""
    reach = sigma * CUT

    def axis(at: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = math.floor(at - reach), math.ceil(at + reach - 1)
        i = np.arange(max(0, low), min(size - 1, high) + 1)
        w = np.exp(-((i + 0.5 - at) ** 2) / (2 * sigma**2))
        if low > 0:
            w[0] *= low + 1 + reach - at
        if high < size - 1:
            w[-1] *= reach + at - high
        return i, w

    (xi, wx), (yi, wy) = axis(x, v.shape[1]), axis(y, v.shape[0])
    return np.einsum("yxc,y,x->c", v[yi[:, None], xi].astype(float), wy, wx) / (wy.sum() * wx.sum())


def rescale_gaussian(v: np.ndarray, width: int, height: int, factor: float = 1.0) -> np.ndarray:
    sx, sy = v.shape[1] / width, v.shape[0] / height
    sigma = factor * max(sx, sy) / 2
    return typed(np.array([[gaussian_kernel(v, (x + 0.5) * sx, (y + 0.5) * sy, sigma) for x in range(width)] for y in range(height)]), v)


def rescale(v: np.ndarray, kind: str, width: int, height: int) -> np.ndarray:
    """To width by height, one of which may be 0 to keep the aspect; nearest and linear halve first while they can."""
    if width == 0 and height == 0:
        raise ValueError("no size")
    if (height, width) == v.shape[:2]:
        return v
    width, height = width or height * v.shape[1] // v.shape[0], height or width * v.shape[0] // v.shape[1]
    while kind in ("nearest", "linear") and 2 * width <= v.shape[1] and 2 * height <= v.shape[0]:
        v = half_size(v)
    return {"nearest": rescale_nearest, "linear": rescale_linear, "gaussian": rescale_gaussian}[kind](v, width, height)


def limit_size(v: np.ndarray, max_pixels: int) -> np.ndarray:
    while v.shape[0] * v.shape[1] > max_pixels:
        v = half_size(v)
    return v


def crop(v: np.ndarray, width: int, height: int, left: int, top: int, fill=0) -> np.ndarray:
    """A rectangle; what lies outside the image has the fill colour."""
    out = np.empty((height, width, v.shape[2]), v.dtype)
    out[:] = np.asarray(fill, v.dtype)
    x0, x1, y0, y1 = max(0, left), min(v.shape[1], left + width), max(0, top), min(v.shape[0], top + height)
    if x0 < x1 and y0 < y1:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = v[y0:y1, x0:x1]
    return out


def create_thumbnail(v: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled to cover the size, and its middle cut out."""
    aspect, h, w = np.float32(v.shape[1] / v.shape[0]), height, width
    if aspect > np.float32(width / height):
        w = math.ceil(height * aspect)
    else:
        h = math.ceil(width / aspect)
    return crop(rescale(v, "linear", w, h), width, height, (w - width) // 2, (h - height) // 2)


# --- filters ---


def blur_gaussian(v: np.ndarray, sigma: float) -> np.ndarray:
    """Along rows, then columns; the border counts on, and each pass is rounded to the image's type. Below 0.1 a copy."""
    if abs(sigma) <= 0.1:
        return v
    reach = math.ceil(sigma * CUT)
    at = np.arange(-reach, reach + 1)
    weight = np.exp(-(at**2) / (2 * sigma**2))
    for axis in (1, 0):
        n = np.arange(v.shape[axis])
        v = typed(sum(w * np.take(v, np.clip(n + i, 0, len(n) - 1), axis).astype(float) for i, w in zip(at, weight, strict=True)) / weight.sum(), v)
    return v


def blur_boxfilter(v: np.ndarray, reach: int) -> np.ndarray:
    """Means of up to 2 * reach + 1 pixels along rows, then columns. The window is cut at the start; at the end the last
    pixel stays out of it, and what has entered leaves as the window moves."""
    for axis in (1, 0):
        n = v.shape[axis]
        if reach > n:
            raise ValueError("the window is larger than the image")
        sums = np.concatenate([np.zeros_like(np.take(v, [0], axis), float), np.cumsum(v.astype(float), axis)], axis)
        x = np.arange(n)
        # Entered: the first `reach` at the start, then x + reach while that lies before the last pixel.
        end = np.maximum(reach, np.minimum(x + reach + 1, n - 1))
        start = np.maximum(0, x - reach)
        size = (end - start).reshape([-1 if a == axis else 1 for a in range(3)])
        v = typed((np.take(sums, end, axis) - np.take(sums, start, axis)) / size, v)
    return v


def sobel_edge(v: np.ndarray) -> np.ndarray:
    """The gradient's length, at most the type's largest value (1 for floats has no limit); zero on the border."""
    f = v.astype(float)
    out = np.zeros_like(f)
    smooth = f[:, :-2] + 2 * f[:, 1:-1] + f[:, 2:]
    slope = f[:, 2:] - f[:, :-2]
    gx, gy = slope[:-2] + 2 * slope[1:-1] + slope[2:], smooth[2:] - smooth[:-2]
    out[1:-1, 1:-1] = np.hypot(gx, gy)
    return out.astype(v.dtype) if v.dtype.kind == "f" else np.minimum(out, np.iinfo(v.dtype).max).astype(v.dtype)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b; bytes wrap below zero."""
    if a.shape != b.shape:
        raise ValueError("sizes differ")
    return a - b


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape != b.shape:
        raise ValueError("sizes differ")
    return np.maximum(a, b) - np.minimum(a, b)


# --- turns ---


def rotate(v: np.ndarray, kind: str) -> np.ndarray:
    """By 180 degrees, clockwise (cw), counter-clockwise (ccw), or with rows and columns swapped (swap)."""
    swapped = v.transpose(1, 0, 2)
    return {"180": lambda: v[::-1, ::-1], "cw": lambda: swapped[:, ::-1], "ccw": lambda: swapped[::-1], "swap": lambda: swapped}[kind]()


def inside(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (x >= -0.5) & (x <= v.shape[1] - 0.5) & (y >= -0.5) & (y <= v.shape[0] - 0.5)


def resample(v: np.ndarray, x: np.ndarray, y: np.ndarray, fill=0) -> np.ndarray:
    """Bilinear samples at points; the fill colour outside."""
    out = typed(linear_at(v, x, y), v)
    out[~inside(x, y, v)] = np.asarray(fill, v.dtype)
    return out


def grid_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(v.shape[1], dtype=float), np.arange(v.shape[0], dtype=float))


def rotate_by(v: np.ndarray, angle: float, fill=0) -> np.ndarray:
    """By an angle about the middle."""
    x, y = grid_of(v)
    cx, cy, s, c = (v.shape[1] - 1) / 2, (v.shape[0] - 1) / 2, math.sin(-angle), math.cos(-angle)
    return resample(v, c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy, fill)


def flip(v: np.ndarray, horizontal: bool = False, vertical: bool = False) -> np.ndarray:
    return v[:: -1 if vertical else 1, :: -1 if horizontal else 1]


# --- lens distortion ---


def undistort_msps(v: np.ndarray, k0: float, k1: float) -> np.ndarray:
    """Pixels move by (1 + k1 r^2) / (1 + k0 r^2), r in units of the larger side."""
    x, y = grid_of(v)
    w, h, side = v.shape[1] / 2, v.shape[0] / 2, max(v.shape[:2])
    r2 = ((x - w) ** 2 + (y - h) ** 2) / side**2
    f = (1 + k1 * r2) / (1 + k0 * r2)
    return resample(v, (x - w) * f + w, (y - h) * f + h)


def undistort_k2k4(v: np.ndarray, focal: float, k2: float, k4: float) -> np.ndarray:
    """Pixel centres move by 1 + k2 r^2 + k4 r^4, r in units of the focal length."""
    if k2 == 0 and k4 == 0:
        return v
    x, y = grid_of(v)
    w, h, side = v.shape[1] / 2, v.shape[0] / 2, max(v.shape[:2])
    fx, fy = (x + 0.5 - w) / side, (y + 0.5 - h) / side
    r2 = (fx**2 + fy**2) / focal**2
    f = 1 + k2 * r2 + k4 * r2**2
    return resample(v, fx * f * side + w - 0.5, fy * f * side + h - 0.5)


def undistort_vsfm(v: np.ndarray, focal: float, k1: float) -> np.ndarray:
    """Pixels move to the undistorted radius u of u (1 + k1 u^2) = r: the real root that goes to r as k1 vanishes."""
    if k1 == 0:
        return v
    x, y = grid_of(v)
    w, h, norm = v.shape[1] / 2, v.shape[0] / 2, focal * max(v.shape[:2])
    fx, fy = (x - w) / norm, (y - h) / norm
    r = np.hypot(fx, fy)
    u = _cubic_radius(r, k1)
    f = np.divide(u, r, out=np.ones_like(r), where=r > 0)
    return resample(v, fx * f * norm + w, fy * f * norm + h)


def _cubic_radius(r: np.ndarray, k: float) -> np.ndarray:
    """The root of k u^3 + u - r that starts at 0 with r: hyperbolic for k > 0; for k < 0 trigonometric, and beyond the
    largest radius that has one the real part of its continuation."""
    m = math.sqrt(4 / (3 * abs(k)))
    q = 4 * r / (abs(k) * m**3)
    if k > 0:
        return m * np.sinh(np.arcsinh(q) / 3)
    return m * np.where(q <= 1, np.sin(np.arcsin(np.minimum(q, 1)) / 3), np.cosh(np.arccosh(np.maximum(q, 1)) / 3) / 2)


# --- drawing ---


def draw_line(v: np.ndarray, x0: int, y0: int, x1: int, y1: int, color) -> np.ndarray:
    """Bresenham's line; the end points lie in the image."""
    v = v.copy()
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    err = dx - dy
    while True:
        v[y0, x0] = color
        if (x0, y0) == (x1, y1):
            return v
        twice = 2 * err
        if twice > -dy:
            err, x0 = err - dy, x0 + sx
        if twice < dx:
            err, y0 = err + dx, y0 + sy


def draw_circle(v: np.ndarray, x: int, y: int, radius: int, color) -> np.ndarray:
    """The midpoint circle; it lies in the image."""
    v = v.copy()
    px, py, f = 0, radius, 1 - radius
    while True:
        for a, b in ((px, py), (py, px)):
            v[[y + b, y + b, y - b, y - b], [x + a, x - a, x + a, x - a]] = color
        if px >= py:
            return v
        if f >= 0:
            py -= 1
            f -= 2 * py
        px += 1
        f += 2 * px + 1


def draw_rectangle(v: np.ndarray, x0: int, y0: int, x1: int, y1: int, color) -> np.ndarray:
    """Filled, corners included, clipped to the image."""
    v = v.copy()
    (x0, x1), (y0, y1) = (np.clip(sorted(p), 0, n - 1) for p, n in (((x0, x1), v.shape[1]), ((y0, y1), v.shape[0])))
    v[y0 : y1 + 1, x0 : x1 + 1] = color
    return v


# --- depth maps ---


def islands(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected regions of a mask from 1, 0 outside: minima spread until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        near = np.where(mask, label, big)
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved = np.full_like(near, big)
            src, dst = [slice(None)] * 2, [slice(None)] * 2
            src[axis], dst[axis] = (slice(None, -1), slice(1, None)) if step > 0 else (slice(1, None), slice(None, -1))
            moved[tuple(dst)] = near[tuple(src)]
            near = np.where(mask, np.minimum(near, moved), big)
        flat = np.append(near.ravel(), 0)
        near = np.where(mask, np.minimum(near, flat[np.where(mask, near, 1) - 1]), 0)
        if np.array_equal(near, label):
            return label
        label = near


def depthmap_cleanup(v: np.ndarray, least: int) -> np.ndarray:
    """Without 4-connected islands of depths above zero of fewer than `least` pixels."""
    label = islands(v[..., 0] > 0)
    size = np.bincount(label.ravel(), minlength=v.shape[0] * v.shape[1] + 1)
    return np.where(((label > 0) & (size[label] < least))[..., None], np.zeros((), v.dtype), v)


def depthmap_confidence_clean(depth: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """Depth is zero where there is no confidence."""
    return np.where(confidence > 0, depth, np.zeros((), depth.dtype))


def convert_depth(v: np.ndarray, inverse_calibration: np.ndarray, to_ray: bool = True) -> np.ndarray:
    """Depths along the optical axis to those along each pixel's ray, or back."""
    x, y = grid_of(v)
    length = np.linalg.norm(np.stack([x + 0.5, y + 0.5, np.ones_like(x)], -1) @ np.asarray(inverse_calibration, float).reshape(3, 3).T, axis=-1)[..., None]
    return (v * length if to_ray else v / length).astype(v.dtype)
