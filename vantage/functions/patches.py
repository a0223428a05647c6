"""Image patches as array columns: colour samples one after the other, three channels each. A null or empty patch, or two of
different sizes, gives null where nothing else is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = 3


def channel(a: Column, c: int) -> Column:
    """The values of one channel."""
    return F.filter(F.transform(a, lambda x, i: F.when(i % CHANNELS == c, x.cast("double"))), lambda x: x.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _products(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation over all channels, each about its own mean; -1 where a patch has one colour."""
    xy = xx = yy = F.lit(0.0)
    for c in range(CHANNELS):
        x, y = channel(a, c), channel(b, c)
        n = F.nullif(F.size(x), F.lit(0)).cast("double")
        sx, sy = _sum(x), _sum(y)
        xy, xx, yy = xy + _products(x, y) - sx * sy / n, xx + _products(x, x) - sx * sx / n, yy + _products(y, y) - sy * sy / n
    size = F.sqrt(F.greatest(xx * yy, F.lit(0.0)))
    return F.when(size > 1e-12, xy / F.nullif(size, F.lit(0.0))).when(size.isNotNull(), F.lit(-1.0))


def scaled(b: Column, scale: list[Column]) -> Column:
    """A patch with each channel multiplied."""
    factors = F.array(*scale)
    return F.transform(b, lambda x, i: x.cast("double") * F.get(factors, i % CHANNELS))


def sad(a: Column, b: Column, scale: list[Column]) -> Column:
    """The sum of absolute differences of the scaled patch b from a."""
    return _sum(F.zip_with(scaled(b, scale), a, lambda x, y: F.abs(x - y.cast("double"))))


def ssd(a: Column, b: Column, scale: list[Column]) -> Column:
    return _sum(F.zip_with(scaled(b, scale), a, lambda x, y: (x - y.cast("double")) * (x - y.cast("double"))))


def color_scale(a: Column, b: Column) -> list[Column]:
    """The factor of each channel that brings b nearest to a; null where b is dark or the factor above 1,000."""
    out = []
    for c in range(CHANNELS):
        x, y = channel(a, c), channel(b, c)
        yy = _products(y, y)
        s = F.when(yy > 1e-6, _products(x, y) / F.nullif(yy, F.lit(0.0)))
        out.append(F.when(s <= 1e3, s))
    return out


def objective(a: Column, b: Column, scale: list[Column], weights: Column) -> Column:
    """The weighted sum of squared differences; weights: one for each sample."""
    d = F.zip_with(scaled(b, scale), a, lambda x, y: (x - y.cast("double")) * (x - y.cast("double")))
    return _sum(F.transform(d, lambda x, i: x * F.get(weights, F.floor(i / CHANNELS).cast("int"))))


def derivative_norm(derivatives: Column, scale: list[Column], weights: Column) -> Column:
    """The weighted sum of the squared scaled derivatives."""
    d = scaled(derivatives, scale)
    return _sum(F.transform(d, lambda x, i: x * x * F.get(weights, F.floor(i / CHANNELS).cast("int"))))


def confidence(nccs: Column, accept: float, facing: Column, converged: Column) -> Column:
    """The mean correlation with the neighbours from `accept` to 1; 0 without convergence or for a surface that faces away by
    more than a cosine of 0.2."""
    mean = _sum(nccs) / F.nullif(F.size(nccs), F.lit(0))
    return F.when(~converged | (facing < 0.2), 0.0).otherwise((mean - accept) / (1 - accept))


def view_benefit(angle: Column, own_print: Column, other_print: Column, selected_angles: Column, least: float = 10.0) -> Column:
    """What a feature seen by a further view is worth: small angles to the reference view and to views already taken count
    less, and so does a resolution unlike the reference's."""
    small = lambda x: F.when(x < least, (x / 10.0) * (x / 10.0)).otherwise(1.0)
    ratio = own_print / F.nullif(other_print, F.lit(0.0))
    fit = F.when(ratio > 2, 2 / ratio).when(ratio > 1, 1.0).otherwise(ratio)
    return small(angle) * fit * F.aggregate(F.coalesce(selected_angles, F.array().cast("array<double>")), F.lit(1.0), lambda s, x: s * small(x))
