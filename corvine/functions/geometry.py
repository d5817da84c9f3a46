"""Rectangles and coordinates as column expressions. A rectangle is four columns, closed, y downward."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Rect:
        return cls(*[F.col(f"{prefix}{n}") for n in ("left", "top", "right", "bottom")])

    @property
    def width(self) -> Column:
        return F.greatest(self.right - self.left, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.bottom - self.top, F.lit(0.0))

    @property
    def area(self) -> Column:
        return self.width * self.height


def intersects(a: Rect, b: Rect) -> Column:
    """Touching counts."""
    return (a.left <= b.right) & (b.left <= a.right) & (a.top <= b.bottom) & (b.top <= a.bottom)


def overlaps(a: Rect, b: Rect, least: float = 1e-6) -> Column:
    """More than ``least`` in common on both axes."""
    return (F.least(a.right, b.right) - F.greatest(a.left, b.left) > least) & (F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top) > least)


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 where two closed intervals meet, else their distance."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def rect_distance(a: Rect, b: Rect) -> Column:
    dx, dy = interval_gap(a.left, a.right, b.left, b.right), interval_gap(a.top, a.bottom, b.top, b.bottom)
    return F.sqrt(dx * dx + dy * dy)


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length over the shorter interval."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, both / short).otherwise(0.0)


def same_region(inner: Rect, outer: Rect, share: float = 0.05) -> Column:
    """inner lies in outer and all four edges agree within a share of outer's size."""
    inside = (inner.left >= outer.left) & (inner.right <= outer.right) & (inner.top >= outer.top) & (inner.bottom <= outer.bottom)
    dx, dy = outer.width * share, outer.height * share
    return inside & (inner.left - outer.left <= dx) & (outer.right - inner.right <= dx) & (inner.top - outer.top <= dy) & (outer.bottom - inner.bottom <= dy)


def to_logical_x(x: Column, left: Column, width: Column, units: Column) -> Column:
    """Position in grid units; null without units or for a block without width."""
    return F.when(units.isNotNull() & (width > 1e-9), (x - left) / width * units)


def to_physical_x(logical: Column, left: Column, width: Column, units: Column) -> Column:
    return F.when(units > 0, left + logical / units * width)


def line_at(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """y of the line through two points at x; y0 for a vertical one."""
    return F.when(F.abs(x1 - x0) < 1e-9, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def shoelace(points: Column) -> Column:
    """Signed area of a ring given as an array of (x, y)."""
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x) / 2


def perimeter(points: Column) -> Column:
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)), F.lit(0.0), lambda s, x: s + x)


def circularity(points: Column) -> Column:
    """4 pi area / perimeter^2: 1 for a circle."""
    around = perimeter(points)
    return F.when(around > 0, F.abs(shoelace(points)) * 12.566370614359172 / (around * around)).otherwise(0.0)


def radial_variation(points: Column, box: Rect) -> Column:
    """Coefficient of variation of the points' radii from the box's centre, in units of its half width and half height; 0 for an ellipse in its box."""
    rx, ry = F.greatest(box.width / 2, F.lit(1e-9)), F.greatest(box.height / 2, F.lit(1e-9))
    cx, cy = (box.left + box.right) / 2, (box.top + box.bottom) / 2
    radii = F.transform(points, lambda p: F.sqrt(F.pow((p["x"] - cx) / rx, 2) + F.pow((p["y"] - cy) / ry, 2)))
    total = lambda of: F.aggregate(radii, F.lit(0.0), lambda s, x: s + of(x))
    mean = total(lambda x: x) / F.size(points)
    variance = F.aggregate(radii, F.lit(0.0), lambda s, x: s + F.pow(x - mean, 2)) / F.size(points)
    return F.when(mean > 1e-9, F.sqrt(variance) / mean)
