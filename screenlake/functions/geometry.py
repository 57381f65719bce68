"""Box geometry as Column -> Column functions (survey GEO-1..10).

A box is four DOUBLE columns x, y, w, h.  ``box("a_")`` builds the handle for the
columns ``a_x .. a_h``; every function below stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from screenlake.functions.semantics import js_round

EPS = 1e-6


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    def aliased(self, prefix: str = "") -> list[Column]:
        return [getattr(self, c).alias(prefix + c) for c in "xywh"]


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in "xywh"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    return Box(x1, y1, x2 - x1, y2 - y1)


def intersection_area(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    iw = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    ih = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(zero, iw) * F.greatest(zero, ih)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; an empty union gives 0."""
    inter = intersection_area(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def coverage(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for an empty inner box."""
    return F.when(inner.area > 0, intersection_area(inner, outer) / inner.area).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the area of the *first* box (asymmetric)."""
    return coverage(a, b)


def contains(outer: Box, inner: Box, mode: str = "strict") -> Column:
    """Three containment rules: ``strict`` (larger area, no tolerance), ``eps``
    (1e-6 tolerance, larger area) and ``inclusive`` (plain)."""
    eps = EPS if mode == "eps" else 0.0
    inside = (
        (inner.x >= outer.x - eps)
        & (inner.y >= outer.y - eps)
        & (inner.right <= outer.right + eps)
        & (inner.bottom <= outer.bottom + eps)
    )
    if mode == "inclusive":
        return inside
    return inside & (outer.area > inner.area)


def contains_point(b: Box, px: Column, py: Column) -> Column:
    return (px >= b.x) & (px <= b.right) & (py >= b.y) & (py <= b.bottom)


def center_inside(inner: Box, outer: Box) -> Column:
    return contains_point(outer, inner.cx, inner.cy)


def expand(b: Box, margin: float) -> Box:
    return Box(b.x - margin, b.y - margin, b.w + 2 * margin, b.h + 2 * margin)


def shrink(b: Box, margin: float) -> Box:
    return expand(b, -margin)


def clamp(b: Box, width: Column, height: Column) -> Box:
    """Round the corners and clamp them into the image."""
    def into(v: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(hi.cast("double"), js_round(v)))

    return from_corners(into(b.x, width), into(b.y, height), into(b.right, width), into(b.bottom, height))


def clip(b: Box, bounds: Box) -> Box:
    """Intersection box; all four values are NULL when it is empty."""
    x0, y0 = F.greatest(b.x, bounds.x), F.greatest(b.y, bounds.y)
    x1, y1 = F.least(b.right, bounds.right), F.least(b.bottom, bounds.bottom)
    ok = (x1 > x0) & (y1 > y0)
    return Box(*(F.when(ok, v) for v in (x0, y0, x1 - x0, y1 - y0)))


def scale(b: Box, fx: Column, fy: Column) -> Box:
    return Box(b.x * fx, b.y * fy, b.w * fx, b.h * fy)


def union_box(prefix: str = "") -> list[Column]:
    """Aggregate expressions of the envelope of a group of valid boxes."""
    b = box(prefix)
    ok = valid_box(b)
    x0, y0 = F.min(F.when(ok, b.x)), F.min(F.when(ok, b.y))
    x1, y1 = F.max(F.when(ok, b.right)), F.max(F.when(ok, b.bottom))
    zero = F.lit(0.0)
    return [
        F.coalesce(x0, zero).alias("x"),
        F.coalesce(y0, zero).alias("y"),
        F.coalesce(x1 - x0, zero).alias("w"),
        F.coalesce(y1 - y0, zero).alias("h"),
    ]


def h_gap(a: Box, b: Box) -> Column:
    """Horizontal gap between two boxes, 0 when they overlap in x."""
    return F.greatest(F.lit(0.0), F.greatest(a.x, b.x) - F.least(a.right, b.right))


def v_overlap_ratio(a: Box, b: Box) -> Column:
    """Vertical overlap over the smaller height (at least 1)."""
    over = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return over / F.greatest(F.lit(1.0), F.least(a.h, b.h))


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = a.cx - b.cx, a.cy - b.cy
    return F.sqrt(dx * dx + dy * dy)


def valid_box(b: Box) -> Column:
    """Finite numbers and a positive size."""
    big = 1.7976931348623157e308
    finite = F.lit(True)
    for v in (b.x, b.y, b.w, b.h):
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= big)
    return F.coalesce(finite & (b.w > 0) & (b.h > 0), F.lit(False))


def box_key(b: Box) -> Column:
    """Rounded ``x,y,w,h`` text."""
    return F.concat_ws(",", *(js_round(v).cast("bigint").cast("string") for v in (b.x, b.y, b.w, b.h)))


def complexity_bucket(width: Column, height: Column, size: Column) -> Column:
    """low / medium / high by megapixels and bytes."""
    pixels = width.cast("double") * height.cast("double")
    return (
        F.when((pixels < 500_000) | (size < 100_000), "low")
        .when((pixels < 2_000_000) | (size < 1_000_000), "medium")
        .otherwise("high")
    )


def aspect(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(0.0))
