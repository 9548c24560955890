"""Column functions over boxes, bands and affine maps.

A box is struct<x,y,width,height>. Spaces are kept apart by column names: _c canonical, _w work, _r region.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mm_to_px(mm: Column | float, dpi: Column | float) -> Column:
    """Rounded half to even."""
    mm = mm if isinstance(mm, Column) else F.lit(float(mm))
    dpi = dpi if isinstance(dpi, Column) else F.lit(float(dpi))
    return F.bround(mm * dpi / 25.4).cast("int")


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    names = ("x", "y", "width", "height")
    return F.struct(*(v.cast("int").alias(n) for v, n in zip((x, y, width, height), names)))


def x2(b: Column) -> Column:
    return b["x"] + b["width"]


def y2(b: Column) -> Column:
    return b["y"] + b["height"]


def centre_x(b: Column) -> Column:
    return b["x"] + b["width"] / 2


def centre_y(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def corners(b: Column) -> Column:
    """Clockwise from the top left."""
    return F.array(F.array(b["x"], b["y"]), F.array(x2(b), b["y"]), F.array(x2(b), y2(b)), F.array(b["x"], y2(b)))


def polygon_box(polygon: Column) -> Column:
    """The smallest whole box around a polygon, 1 wide and high at least."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    left, top = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    return box(left, top, F.greatest(F.lit(1), F.ceil(F.array_max(xs)) - left), F.greatest(F.lit(1), F.ceil(F.array_max(ys)) - top))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box inside [0, width) x [0, height), 1 wide and high at least."""
    left = F.least(F.greatest(b["x"], F.lit(0)), width - 1)
    top = F.least(F.greatest(b["y"], F.lit(0)), height - 1)
    right = F.greatest(left + 1, F.least(x2(b), width))
    bottom = F.greatest(top + 1, F.least(y2(b), height))
    return box(left, top, right - left, bottom - top)


def overlap_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(x2(a), x2(b)) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    inter = overlap_area(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def hull(a: Column, b: Column) -> Column:
    left, top = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(left, top, F.greatest(x2(a), x2(b)) - left, F.greatest(y2(a), y2(b)) - top)


def union(boxes: Column) -> Column:
    """The hull of an array of boxes; null for an empty one."""
    return F.aggregate(boxes, F.get(boxes, F.lit(0)), hull)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the smaller height; negative for boxes apart."""
    return (F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"])) / F.greatest(F.lit(1), F.least(a["height"], b["height"]))


def band_index(y: Column, lines: Column) -> Column:
    """The ruled band that y lies in: -1 above the first line, null without lines. Lines ascend."""
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda v: v <= y)) - 1)


def band_distance(band_a: Column, band_b: Column, y_a: Column, y_b: Column, height_a: Column) -> Column:
    """Bands apart; without bands 0 for boxes nearer than three heights, else 99."""
    near = F.when(F.abs(y_a - y_b) < 3 * F.greatest(height_a, F.lit(1)), 0).otherwise(99)
    return F.when(band_a.isNull() | band_b.isNull(), near).otherwise(F.abs(band_a - band_b))


def affine(m: Column, x: Column, y: Column) -> Column:
    """struct<x,y> under a map of six numbers (a, b, tx, c, d, ty)."""
    return F.struct((m[0] * x + m[1] * y + m[2]).alias("x"), (m[3] * x + m[4] * y + m[5]).alias("y"))


def identity() -> Column:
    return F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))


def translation(tx: Column, ty: Column) -> Column:
    return F.array(F.lit(1.0), F.lit(0.0), tx.cast("double"), F.lit(0.0), F.lit(1.0), ty.cast("double"))


def inverse(m: Column) -> Column:
    det = m[0] * m[4] - m[1] * m[3]
    a, b, c, d = m[4] / det, -m[1] / det, -m[3] / det, m[0] / det
    return F.array(a, b, -(a * m[2] + b * m[5]), c, d, -(c * m[2] + d * m[5]))


def compose(after: Column, before: Column) -> Column:
    """The map that applies before, then after."""
    p, q = after, before
    return F.array(
        p[0] * q[0] + p[1] * q[3], p[0] * q[1] + p[1] * q[4], p[0] * q[2] + p[1] * q[5] + p[2],
        p[3] * q[0] + p[4] * q[3], p[3] * q[1] + p[4] * q[4], p[3] * q[2] + p[4] * q[5] + p[5],
    )


def mapped_polygon(m: Column, polygon: Column) -> Column:
    """Points under a map, rounded half to even."""
    def point(p: Column) -> Column:
        q = affine(m, p[0], p[1])
        return F.array(F.bround(q["x"]).cast("int"), F.bround(q["y"]).cast("int"))

    return F.transform(polygon, point)


def marker_id(script: Column, page: Column, version: Column, band: Column, b: Column, dpi: Column) -> Column:
    """16 hex digits that stay the same from run to run; a missing band is written as None."""
    bucket = F.floor(b["x"] / F.greatest(F.lit(1), mm_to_px(5.0, dpi)))
    parts = (script, page, version, F.coalesce(band.cast("string"), F.lit("None")), bucket.cast("string"), b["y"].cast("string"))
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("None")) for p in parts))), 1, 16)


def pdf_points(x: Column, y: Column, dpi: Column, page_height_pt: Column) -> Column:
    """Canonical pixels to PDF points, whose y grows upwards."""
    return F.struct((x * 72 / dpi).alias("x"), (page_height_pt - y * 72 / dpi).alias("y"))
