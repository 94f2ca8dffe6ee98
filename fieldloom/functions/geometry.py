"""Boxes as columns x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "width", "height"))


def overlap(a: Box, b: Box) -> Column:
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area, 0 where both are empty."""
    both = overlap(a, b)
    joint = a[2] * a[3] + b[2] * b[3] - both
    return F.when(joint > 0, both / joint).otherwise(0.0)


def contains(outer: Box, inner: Box, slack: float = 0.0, most: float | None = None) -> Column:
    """Whether a box lies in another, up to ``slack``, and (with ``most``) takes no more than that share of its area."""
    inside = (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[0] + inner[2] <= outer[0] + outer[2] + slack) & (inner[1] + inner[3] <= outer[1] + outer[3] + slack)
    return inside if most is None else inside & (inner[2] * inner[3] <= outer[2] * outer[3] * most)


def shares(a: Box, b: Box, least: float = 1e-6) -> tuple[Column, Column]:
    """Overlap in x and in y as shares of the smaller box; negative where they lie apart."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return wide / F.greatest(F.least(a[2], b[2]), F.lit(least)), high / F.greatest(F.least(a[3], b[3]), F.lit(least))


def same_target(a: Box, b: Box) -> Column:
    """Whether two fields stand for one place: 0.3 IoU, or half of the smaller one both ways."""
    x, y = shares(a, b)
    return (iou(a, b) >= 0.3) | ((x >= 0.5) & (y >= 0.5))


def same_region(a: Box, b: Box, least_iou: float = 0.45) -> Column:
    """Whether two candidates are one region: ``least_iou``, or 0.55 of the smaller one in x and half in y."""
    x, y = shares(a, b, 1.0)
    return (iou(a, b) >= least_iou) | ((x >= 0.55) & (y >= 0.5))


def normalised(pixel: Box, width: Column, height: Column) -> Box:
    """Pixels as shares of the page, cut to it."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return clamped((pixel[0] / w, pixel[1] / h, pixel[2] / w, pixel[3] / h))


def clamped(b: Box) -> Box:
    bound = lambda c, high: F.least(F.greatest(c, F.lit(0.0)), high)
    x, y = bound(b[0], F.lit(1.0)), bound(b[1], F.lit(1.0))
    return x, y, bound(b[2], 1.0 - x), bound(b[3], 1.0 - y)


def to_pixels(b: Box, width: Column, height: Column) -> Box:
    """Shares of the page as whole pixels, cut off; boxes are a pixel wide and high at least."""
    cut = lambda c: c.cast("int")
    return cut(b[0] * width), cut(b[1] * height), F.greatest(cut(b[2] * width), F.lit(1)), F.greatest(cut(b[3] * height), F.lit(1))


def inline_blank(cell: Box, text_left: Column, text_right: Column, rtl: Column) -> tuple[Column, Box]:
    """Width of the free part of a cell behind its caption in reading order, and the blank there."""
    free = F.when(rtl, text_left - cell[0]).otherwise(cell[0] + cell[2] - text_right)
    return free, (F.when(rtl, cell[0] + 2).otherwise(text_right + 6), cell[1] + 2, free - 8, cell[3] - 4)


def line_blank(line: Box, page_width: Column, rtl: Column) -> tuple[Column, Box]:
    """Width of the free part of a line up to the page's margin of 7 %, and the blank there."""
    left, right = F.floor(page_width * 0.07), F.floor(page_width * 0.93)
    free = F.when(rtl, line[0] - left).otherwise(right - (line[0] + line[2]))
    return free, (F.when(rtl, left).otherwise(line[0] + line[2] + 8), line[1] - 2, free - 8, F.greatest(F.lit(16), line[3] + 6))


def centred(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Where text of a width and height begins to stand in the middle of a box, not before its edge; and whether it is too large for it."""
    return box[0] + F.greatest(F.lit(0.0), (box[2] - width) / 2), box[1] + F.greatest(F.lit(0.0), (box[3] - height) / 2), (width > box[2]) | (height > box[3])
