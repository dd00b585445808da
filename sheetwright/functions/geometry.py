"""Boxes, zones, points and pixels. Boxes are structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def scaled(b: Column, factor) -> Column:
    return F.struct(*[(b[k] * factor).alias(k) for k in SIDES])


def to_points(b: Column, dpi: float = 200) -> Column:
    """Pixels to points."""
    return scaled(b, 72.0 / dpi)


def to_pixels(b: Column, dpi: float = 200) -> Column:
    """Points to pixels."""
    return scaled(b, dpi / 72.0)


def fraction_to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Fractions of a page to whole pixels, cut off."""
    return F.struct(*[(b[k] * (width if k[0] == "x" else height)).cast("int").alias(k) for k in SIDES])


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes touch or overlap."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def intersection(a: Column, b: Column) -> Column:
    """The common box; null if it has no area."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def valid_fractions(b: Column) -> Column:
    return (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & F.forall(F.array(*[b[k] for k in SIDES]), lambda v: v.between(0, 1))


def vertical_zone(y: Column, b: Column) -> Column:
    """header above 15 % of the box's height, title above 65 %, else info; info for a flat box."""
    height = b["y1"] - b["y0"]
    at = (y - b["y0"]) / height
    return F.when(height <= 0, "info").when(at < 0.15, "header").when(at < 0.65, "title").otherwise("info")


def title_zone(b: Column) -> Column:
    """The part of a box from 15 % to 65 % of its height."""
    h = b["y1"] - b["y0"]
    return box(b["x0"], b["y0"] + 0.15 * h, b["x1"], b["y0"] + 0.65 * h)


def inside_region(b: Column, region: Column, tolerance: float = 0.05) -> Column:
    """Whether a span's centre lies in a region widened by a tolerance; true without a region, false without a span."""
    c, w, h = centre(b), region["x1"] - region["x0"], region["y1"] - region["y0"]
    inside = c["x"].between(region["x0"] - tolerance * w, region["x1"] + tolerance * w) & c["y"].between(region["y0"] - tolerance * h, region["y1"] + tolerance * h)
    return F.when(region.isNull(), True).when(b.isNull(), False).otherwise(inside)


def page_regions(width: Column, height: Column, dpi: float = 200) -> Column:
    """Search regions of a page from the physical size of title blocks: 6.5 by 4 inches, 35 % by 30 % at most."""
    w = F.least(F.lit(0.35), F.lit(6.5) / (width / dpi))
    h = F.least(F.lit(0.30), F.lit(4.0) / (height / dpi))
    region = lambda name, *b: F.struct(F.lit(name).alias("name"), box(*b).alias("box"))
    return F.array(
        region("bottom_right", 1 - w, 1 - h, 1, 1), region("right_strip", 1 - w, 0, 1, 1),
        region("bottom_strip", 0, 1 - h, 1, 1), region("bottom_left", 0, 1 - h, w, 1),
    )


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.degrees(F.atan2(F.abs(y2 - y1), F.abs(x2 - x1)))


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)
