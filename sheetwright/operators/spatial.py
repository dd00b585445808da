"""Spatial operators on text blocks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIDES
from ..functions.scores import span_score

_VALUE = r"^[A-Z]{1,3}[-.]?\d{1,4}(?:\.\d{1,2})?$"


def nearest_value(blocks: DataFrame, width: float = 2592, height: float = 1728) -> DataFrame:
    """The value block nearest to a label on each page: (page, value, dist).

    A value counts within 7 % of the page or 150 points of a label, both
    ways. Ties go to the first label, then the first value. Pages meet their
    own blocks only, and the nearest pair is an aggregate, so no page is
    gathered or sorted.
    """
    labels = blocks.where(F.upper("text").rlike(r"\b(?:SHEET|DWG|DRAWING)\s*(?:NUMBER|NO|#)?\b")).select("page", F.col("pos").alias("lpos"), F.col("x0").alias("lx"), F.col("y0").alias("ly"))
    values = blocks.where(F.upper("text").rlike(_VALUE)).select("page", F.col("pos").alias("vpos"), F.col("x0").alias("vx"), F.col("y0").alias("vy"), F.col("text").alias("value"))
    dx, dy = F.abs(F.col("vx") - F.col("lx")), F.abs(F.col("vy") - F.col("ly"))
    near = labels.join(values, "page").where((dx <= max(0.07 * width, 150.0)) & (dy <= max(0.07 * height, 150.0)))
    near = near.withColumn("d2", dx * dx + dy * dy)
    best = near.groupBy("page").agg(F.min(F.struct("d2", "lpos", "vpos", "value")).alias("b"))
    return best.select("page", F.col("b.value").alias("value"), F.sqrt("b.d2").alias("dist"))


def band_value(blocks: DataFrame) -> DataFrame:
    """The first value among the blocks from one before to three after a label, by position."""
    label = blocks.where(F.upper("text").rlike(r"\b(?:SHEET|DWG|DRAWING)\b"))
    tried = label.select("page", F.col("pos").alias("lpos"), F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + 3)).alias("pos"))
    hit = tried.join(blocks.where(F.upper("text").rlike(_VALUE)), ["page", "pos"])
    return hit.groupBy("page").agg(F.min(F.struct("lpos", "pos", "text")).alias("b")).select("page", F.col("b.text").alias("value"))


def best_span(spans: DataFrame) -> DataFrame:
    """The span of each page with the best score above 0; the first of equals.

    ``spans``: page, ord, text, box, font_size, block.
    """
    s = spans.withColumn("score", span_score(F.col("text"), F.col("box"), F.col("font_size"), F.col("block"))).where("score > 0")
    return s.groupBy("page").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("page", "b.text", "b.score")


def intersecting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes of one page that touch or overlap."""
    left = a.select("page", F.col("pos").alias("a_pos"), *[F.col(k).alias(f"a_{k}") for k in SIDES])
    right = b.select("page", F.col("pos").alias("b_pos"), *[F.col(k).alias(f"b_{k}") for k in SIDES])
    touch = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    return left.join(right, "page").where(touch & (F.col("a_pos") < F.col("b_pos")))
