"""Scores, confidences and priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed
from .geometry import vertical_zone
from .text import has_title_keyword, strip


def span_score(text: Column, b: Column, font_size: Column, block: Column) -> Column:
    """How well a span of a title block fits a title; 0 for labels and small fonts."""
    t = F.upper(strip(text))
    zone = vertical_zone((b["y0"] + b["y1"]) / 2, block)
    n = F.length(text)
    centred = F.abs((b["x0"] + b["x1"]) / 2 - (block["x0"] + block["x1"]) / 2) < (block["x1"] - block["x0"]) * 0.2
    font = F.when(font_size > 12, F.least(F.floor((font_size - 12) / 2) * 10, F.lit(50))).otherwise(0)
    score = (
        F.when(zone == "title", 20).when(zone == "header", 5).otherwise(-10)
        + font
        + F.when(has_title_keyword(text, plural=False), 15).otherwise(0)
        + F.when((zone == "title") & centred, 10).otherwise(0)
        + F.when(n.between(10, 30), 5).when(n > 35, -10).when(n < 5, -5).otherwise(0)
    )
    return F.when(is_label(t) | (font_size < 8), 0).otherwise(score).cast("int")


def is_label(upper_text: Column) -> Column:
    """Whether an upper-case text is a field label, or begins with one and a colon."""
    return upper_text.isin(fixed.TITLE_LABELS) | F.rtrim(upper_text, F.lit(":")).isin(fixed.TITLE_LABELS) | upper_text.rlike("^(?:" + "|".join(x.replace("#", "\\#") for x in fixed.TITLE_LABELS) + r")\s*:")


def page_confidence(number: Column, project: Column, is_valid: Column) -> Column:
    """high with number and project on a valid row, medium with both, else low."""
    both = F.coalesce(number != "", F.lit(False)) & F.coalesce(project != "", F.lit(False))
    return F.when(both & is_valid, "high").when(both, "medium").otherwise("low")


def histogram_bucket(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.9, "0.9+").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("<0.5")


def review_priority(is_combo: Column, confidence: Column, has_conflict: Column, categories: Column) -> Column:
    """0, 1 or 2: 2 for low confidence or conflict, 1 for several drawings or no category."""
    return F.greatest(
        F.when(is_combo, 1).otherwise(0), F.when(confidence < 0.50, 2).otherwise(0), F.when(has_conflict, 2).otherwise(0), F.when(F.size(categories) == 0, 1).otherwise(0)
    )


def review_reason(conflict: Column, confidence: Column, title: Column, method: Column) -> Column:
    """Why a row is to be reviewed, the first that holds."""
    return (
        F.when(conflict, "Index conflict").when(F.coalesce(confidence, F.lit(0.0)) < fixed.REVIEW_THRESHOLD, "Low confidence")
        .when(F.coalesce(F.trim(title), F.lit("")) == "", "No title found").when(method == "pattern", "Pattern extraction").otherwise("Manual review")
    )


def triggers(confidence: Column, is_combo: Column, has_conflict: Column, title: Column, categories: Column) -> Column:
    """(analyze, reasons, priority): whether a page's content should be looked at."""
    from ..rules.build import matches_any

    low, vague, none = confidence < fixed.TRIGGER_CONFIDENCE, F.coalesce(matches_any(title, fixed.AMBIGUOUS_TITLES), F.lit(False)), F.size(categories) == 0
    named = [(low, "Low confidence", 2), (is_combo, "Combo page", 1), (has_conflict, "Conflicting signals", 2), (vague, "Ambiguous title", 1), (none, "No categories", 2)]
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, r, _ in named]))
    return F.struct((F.size(reasons) > 0).alias("analyze"), reasons.alias("reasons"), F.greatest(*[F.when(c, p).otherwise(0) for c, _, p in named]).alias("priority"))


def spread_confidence(spread: Column) -> Column:
    return F.when(spread < 0.02, 0.95).when(spread < 0.05, 0.80).when(spread < 0.10, 0.60).otherwise(0.40)


def consensus(cv: Column, majority: Column, hough: Column, strategy: str = "median") -> Column:
    """(x1, method, spread, confidence, n) from up to three estimates of a border.

    Estimates far apart defer to the line detector, or to the greatest; else
    those near the median are combined by the strategy.
    """
    all_ = F.array_compact(F.array(cv, majority, hough))
    n, raw = F.size(all_), F.array_max(all_) - F.array_min(all_)
    middle = lambda a: (F.get(F.sort_array(a), ((F.size(a) - 1) / 2).cast("int")) + F.get(F.sort_array(a), (F.size(a) / 2).cast("int"))) / 2
    near = F.filter(all_, lambda e: F.abs(e - middle(all_)) < 0.10)
    kept = F.when(F.size(near) > 0, near).otherwise(all_)
    picked = {"median": middle(kept), "conservative": F.array_max(kept), "aggressive": F.array_min(kept)}[strategy]
    spread = F.array_max(kept) - F.array_min(kept)
    out = lambda x, m, s, c: F.struct(x.cast("double").alias("x1"), m.alias("method"), s.cast("double").alias("spread"), c.cast("double").alias("confidence"), n.alias("n"))
    single = F.when(cv.isNotNull(), "cv_transition").when(majority.isNotNull(), "cv_majority").otherwise("hough_lines")
    return (
        F.when(n == 0, out(F.lit(0.88), F.lit("computed_fallback_all_failed"), F.lit(0.0), F.lit(0.3)))
        .when(n == 1, out(F.get(all_, F.lit(0)), single, F.lit(0.0), F.lit(0.5)))
        .when((raw > 0.10) & hough.isNotNull(), out(hough, F.lit("hough_lines_preferred"), raw, spread_confidence(raw)))
        .when(raw > 0.10, out(F.array_max(all_), F.lit("consensus_conservative_high_spread"), raw, spread_confidence(raw)))
        .otherwise(out(picked, F.lit(f"consensus_{strategy}"), spread, spread_confidence(spread)))
    )


def final_border(coarse: Column, coarse_confidence: Column, coarse_method: Column, refined: Column, refined_confidence: Column, strategy: str = "balanced") -> Column:
    """(x1, width, method, confidence) of a border from a coarse and a refined estimate; null estimates are missing ones.

    A coarse estimate of 0.95 or more, and the strategy coarse_only, need no
    refinement. Without any estimate the border stands at 0.85, confidence 0.
    """
    least, most = F.least(coarse, refined), F.greatest(coarse, refined)
    x = {"balanced": least, "conservative": most, "aggressive": least, "include_all": coarse}.get(strategy, coarse)
    use = coarse.isNotNull() & refined.isNotNull() & (F.coalesce(coarse_confidence, F.lit(0.0)) < 0.95) if strategy != "coarse_only" else F.lit(False)
    wanted = F.coalesce(coarse_confidence, F.lit(0.0)) < 0.95 if strategy != "coarse_only" else F.lit(False)
    both = (F.coalesce(coarse_confidence, F.lit(0.5)) + F.coalesce(refined_confidence, F.lit(0.5))) / 2 if strategy in ("conservative", "aggressive") else F.lit(0.5)
    out = lambda x1, method, c: F.struct(x1.cast("double").alias("x1"), (1 - x1).cast("double").alias("width"), method.alias("method"), c.cast("double").alias("confidence"))
    return (
        F.when(coarse.isNull(), out(F.lit(0.85), F.lit("no_images"), F.lit(0.0)))
        .when(use, out(x, F.lit(strategy), both))
        .when(wanted, out(coarse, F.lit("coarse_fallback"), F.lit(0.5)))
        .otherwise(out(coarse, coarse_method, F.when(coarse_method == "coarse", F.coalesce(coarse_confidence, F.lit(0.7))).otherwise(0.5)))
    )


def global_x(crop_start: Column, crop_width: Column, x: Column, page_width: Column) -> Column:
    """A fraction of a crop's width as a fraction of the page's."""
    return (crop_start + x * crop_width) / page_width
