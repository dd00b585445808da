"""Titles: quality gates, validation and scores, combined titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed
from ..rules.build import any_of, matches_any
from .text import collapse_blanks, has_title_keyword, strip, title_case, truncated, word_count


def garbage_name(title: Column, whole: bool = False) -> Column:
    """The first garbage pattern that a title matches, by its opening 30 characters or whole; null if none."""
    out = F.lit(None).cast("string")
    for pattern, ignore_case in reversed(fixed.TITLE_GARBAGE):
        name = pattern if whole else pattern[:30].replace("\\", "")
        out = F.when(title.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(name)).otherwise(out)
    return out


def is_garbage(title: Column) -> Column:
    """Whether any garbage pattern matches, by two alternations."""
    loose = [p for p, i in fixed.TITLE_GARBAGE if i]
    strict = [p for p, i in fixed.TITLE_GARBAGE if not i]
    return title.rlike(any_of(loose)) | title.rlike(any_of(strict, ignore_case=False))


def quality_gate(title: Column, project_number: Column | None = None) -> Column:
    """(ok, reason) of a title by ten ordered rules."""
    t, project = strip(title), F.lit(None).cast("string") if project_number is None else project_number
    upper, n, words, keyword = F.upper(t), F.length(t), word_count(t), has_title_keyword(t)
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    no = lambda r: F.struct(F.lit(False).alias("ok"), r.alias("reason"))
    yes = lambda r: F.struct(F.lit(True).alias("ok"), r.alias("reason"))
    return (
        F.when(title.isNull() | (title == ""), no(F.lit("empty_title")))
        .when(n < 3, no(text("too_short:", n)))
        .when(F.coalesce((project != "") & (t == project), F.lit(False)), no(F.lit("matches_project_number")))
        .when(is_garbage(t), no(text("garbage_pattern:", garbage_name(t))))
        .when(upper.isin(fixed.SINGLE_KEYWORD_REJECTS), no(text("single_keyword:", upper)))
        .when(upper.isin(fixed.VALID_SINGLE_WORDS), yes(text("valid_single_word:", upper)))
        .when(keyword & (words >= 2), yes(text("keyword_with_context:", words, "_words")))
        .when(keyword & (n >= 15), yes(text("keyword_long:", n, "_chars")))
        .when(keyword & (words == 1), yes(text("single_keyword_valid:", upper)))
        .when((words >= 2) & (n >= 8), yes(text("multi_word:", words, "_words")))
        .otherwise(no(F.lit("insufficient_context")))
    )


def learning_gate(title: Column) -> Column:
    """(ok, reason) of a title as a sample to learn from; keywords count as parts of words."""
    t = strip(title)
    upper, words = F.upper(t), word_count(t)
    keyword = upper.rlike("|".join(fixed.QUALITY_KEYWORDS))
    reason = (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(F.length(t) < fixed.LEARN_MIN_LENGTH, "too_short")
        .when(matches_any(t, fixed.GARBAGE_PATTERNS), "garbage_pattern")
        .when((words == 1) & upper.isin(fixed.QUALITY_KEYWORDS), "single_keyword")
        .when(keyword & (words >= fixed.LEARN_MIN_WORDS), "keyword_with_context")
        .when(keyword & (F.length(t) >= fixed.LEARN_ONE_WORD), "keyword_long_enough")
        .otherwise("no_keyword_or_context")
    )
    return F.struct(reason.isin("keyword_with_context", "keyword_long_enough").alias("ok"), reason.alias("reason"))


def validated_title(title: Column, method: Column, project_number: Column | None = None) -> Column:
    """(is_valid, title, confidence, needs_review, reason) of an extracted title."""
    t, project = strip(title), F.lit(None).cast("string") if project_number is None else project_number
    cut = truncated(t)
    made = title_case(cut)
    base = F.lit(fixed.METHOD_CONFIDENCE["pattern"])
    for name, score in fixed.METHOD_CONFIDENCE.items():
        base = F.when(F.lower(method) == name, F.lit(score)).otherwise(base)
    keyword = has_title_keyword(made)
    score = base + F.when(keyword, 0.05).otherwise(0.0)
    score = score + F.when(F.length(cut) > fixed.TITLE_SOFT_MAX, -0.10).otherwise(0.0)
    score = score + F.when((F.length(cut) < 15) & ~keyword, -0.05).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    out = lambda ok, title_, s, review, why: F.struct(
        F.lit(ok).alias("is_valid"), title_.cast("string").alias("title"), s.cast("double").alias("confidence"), review.alias("needs_review"), why.cast("string").alias("reason")
    )
    no = lambda why: out(False, F.lit(None), F.lit(0.0), F.lit(True), why)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", no(F.lit("Empty or missing title")))
        .when(F.coalesce((project != "") & (t == project), F.lit(False)), no(F.lit("Title matches project number (contamination)")))
        .when(F.length(t) < fixed.TITLE_MIN, no(F.concat(F.lit("Title too short ("), F.length(t).cast("string"), F.lit(" chars, min 3)"))))
        .when(is_garbage(cut), no(F.concat(F.lit("Matches garbage pattern: "), garbage_name(cut, whole=True))))
        .otherwise(out(True, made, score, score < fixed.REVIEW_THRESHOLD, F.lit(None)))
    )


_SEPARATOR = "(?i)(?:" + "|".join(fixed.COMBO_SEPARATORS) + ")"


def drawing_type(text: Column) -> Column:
    """The first of nine drawing types that a title shows; null if none."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(list(fixed.DRAWING_TYPES.items())):
        out = F.when(text.rlike(any_of(patterns)), F.lit(name)).otherwise(out)
    return out


def _parts(clean: Column) -> Column:
    """Parts between separators, without blank ones and ones that are a separator word."""
    # a separator matched by the pattern is not a part, but a blank one is dropped like it
    return F.filter(F.split(clean, _SEPARATOR), lambda p: (strip(p) != "") & ~F.upper(strip(p)).isin("AND", "&", "/", "-", "--"))


def title_components(title: Column) -> Column:
    """The drawings that a title names: its parts if it names several, else the title.

    Several parts count as drawings if they show two drawing types, or if two
    have five characters or more and nothing in the title says that the
    separator belongs to one name. Empty for no title.
    """
    clean = collapse_blanks(strip(title))
    parts = _parts(clean)
    types = F.array_distinct(F.array_compact(F.transform(parts, lambda p: drawing_type(p))))
    several = clean.rlike(_SEPARATOR) & (F.size(parts) >= 2) & (
        (F.size(types) >= 2)
        | ((F.size(F.filter(parts, lambda p: F.length(strip(p)) >= 5)) >= 2) & ~matches_any(F.array_join(parts, " "), fixed.NOT_COMBO))
    )
    split = F.filter(F.transform(parts, strip), lambda p: F.length(p) >= 3)
    whole = F.array(clean)
    return (
        F.when(title.isNull() | (title == ""), F.array().cast("array<string>"))
        .when(several & (F.size(split) > 1), split)
        .otherwise(whole)
    )
