"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed
from ..rules.build import any_of


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def collapse_blanks(x: Column) -> Column:
    """Runs of blanks and tabs as one blank; line ends stay."""
    return F.regexp_replace(x, r"[ \t]+", " ")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def without_index(x: Column) -> Column:
    """Without drawing-index sections, each up to a blank line or the end."""
    return F.regexp_replace(x, r"(?is)(?:DRAWING|SHEET) INDEX:.*?(?=\n\n|\z)", "")


def repair_zero(x: Column) -> Column:
    """The letter O that is all after a decimal point as a zero: A1.O is A1.0, A1.OFFICE stays."""
    return F.regexp_replace(x, r"(?<=\d\.)[Oo]\b", "0")


def truncated(x: Column, most: int = fixed.TITLE_MAX) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def capitalized(word: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def title_case(x: Column) -> Column:
    """All-capital titles in title case, acronyms kept; other titles as they are."""
    shouting = (F.upper(x) == x) & (F.lower(x) != x)
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    made = F.transform(
        words,
        lambda w, i: F.when(F.upper(w).isin(fixed.TITLE_ACRONYMS), F.upper(w))
        .when((i > 0) & F.lower(w).isin(fixed.SMALL_WORDS), F.lower(w))
        .otherwise(capitalized(w)),
    )
    return F.when(shouting, F.array_join(made, " ")).otherwise(x)


def comparable(x: Column) -> Column:
    """Upper case and trimmed; null as empty."""
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def same_title(a: Column, b: Column) -> Column:
    """Equal, or one that isn't empty is part of the other."""
    x, y = comparable(a), comparable(b)
    return (x == y) | ((F.length(x) > 0) & (F.length(y) > 0) & (F.contains(y, x) | F.contains(x, y)))


def safe_filename(x: Column, most: int) -> Column:
    """Unsafe characters as underscores, runs of them as one, none at the ends."""
    clean = F.regexp_replace(F.coalesce(x, F.lit("untitled")), r'[<>:"/\\|?*\x00-\x1f\s]+', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(clean, 1, most), "_+$", ""), F.lit("")), F.lit("untitled"))


def normal_filename(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def normal_project(x: Column) -> Column:
    """Upper case, ``+`` as ``&``, one pass over double blanks, no closing punctuation."""
    return F.regexp_replace(F.replace(F.replace(F.upper(F.trim(x)), F.lit("+"), F.lit("&")), F.lit("  "), F.lit(" ")), "[.,;:]+$", "")


def first_field(x: Column, field: str) -> Column:
    """The first match of a field's pattern; null if none."""
    return F.nullif(F.regexp_extract(x, fixed.FIELD_PATTERNS[field], 0), F.lit(""))


def all_fields(x: Column, field: str) -> Column:
    return F.regexp_extract_all(x, F.lit(fixed.FIELD_PATTERNS[field]), F.lit(0))


def quoted(x: Column) -> Column:
    """The text as a pattern that matches it literally."""
    return F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1")


def has_title_keyword(x: Column, plural: bool = True) -> Column:
    """A title keyword as a whole word, with an S for plurals if asked for."""
    return F.upper(x).rlike(r"\b(?:" + "|".join(fixed.VALID_TITLE_KEYWORDS) + (")S?" if plural else ")") + r"\b")


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def any_pattern(x: Column, patterns: list[str]) -> Column:
    return x.rlike(any_of(patterns))


def first_json(x: Column) -> Column:
    """The first braced block of a model's reply."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def clean_title(x: Column, least: int = 0) -> Column:
    """Without blanks, hyphens and colons at the ends, white space as one blank; null for a bare label or below ``least`` characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[\s\-:]+", ""), r"[\s\-:]+$", ""), r"\s+", " "))
    return F.when((t != "") & (F.length(t) >= least) & ~F.upper(t).isin(fixed.BARE_TITLE_LABELS), t)


def preview(x: Column, most: int = 50) -> Column:
    """The first characters of a text."""
    return F.substring(x, 1, most)


def contains_keyword(x: Column, keywords: list[str]) -> Column:
    """Whether a keyword stands anywhere in the text, also within a word, whatever the case."""
    up = F.upper(x)
    return F.coalesce(F.exists(F.lit(keywords), lambda k: F.contains(up, k)), F.lit(False))


def stamped_name(prefix: str, at: Column, suffix: str) -> Column:
    """A file name with a time in it."""
    return F.concat(F.lit(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))
