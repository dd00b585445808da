"""Pages: analysis, cover sheets, titles in running text, row validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed
from ..rules.build import let
from .text import strip

_STOP = "(?:" + "|".join(fixed.TITLE_TERMINATORS) + ")"


def page_analysis(text: Column, images: Column) -> Column:
    """(has_text, is_scanned, text_length, recommendation) of a page's text and its images (width, height)."""
    n = F.length(strip(F.coalesce(text, F.lit(""))))
    large = F.coalesce(F.exists(images, lambda i: (i["width"] > 1000) & (i["height"] > 1000)), F.lit(False))
    return F.struct((n > 0).alias("has_text"), ((n < 50) & large).alias("is_scanned"), n.alias("text_length"), F.when(n >= 50, "vector").otherwise("ocr").alias("recommendation"))


def is_cover(text: Column, page: Column) -> Column:
    """Whether a page is a cover sheet: never with a sheet label; by its words, or on page 1 by an index."""
    t = F.upper(F.coalesce(text, F.lit("")))
    has = lambda words: t.rlike("|".join(words))
    return ~has(fixed.COVER_LABELS) & (has(fixed.COVER_WORDS) | ((page == 1) & has(["DRAWING INDEX", "SHEET INDEX"])))


def python_title(x: Column) -> Column:
    """A capital after anything that isn't a letter, the rest lower: KRISER'S 1ST is Kriser'S 1St."""
    letters = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def multipart_title(raw: Column) -> Column:
    """Lines that aren't labels, joined by commas in title case, cut at the last comma within 100 characters; null if none."""
    label = "|".join(fixed.TITLE_PART_LABELS)

    def joined(r: Column) -> Column:
        kept = F.filter(F.transform(F.split(r, "\n"), strip), lambda p: (F.length(p) >= 2) & ~F.upper(p).rlike(label))
        t = F.regexp_replace(F.array_join(kept, ", "), r"\s+", " ")
        t = F.regexp_replace(F.regexp_replace(t, r",\s*,", ","), r"\s*,\s*", ", ")
        return python_title(F.regexp_replace(t, r"^[ ,]+|[ ,]+$", ""))

    def cut(t: Column) -> Column:
        return F.nullif(F.when(F.length(t) > 100, strip(F.regexp_replace(F.substring(t, 1, 100), r",[^,]*$", ""))).otherwise(t), F.lit(""))

    return let(raw, lambda r: F.when(r.isNotNull(), let(joined(r), cut)))


def title_from_text(text: Column, strict: bool = False) -> Column:
    """A title by label, by keyword in order, or below an address; null for a field label.

    Keywords are tried in their order, not by place in the text. In strict
    mode, for text read from images, only the keyword itself is taken.
    """
    good = lambda x: let(x, lambda y: F.when(F.length(y) >= 3, y))

    def by_keyword(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(fixed.TITLE_KEYWORD_ORDER):
            # the text after a keyword runs to the end: the terminators end there too
            whole = f"(?s)\\b({p})\\b" if strict else f"(?s)\\b({p})(.*)"
            found = F.concat_ws("\n", strip(F.regexp_extract(t, whole, 1)), *([] if strict else [F.nullif(strip(F.regexp_extract(t, whole, 2)), F.lit(""))]))
            out = F.when(t.rlike(f"\\b(?:{p})\\b" if strict else f"\\b(?:{p})"), found).otherwise(out)
        return out

    def tried(t: Column) -> Column:
        all_ = [good(multipart_title(F.nullif(F.regexp_extract(t, f"(?s){p}(.+?){_STOP}", 1), F.lit("")))) for p in fixed.TITLE_TEXT_LABELS]
        all_.append(good(multipart_title(by_keyword(t))))
        all_.append(good(multipart_title(F.nullif(F.regexp_extract(t, rf"(?s)(?:IL|ILLINOIS)\s+\d{{5}}\s*\n+(.*?){_STOP}", 1), F.lit("")))))
        return F.coalesce(*all_)

    def unlabelled(found: Column) -> Column:
        if strict:
            for word in ("Rcp", "Hvac", "Mep", "Ada"):
                found = F.regexp_replace(found, rf"\b{word}\b", word.upper())
        return F.when(~F.upper(strip(found)).isin(fixed.TITLE_LABELS), found)

    return let(F.upper(F.regexp_replace(strip(text), r"[ \t]+", " ")), lambda t: F.when(t.isNotNull(), let(tried(t), unlabelled)))


def row_errors(number: Column, project: Column, title: Column) -> Column:
    """Errors of a row: a number without a letter first, a project number with few digits, both equal, no title."""
    n, p = F.nullif(number, F.lit("")), F.nullif(project, F.lit(""))
    bare, digits = F.length(F.regexp_replace(p, "[-. ]", "")), F.length(F.regexp_replace(p, "[^0-9]", ""))
    return F.array_compact(F.array(
        F.when(~n.rlike(r"^\p{L}"), "sheet_number must start with a letter"), F.when((bare == 0) | (digits < 0.7 * bare), "project_number must be primarily numeric"),
        F.when(n == p, "sheet_number and project_number are identical"), F.when(F.coalesce(strip(title), F.lit("")) == "", "sheet_title is missing"),
    ))


def row_warnings(number: Column, project: Column, date: Column) -> Column:
    n, p, d = (F.nullif(x, F.lit("")) for x in (number, project, date))
    return F.array_compact(F.array(
        F.when(n.isNull(), "sheet_number is missing").when(n.rlike(r"^\p{L}") & ~F.upper(n).rlike("^" + fixed.FIELD_PATTERNS["sheet_number"]), "sheet_number doesn't match expected pattern"),
        F.when(p.isNull(), "project_number is missing").when(F.length(F.regexp_replace(p, "[^0-9]", "")) < 4, "project_number is shorter than typical"),
        F.when(~d.rlike("^" + fixed.FIELD_PATTERNS["date"]), "date doesn't match expected format"),
    ))


def contamination(number: Column, project: Column) -> Column:
    """Issues of fields that may have been mixed up."""
    n, p = F.coalesce(number, F.lit("")), F.coalesce(project, F.lit(""))
    return F.array_compact(F.array(F.when(n.rlike(r"^\d"), "starts_with_digit"), F.when(p.rlike(r"^\p{L}"), "starts_with_letter"), F.when((n != "") & (n == p), "identical_values")))


def sample_pages(total: Column) -> Column:
    """Pages to sample, evenly spread, page 1 first: all of three or fewer, else three to six."""
    more = F.when(total <= 10, 2).when(total <= 30, 3).when(total <= 100, 4).otherwise(5)
    step = F.greatest(F.lit(1), F.floor((total - 1) / (more + 1)).cast("int"))
    spread = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), more), lambda i: (1 + i * step).cast("int")), lambda x: x <= total))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= 3, F.sequence(F.lit(1), total.cast("int"))).otherwise(spread)


def detection_pages(total: Column) -> Column:
    """Pages, counted from 0, to find a border on."""
    pick = F.when(total > 5, F.array(F.lit(1), F.lit(3), F.lit(5))).when(total >= 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    return F.filter(pick, lambda i: i < total)


def every_nth(page: Column, n: int, most: int | None = None) -> Column:
    """Whether a page, counted from 1, is one of every ``n``, the first of them first, ``most`` at most."""
    hit = F.pmod(page - 1, F.lit(n)) == 0
    return hit if most is None else hit & ((page - 1) / n < most)
