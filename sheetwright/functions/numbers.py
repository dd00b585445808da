"""Sheet numbers: parsing, relevance, hints, validity, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed
from ..rules.build import any_of, let, lookup
from .text import quoted, strip, without_index

_STANDARD = r"^([A-Z]{1,2})[-.]?(\d)(\d{1,3})(?:\.(\d{1,2}))?$"
_DECIMAL = r"^([A-Z]{1,2})[-.]?(\d)\.(\d{1,2})$"


def relevance_of(discipline: Column, sheet_type: Column) -> Column:
    """Relevance by discipline and type, else by discipline, else REFERENCE."""
    exact = {f"{d}{t}": level for (d, t), level in fixed.NCS_RELEVANCE.items() if t is not None}
    by_discipline = {d: level for (d, t), level in fixed.NCS_RELEVANCE.items() if t is None}
    return F.coalesce(lookup(F.concat(discipline, sheet_type.cast("string")), exact), lookup(discipline, by_discipline), F.lit("REFERENCE"))


def parsed(number: Column) -> Column:
    """Discipline, type, sequence, sub-sequence, validity and relevance of a number.

    Null for an empty number and one that doesn't begin with a letter. A
    number that begins with a letter but fits no standard form keeps its
    discipline, with type -1.
    """
    n = F.upper(strip(number))
    groups = lambda p, i: F.nullif(F.regexp_extract(n, p, i), F.lit(""))
    standard = n.rlike(_STANDARD)
    valid = standard | n.rlike(_DECIMAL)
    letter = F.substring(n, 1, 1)
    kind = F.when(standard, groups(_STANDARD, 2)).when(valid, groups(_DECIMAL, 2)).cast("int")
    kind = F.coalesce(kind, F.lit(-1))
    loose = (
        F.when(letter.isin(list("SMEPCLFTQ")), "IRRELEVANT").when(letter.isin("A", "I"), "SECONDARY").otherwise("REFERENCE")
    )
    return F.when(
        n.rlike(r"^\p{L}"),
        F.struct(
            letter.alias("discipline"),
            lookup(letter, fixed.DISCIPLINE_NAMES, "Unknown").alias("discipline_name"),
            kind.alias("sheet_type"),
            lookup(kind, fixed.SHEET_TYPE_NAMES, "Unknown").alias("sheet_type_name"),
            F.coalesce(F.when(standard, groups(_STANDARD, 3)).when(valid, groups(_DECIMAL, 3)).cast("int"), F.lit(0)).alias("sequence"),
            F.when(standard, groups(_STANDARD, 4)).cast("int").alias("sub_sequence"),
            valid.alias("is_valid"),
            F.when(valid, relevance_of(letter, kind)).otherwise(loose).alias("relevance"),
        ),
    )


def category_hint(p: Column) -> Column:
    """The category that a parsed number suggests; null if not valid or none."""
    design = p["discipline"].isin("A", "I")
    hint = (
        F.when(design & (p["sheet_type"] == 1), "floor_plans")
        .when(design & (p["sheet_type"] == 2), "elevations")
        .when(design & (p["sheet_type"] == 6), "room_finish_schedules")
        .when(design & (p["sheet_type"] == 0), "cover_sheets")
        .when(p["discipline"].isin(list("SMEPCL")), fixed.NOT_NEEDED)
    )
    return F.when(p["is_valid"], hint)


def number_check(number: Column) -> Column:
    """(ok, reason) of a sheet number by seven ordered rules."""
    n = F.upper(strip(number))
    bare = F.replace(n, F.lit("."), F.lit(""))
    reason = (
        F.when(number.isNull() | (number == ""), "empty_or_none")
        .when(F.length(n) < 2, F.concat(F.lit("too_short:"), F.length(n).cast("string")))
        .when(F.length(n) > 10, F.concat(F.lit("too_long:"), F.length(n).cast("string")))
        .when(~n.rlike(r"^\p{L}"), "no_letter_prefix")
        .when(~n.rlike(r"\d"), "no_digits")
        .when(n.isin(fixed.NUMBER_BLACKLIST), F.concat(F.lit("blacklisted:"), n))
        .when(bare.isin(fixed.NUMBER_BLACKLIST), F.concat(F.lit("blacklisted:"), bare))
        .when(~n.rlike(fixed.STRICT_NUMBER), "pattern_mismatch")
        .otherwise("valid")
    )
    return F.struct((reason == "valid").alias("ok"), reason.alias("reason"))


def candidate_shape(number: Column) -> Column:
    """Two to eight characters, a letter first, one to three digits in all."""
    digits = F.length(F.regexp_replace(number, r"[^0-9]", ""))
    return F.length(number).between(2, 8) & number.rlike(r"^[A-Z]") & digits.between(1, 3)


def variants(number: Column) -> Column:
    """Spellings to look a number up by, in order: without separators, with a decimal point after one or two digits, with a hyphen."""
    plain = r"^([A-Z]{1,2})(\d)(\d+)$"
    one = F.when(number.rlike(plain), F.regexp_replace(number, plain, "$1$2.$3"))
    longer = r"^([A-Z]{1,2})(\d\d)(\d+)$"
    two = F.when(number.rlike(longer), F.regexp_replace(number, longer, "$1$2.$3"))
    lead = r"^([A-Z]{1,2})(\d.*)$"
    hyphen = F.when(number.rlike(lead), F.regexp_replace(number, lead, "$1-$2"))
    return F.array_compact(F.array(F.regexp_replace(number, r"[-.]", ""), one, two, hyphen))


def discipline_of(number: Column) -> Column:
    """Discipline by the first letter; Unknown for others, null for no number."""
    return F.when(number.isNotNull() & (number != ""), lookup(F.upper(F.substring(number, 1, 1)), fixed.DISCIPLINE_CODES, "Unknown"))


def number_from_text(text: Column) -> Column:
    """A sheet number behind a label, below one, or alone on one of the last 40 lines.

    Labels go in order, cut ones last, and may stand a line above: each one's
    first match is tried, the next label only if that isn't a candidate. Then
    comes the first line that ends in a label and has a candidate at the
    start of the next line with text, three lines below at most. Null if
    nothing fits.
    """
    t = F.upper(without_index(F.coalesce(text, F.lit(""))))
    fit = lambda x: F.when(candidate_shape(x), x)
    labelled = [fit(F.regexp_extract(t, label + fixed.NUMBER_VALUE, 1)) for label in fixed.NUMBER_LABELS]
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    line = lambda i: F.nullif(F.get(lines, i), F.lit(""))
    under = F.transform(lines, lambda x, i: F.when(x.rlike(any_of(fixed.NUMBER_LINE_ENDS, ignore_case=False)), fit(F.regexp_extract(F.coalesce(line(i + 1), line(i + 2), line(i + 3)), "^" + fixed.NUMBER_VALUE, 1))))
    below = F.get(F.array_compact(under), F.lit(0))
    last = F.slice(lines, F.greatest(F.size(lines) - 39, F.lit(1)), F.lit(40))
    alone = F.get(F.filter(F.reverse(last), lambda x: x.rlike(f"^{fixed.NUMBER_VALUE}$") & candidate_shape(x)), F.lit(0))
    return F.coalesce(*labelled, below, alone)


def title_sheet_number(text: Column) -> Column:
    """The first number of a title sheet anywhere in a text, six characters at most."""
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(fixed.TITLE_SHEET_NUMBER), F.lit(1))
    return F.get(F.filter(found, lambda x: F.length(x) <= 6), F.lit(0))


def false_project(value: Column, text: Column) -> Column:
    """Whether a project number is part of a date, a year, or a street, phone or postal number of its text."""
    v, up = strip(value), F.upper(text)
    q = quoted(v)
    seen = lambda where, *parts: F.rlike(where, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    street = seen(up, q, r"\s+(?:" + "|".join(fixed.STREETS) + ")") | seen(up, q, fixed.STREET_ADDRESS)
    phone = seen(text, r"\d{3}[-.\s]\d{3}[-.\s]", q) | seen(text, q, r"[-.\s]\d{3}[-.\s]\d{4}") | seen(text, r"\d{3}[-.\s]", q, r"[-.\s]\d{4}")
    postal = v.rlike(r"^\d{5}$") & seen(up, r"[A-Z]{2}\s+", q)
    return F.coalesce(seen(text, r"\d{1,2}[/-]\d{1,2}[/-]", q) | v.isin(fixed.YEARS) | street | phone | postal, F.lit(False))


def repaired_candidate(text: Column) -> Column:
    """A number read letter by letter: the prefix stays, O and Q after it are zeros, I and l ones; then the number within, else what there is."""
    two, one = F.substring(text, 1, 2), F.substring(text, 1, 1)
    prefix = F.when((F.length(text) >= 2) & two.isin([p for p in fixed.NUMBER_PREFIXES if len(p) == 2]), two).otherwise(one)

    def number_in(made: Column) -> Column:
        return F.coalesce(F.when(made.rlike(f"^{fixed.NUMBER_VALUE}$"), made), F.nullif(F.regexp_extract(made, fixed.NUMBER_VALUE, 1), F.lit("")), made)

    return let(F.concat(prefix, F.translate(F.substring(text, F.length(prefix) + 1, F.length(text)), "OQIl", "0011")), number_in)


def edge_text_ok(text: Column) -> Column:
    """Whether text read from a page's edges shows a sheet number."""
    return F.coalesce(text.rlike(any_of(fixed.EDGE_SIGNS, ignore_case=False)), F.lit(False))
