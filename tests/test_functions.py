"""Expressions on literals, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import geometry, numbers, scores, text, titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("number, want", [("A101", ("A", 1, 1, True)), ("A-201", ("A", 2, 1, True)), ("I-221", ("I", 2, 21, True)), ("A1.01", ("A", 1, 1, True)), ("A-1", ("A", -1, 0, False))])
def test_parsed(spark, number, want):
    p = one(spark, numbers.parsed(F.lit(number)))
    assert (p.discipline, p.sheet_type, p.sequence, p.is_valid) == want


def test_parsed_nothing(spark):
    assert one(spark, numbers.parsed(F.lit(None).cast("string"))) is None
    assert one(spark, numbers.parsed(F.lit("1A"))) is None


@pytest.mark.parametrize("text_, want", [
    ("Some text\nSHEET NO: A1.1\nMore text", "A1.1"), ("DWG NO: E1.1", "E1.1"), ("SHEET NO: A-1.1", "A-1.1"), ("ANSI Z97.1 requirements\nA002", "A002"), ("", None), ("plain prose", None),
])
def test_number_from_text(spark, text_, want):
    assert one(spark, numbers.number_from_text(F.lit(text_))) == want


def test_variants(spark):
    assert one(spark, numbers.variants(F.lit("A10"))) == ["A10", "A1.0", "A-10"]


@pytest.mark.parametrize("title, ok, reason", [
    (None, False, "empty_title"), ("ab", False, "too_short:2"), ("Smith LLC", False, "garbage_pattern:bLLCb|bINCb|bCORPb|bLTD"), ("PLAN", False, "single_keyword:PLAN"),
    ("Elevations", True, "valid_single_word:ELEVATIONS"), ("Floor Plan", True, "keyword_with_context:2_words"), ("Lower Lobby", True, "multi_word:2_words"), ("Lobby", False, "insufficient_context"),
])
def test_quality_gate(spark, title, ok, reason):
    g = one(spark, titles.quality_gate(F.lit(title).cast("string")))
    assert (g.ok, g.reason) == (ok, reason)


@pytest.mark.parametrize("title, reason", [("Section", "single_keyword"), ("Random Text Here", "no_keyword_or_context"), ("Building Section", "keyword_with_context"), (None, "empty")])
def test_learning_gate(spark, title, reason):
    assert one(spark, titles.learning_gate(F.lit(title).cast("string"))).reason == reason


@pytest.mark.parametrize("title, want", [("FLOOR PLAN", "Floor Plan"), ("ADA COMPLIANCE NOTES", "ADA Compliance Notes"), ("PLAN OF THE ROOF", "Plan of the Roof"), ("Mixed CASE", "Mixed CASE")])
def test_title_case(spark, title, want):
    assert one(spark, text.title_case(F.lit(title))) == want


@pytest.mark.parametrize("title, want", [
    ("FLOOR PLAN AND REFLECTED CEILING PLAN", ["FLOOR PLAN", "REFLECTED CEILING PLAN"]), ("FLOOR PLAN - LEVEL 1", ["FLOOR PLAN - LEVEL 1"]), ("FLOOR PLAN\nROOF PLAN", ["FLOOR PLAN", "ROOF PLAN"]), ("", []),
])
def test_components(spark, title, want):
    assert one(spark, titles.title_components(F.lit(title))) == want


def test_span_score(spark):
    block = geometry.box(0, 0, 612, 792)
    assert one(spark, scores.span_score(F.lit("FLOOR PLAN"), geometry.box(200, 300, 400, 330), F.lit(24.0), block)) == 100
    assert one(spark, scores.span_score(F.lit("PROJECT:"), geometry.box(0, 700, 100, 720), F.lit(12.0), block)) == 0


def test_boxes(spark):
    a, b = geometry.box(0, 0, 10, 10), geometry.box(10, 10, 20, 20)
    assert one(spark, geometry.overlaps(a, b)) is True
    assert one(spark, geometry.intersection(a, b)) is None
    assert one(spark, geometry.area(geometry.intersection(geometry.box(5, 5, 15, 15), a))) == 25


@pytest.mark.parametrize("x, y, want", [("Floor Plan", "floor plan", True), ("Plan", "Floor Plan", True), ("", "", True), ("", "Plan", False), ("Roof", "Plan", False)])
def test_same_title(spark, x, y, want):
    assert one(spark, text.same_title(F.lit(x), F.lit(y))) is want


def test_consensus(spark):
    n = F.lit(None).cast("double")
    assert one(spark, scores.consensus(n, n, n)).x1 == 0.88
    assert one(spark, scores.consensus(F.lit(0.8), F.lit(0.95), F.lit(0.9))).method == "hough_lines_preferred"
