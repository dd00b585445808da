"""Operators on small fixtures."""

import difflib
import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwright.functions import numbers, text
from sheetwright.operators import classify, index, learn, profiles, store
from sheetwright.sources import readers
from sheetwright.streaming import ingest

GOLDEN = [
    ("G001", "Cover Sheet", "cover_sheets", "REFERENCE", 1.0, "NEEDS_EVALUATION"), ("A101", "First Floor Plan", "floor_plans", "PRIMARY", 1.0, "DEFINITELY_NEEDED"),
    ("A120", "Reflected Ceiling Plan", "reflected_ceiling_plans;floor_plans", "PRIMARY", 1.0, "DEFINITELY_NEEDED"), ("A201", "Exterior Elevations", "exterior_elevations;elevations", "SECONDARY", 1.0, "DEFINITELY_NEEDED"),
    ("S101", "Foundation Plan", "properly_classified_not_needed", "IRRELEVANT", 0.7, "NEEDS_EVALUATION"), ("A101", "FLOOR PLAN\nROOF PLAN", "floor_plans", "PRIMARY", 0.95, "DEFINITELY_NEEDED"),
    ("A101", "FLOOR PLAN AND REFLECTED CEILING PLAN", "floor_plans;reflected_ceiling_plans", "PRIMARY", 0.849065, "NEEDS_EVALUATION"), ("M-1", "Mechanical Plan", "properly_classified_not_needed", "IRRELEVANT", 1.0, "DEFINITELY_NOT_NEEDED"),
    ("X999", "Unknown Drawing", "", "REFERENCE", 0.0, "NEEDS_EVALUATION"), ("A1.0", "Demolition Plan", "demolition_plans;floor_plans", "REFERENCE", 1.0, "NEEDS_EVALUATION"),
    (None, "Finish Plan", "room_finish_schedules;finish_plans", "PRIMARY", 0.85, "NEEDS_EVALUATION"), (None, "", "", "REFERENCE", 0.0, "NEEDS_EVALUATION"), ("T101", "Plan", "", "IRRELEVANT", 0.0, "NEEDS_EVALUATION"),
]


def test_golden_classification(spark):
    rows = spark.createDataFrame([(i, *g[:2]) for i, g in enumerate(GOLDEN)], "i int, sheet_number string, sheet_title string")
    got = {r.i: r for r in classify.classified(rows).collect()}
    for i, (_, _, cats, relevance, confidence, decision) in enumerate(GOLDEN):
        r = got[i]
        assert (";".join(r.categories), r.relevance, round(r.confidence, 6), r.decision) == (cats, relevance, confidence, decision), GOLDEN[i]


def test_index(spark):
    page = "DRAWING INDEX\n\nARCHITECTURAL\nA1.0    FLOOR PLAN\nOF LEVEL ONE\nA2.0    ELEVATIONS\nSTRUCTURAL\nS1.0    FRAMING PLAN"
    got = {r.sheet_number: r.title for r in index.parse_index(spark.createDataFrame([("p", 1, page), ("p", 9, page)], "pdf string, page int, text string")).collect()}
    assert got == {"A1.0": "FLOOR PLAN OF LEVEL ONE", "A2.0": "ELEVATIONS", "S1.0": "FRAMING PLAN"}


def test_lookup(spark):
    keys = spark.createDataFrame([("p", "A1.0", "one", 1), ("p", "D20", "two", 2), ("p", "M1001", "three", 3)], "pdf_filename string, sheet_number string, title string, ord int")
    asked = spark.createDataFrame([("p", "A1.0"), ("p", "A10"), ("p", "M1O01"), ("p", "AM1.0"), ("p", "Z999"), ("p", None)], "pdf_filename string, sheet_number string")
    got = {r.sheet_number: (r.index_title, r.index_step) for r in index.lookup_titles(asked, keys).collect()}
    assert got == {"A1.0": ("one", "exact"), "A10": ("one", "variant"), "M1O01": ("three", "variant"), "AM1.0": ("one", "similar"), "Z999": (None, None), None: (None, None)}


def test_similar_keys_are_those_of_plain_ratios(spark):
    """Numbers of 1 to 14 characters, ties among them, against every key by difflib."""
    r = random.Random(3)
    made = lambda: r.choice("AMSE") + r.choice(["", "-", "."]) + "".join(r.choice("0123") for _ in range(r.randint(0, 6))) + r.choice(["", ".1", ".25", "-OLD", "-REVISED"])
    keys, asked = list(dict.fromkeys(made() for _ in range(150))), {made() for _ in range(150)}
    want = {}
    for a in asked:
        best, title = 0.0, None
        for k in keys:
            q = difflib.SequenceMatcher(None, a, k).ratio()
            if q > best and q >= 0.80:
                best, title = q, f"t{k}"
        if title:
            want[a] = title
    index_ = spark.createDataFrame([("p", k, f"t{k}", i) for i, k in enumerate(keys)], "pdf_filename string, sheet_number string, title string, ord int")
    got = index.similar_keys(spark.createDataFrame([("p", a, a) for a in asked], "pdf_filename string, _n string, _p string"), index_)
    assert {x._n: x.title for x in got.collect()} == want and len(want) > 50


def test_index_in_running_text(spark):
    page = "SHEET INDEX A20 FLOOR PLAN Az2 REFLECTED CEILING PLAN A3.O DETAILS"
    lines = "DRAWING INDEX\nA1.01 - PLAN ONE\nA2.0: ELEVATIONS\nA3\tDETAILS -\nA4 \u2014 ROOF PLAN\nof the barn"
    d = spark.createDataFrame([("q", 2, page), ("p", 1, lines), ("r", 1, "A20 FLOOR PLAN")], "pdf string, page int, text string")
    got = {(x.pdf, x.sheet_number): x.title for x in index.parse_index(d).collect()}
    assert got == {("q", "A20"): "FLOOR PLAN", ("q", "A2.2"): "REFLECTED CEILING PLAN", ("q", "A3.0"): "DETAILS", ("p", "A1.01"): "PLAN ONE", ("p", "A3"): "DETAILS", ("p", "A4"): "ROOF PLAN of the barn"}


NUMBERS = {
    "SEE DRAWING INDEX FOR LIST\nSHEET NO: A101": "A101", "SHEET A101": "A101", "SHEET NO:\nA101 REV 2": "A101", "DWG NO.:\n\nE1.1 X": "E1.1", "EET\nA5": "A5", "plain prose": None,
    "ANSI Z97.1 requirements\nA002": "A002", "NO\n\n\nB1.2": "B1.2", "Some text\nSHEET NO: A1.1\nMore text": "A1.1", "DWG NO: E1.1": "E1.1", "SHEET NO: A-1.1": "A-1.1", "": None, None: None,
    "DRAWING INDEX: A1.0 PLAN\nSHEET NO: Z9": None,
}


def test_numbers_from_text(spark):
    d = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
    assert {r.t: r.n for r in d.select("t", numbers.number_from_text(F.col("t")).alias("n")).collect()} == NUMBERS


def test_strings(spark):
    d = spark.createDataFrame([("a b(c)", "A1.OFFICE 2.OTHER A1.O", "Floor Plan No.", "ABC1", " - TITLE", ": the  plan -")], "a string, b string, c string, e string, f string, g string")
    r = d.select(
        F.rlike("a", text.quoted(F.col("a"))), text.repair_zero(F.col("b")), text.safe_filename(F.col("c"), 50), numbers.candidate_shape(F.col("e")), text.clean_title(F.col("f")), text.clean_title(F.col("g")),
        numbers.title_sheet_number(F.lit("cover T-1234 t1.1 T2")), numbers.false_project(F.lit("2024"), F.lit("x")), numbers.false_project(F.lit("4321"), F.lit("4321 N. MAIN ST")), numbers.false_project(F.lit("20-117"), F.lit("job 20-117")),
    ).first()
    assert tuple(r) == (True, "A1.OFFICE 2.OTHER A1.0", "Floor_Plan_No.", True, None, "the plan", "T1.1", True, True, False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 4), st.sampled_from(["x", "y", None])), max_size=8))
def test_upsert_is_idempotent(spark, rows):
    unique = {(a, b): c for a, b, c in rows}
    batch = spark.createDataFrame([(a, b, c) for (a, b), c in unique.items()], "pdf_filename string, page_number int, sheet_title string")
    target = spark.createDataFrame([("a", 1, "old", "n1"), ("c", 9, "kept", "n2")], "pdf_filename string, page_number int, sheet_title string, sheet_number string")
    once = store.upsert(target, batch)
    twice = store.upsert(once, batch)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.where("pdf_filename = 'c'").first().sheet_title == "kept"


def test_project_fallback(spark):
    rows = [("p", 1, "X"), ("p", 2, "X"), ("p", 3, None), ("p", 4, "Y"), ("q", 1, "A"), ("q", 2, "B"), ("q", 3, "")]
    d = learn.project_fallback(spark.createDataFrame(rows, "pdf_filename string, page_number int, project_number string"))
    got = {(r.pdf_filename, r.page_number): r.project_number for r in d.collect()}
    assert got[("p", 3)] == "X" and got[("q", 3)] is None and got[("p", 4)] == "Y"


def test_neighbours_need_the_exact_page(spark):
    rows = [("p", 1, "Floor Plan", 0), ("p", 2, None, 1), ("p", 3, "Roof Plan", 0), ("p", 5, None, 1), ("p", 7, "Site Plan", 0)]
    got = {r.page_number: r.base for r in learn.neighbour_base(spark.createDataFrame(rows, "pdf_filename string, page_number int, sheet_title string, needs_review int")).collect()}
    assert got[2] == 0.80 and got[5] is None


def test_clusters(spark):
    d = spark.createDataFrame([(1, x) for x in (0.10, 0.105, 0.11, 0.5, 0.505)], "id int, pos double")
    assert sorted(r.n for r in profiles.clusters(d).collect()) == [2, 3]


def test_extraction_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sheets": [{"pdf_filename": "a.pdf", "page_number": 1, "sheet_number": "A101", "title_confidence": 0.5}]}))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"pdf": "b.pdf", "pages": [{"page": 2, "sheet_number": "S1", "number_conf": 0.9}]}]}))
    got = {(r.pdf_filename, r.page_number, r.sheet_number, r.number_confidence, r.title_confidence) for r in readers.read_extraction(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", 1, "A101", 0.0, 0.5), ("b.pdf", 2, "S1", 0.9, 0.0)}


def test_corrections_and_samples(spark, tmp_path):
    names = readers.CORRECTIONS.replace(" string", "").replace(", ", ",")
    (tmp_path / "c.csv").write_text(names + "\n" + "a.pdf,1,,,,,,,,, Fixed \n" + "a.pdf,2,,,,,,,,,\n")
    got = readers.read_corrections(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.page_number, r.corrected_title) for r in got] == [(1, "Fixed")]
    files = spark.createDataFrame([("a.pdf",), ("a_5pages.pdf",), ("b_5pages.pdf",)], "pdf_filename string")
    assert {r.pdf_filename for r in readers.without_samples(files).collect()} == {"a.pdf", "b_5pages.pdf"}


def test_stream_into_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "pdf_filename string, page_number int, sheet_title string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    rows.where("page_number = 2").withColumn("sheet_title", F.lit("z")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.page_number, r.sheet_title) for r in spark.read.parquet(str(tmp_path / "store" / "v=2")).collect()}
    assert got == {(1, "x"), (2, "z")}
