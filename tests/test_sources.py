"""PDF files, providers, sinks and the field cascade on small fixtures."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import fields, providers, review, store
from sheetwright.sources import pdf, readers, sinks


def made_pdf(pages, deflate=True):
    """A PDF of pages, each a list of (text, x, y, size)."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 2592 1728] /Resources 3 0 R >>".encode(), 3: b"<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >>"}
    for i, lines in enumerate(pages):
        body = b"".join(b"BT /F1 %d Tf %d %d Td (%s) Tj ET\n" % (s, x, y, t.replace("(", r"\(").replace(")", r"\)").encode("cp1252")) for t, x, y, s in lines)
        data = zlib.compress(body) if deflate else body
        objects[4 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>".encode()
        objects[5 + 2 * i] = f"<< /Length {len(data)}{' /Filter /FlateDecode' if deflate else ''} >>\nstream\n".encode() + data + b"\nendstream"
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for k, v in sorted(objects.items()):
        places[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[k] for k in sorted(objects))
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


PAGES = [[("FLOOR PLAN (NORTH)", 2000, 800, 24), ("SHEET NO:", 2300, 100, 10), ("A1.01", 2300, 60, 18)], [("Détails of doors", 100, 1600, 12)], []]


@pytest.mark.parametrize("deflate", [True, False])
def test_pages_of_a_file(deflate):
    got = pdf.parse_pdf(made_pdf(PAGES, deflate))
    assert [p["text"] for p in got] == ["FLOOR PLAN (NORTH)\nSHEET NO:\nA1.01", "Détails of doors", ""]
    assert (got[0]["width"], got[0]["height"]) == (2592.0, 1728.0)
    b = got[0]["blocks"][2]
    assert (b["text"], b["x0"], b["y1"], b["font_size"], b["block_no"]) == ("A1.01", 2300.0, 1668.0, 18.0, 2)
    one = pdf.single_page(made_pdf(PAGES, deflate), 2)
    assert [p["text"] for p in pdf.parse_pdf(one)] == ["Détails of doors"] and pdf.parse_pdf(one)[0]["width"] == 2592.0
    with pytest.raises(pdf.PdfError):
        pdf.single_page(made_pdf(PAGES), 4)


def test_own_characters_and_kerning():
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    body = b"BT /F1 10 Tf 10 700 Td [<00010002> -300 <00100012>] TJ T* (x) Tj ET"
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F1 << /ToUnicode 5 0 R >> >> >> >>\nendobj\n"
    for k, v in ((4, body), (5, cmap)):
        data += b"%d 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, len(v), v)
    assert pdf.parse_pdf(data)[0]["text"].startswith("Aé ac")


def test_files_to_fields(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made_pdf(PAGES))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "note.txt").write_text("x")
    files = pdf.read_input(spark, str(tmp_path))
    pages = pdf.read_pages(files).cache()
    got = {(r.pdf_filename, r.page_number): r for r in pages.collect()}
    assert set(got) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("bad.pdf", None)} and got["bad.pdf", None].error.startswith("PdfError")
    rows = {r.page_number: r for r in fields.extract_fields(pages.where("error is null")).collect()}
    assert (rows[1].sheet_number, rows[1].number_method, rows[1].discipline) == ("A1.01", "extracted", "Architectural") and rows[1].title_method == "pattern"
    assert rows[3].sheet_number is None and rows[3].sheet_title is None and rows[3].needs_review == 1
    assert pdf.read_input(spark, str(tmp_path / "a.pdf")).count() == 1
    with pytest.raises(FileNotFoundError):
        pdf.read_input(spark, str(tmp_path / "none"))
    plan = spark.createDataFrame([("a.pdf", 2, "details", "details/a_2.pdf"), ("a.pdf", 9, "details", "details/a_9.pdf")], "pdf_filename string, page_number int, category string, target string")
    status = lambda: {r.target: r.status.partition(":")[0] for r in pdf.extract_pages(plan, files, f"file://{tmp_path}/out").collect()}
    assert status() == {"details/a_2.pdf": "extracted", "details/a_9.pdf": "error"} and status()["details/a_2.pdf"] == "skipped"
    assert pdf.parse_pdf((tmp_path / "out/details/a_2.pdf").read_bytes())[0]["text"] == "Détails of doors"


def test_cascade(spark):
    rows = [
        ("p", 1, "COVER SHEET\nproject of houses", None, None, None, None), ("p", 2, "SHEET NO: A101", None, None, None, "A107"), ("p", 3, "plain", "B2.2", "REFLECTED CEILING PLAN", None, None),
        ("p", 4, "plain", None, None, "SHEET NO: C3", "bad reply"), ("p", 5, "plain", None, "PLAN", None, " m-7 "), ("p", 6, "T1.1 notes", None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "pdf_filename string, page_number int, text string, spatial_number string, spatial_title string, ocr_text string, vision_number string")
    index = spark.createDataFrame([("p", "A107", "FIRST FLOOR PLAN", 1), ("p", "C3", "x", 2)], "pdf_filename string, sheet_number string, title string, ord int")
    got = {r.page_number: r for r in fields.extract_fields(d, index).collect()}
    assert [(got[i].sheet_number, got[i].number_method) for i in range(1, 7)] == [(None, None), ("A107", "vision_api_verified"), ("B2.2", "extracted"), ("C3", "title_block_ocr"), ("M-7", "vision_api"), (None, None)]
    assert (got[1].sheet_title, got[1].title_confidence, got[1].needs_review) == ("TITLE SHEET", 0.95, 0) or got[1].title_method == "pattern"
    assert (got[2].sheet_title, got[2].title_method) == ("First Floor Plan", "drawing_index")
    assert (got[3].sheet_title, got[3].title_method) == ("Reflected Ceiling Plan", "spatial") and got[5].title_method is None


def test_providers(spark):
    pages = spark.createDataFrame([("a", 1, bytearray(b"one")), ("a", 2, bytearray(b"one")), ("b", 1, bytearray(b"two")), ("c", 1, None)], "pdf_filename string, page_number int, image binary")

    def first(images):
        return [" " if x == b"one" else "read by first" for x in images]

    def second(images):
        assert len(images) == len(set(images))
        return [f"second {x.decode()}" for x in images]

    def broken(images):
        raise RuntimeError("no engine")

    text = providers.read_text(pages, {"broken": broken, "first": first, "second": second})
    got = {(r.pdf_filename, r.page_number): r.ocr for r in providers.with_replies(pages, text, "ocr", "ocr_text").collect()}
    assert got == {("a", 1): "second one", ("a", 2): "second one", ("b", 1): "read by first", ("c", 1): None}
    words = providers.read_words(pages, lambda images: [[("A1", 1, 2, 3, 4, "96"), ("low", 0, 0, 1, 1, 12), (" ", 0, 0, 1, 1, 99), ("odd", 0, 0, 1, 1, "x")] for _ in images])
    assert {(r.text, r.x1, r.y1, r.confidence) for r in words.collect()} == {("A1", 4.0, 6.0, 96)} and words.count() == 2
    replies = spark.createDataFrame([("```json\n" + json.dumps({"title_block": {"confidence": 0.9, "bbox_percent": {"x1": 0.8}}, "zones": {"a": {"bbox_percent": {"x1": 0.1}}, "b": {}}}) + "\n```",), ("none",)], "r string")
    one, none = [r.t for r in replies.select(providers.telemetry(F.col("r")).alias("t")).collect()]
    assert tuple(one.box) == (0.8, 0.70, 1.0, 1.0) and one.location == "bottom_right" and one.is_consistent and set(one.zones) == {"a"} and tuple(one.zones["a"].box) == (0.1, 0.0, 1.0, 1.0) and none is None
    values = spark.createDataFrame([(" Plan ",), ("unknown",), ("",)], "r string")
    assert [r[0] for r in values.select(providers.reply_value(F.col("r"))).collect()] == ["Plan", None, None]


def test_queue(spark, tmp_path):
    q = spark.createDataFrame([], review.QUEUE)
    items = [(1, "A1", "one", "NEEDS_EVALUATION", ["floor_plans"], "low", 1), (2, "A2", "two", "NEEDS_EVALUATION", [], "low", 2), (3, "A3", "three", "NEEDS_EVALUATION", [], "low", 2), (4, "A4", "four", "DEFINITELY_NEEDED", [], "low", 0)]
    q = review.add_items(q, spark.createDataFrame(items, "ord long, sheet_number string, sheet_title string, decision string, categories array<string>, review_reason string, priority int"))
    assert review.next_item(q).first().ord == 2 and [r.ord for r in review.pending(q).collect()] == [2, 3, 1, 4] and [r.ord for r in review.pending(q, 2).collect()] == [2, 3]
    marks = spark.createDataFrame([(2, "DEFINITELY_NEEDED", ["floor_plans"], "sure"), (4, "DEFINITELY_NEEDED", ["floor_plans"], "")], "ord long, human_decision string, human_categories array<string>, human_notes string")
    q = review.mark_reviewed(q, marks)
    review.save_queue(q, str(tmp_path / "q"))
    q = review.load_queue(spark, str(tmp_path / "q"))
    assert q.count() == 4 and review.next_item(q).first().ord == 3
    fixes = review.corrections_of(q)
    assert [(r.ord, r.original_decision, r.human_decision) for r in fixes.collect()] == [(2, "NEEDS_EVALUATION", "DEFINITELY_NEEDED")]
    assert tuple(review.category_titles(fixes).first()) == ("floor_plans", 1, ["two"])


def test_store_and_runs(spark):
    s = store.create_store(spark)
    batch = spark.createDataFrame([("a.pdf", 1, "one"), ("a.pdf", 2, "two")], "pdf_filename string, page_number int, sheet_title string")
    s = spark.createDataFrame(store.upsert_stamped(s, batch).collect(), store.SHEETS)
    again = spark.createDataFrame(store.upsert_stamped(s, batch.where("page_number = 2").withColumn("sheet_title", F.lit("new"))).collect(), store.SHEETS)
    old, new = ({r.page_number: r for r in x.collect()} for x in (s, again))
    assert {k: v.id for k, v in old.items()} == {k: v.id for k, v in new.items()} and new[2].sheet_title == "new" and new[2].created_at == old[2].created_at and new[2].updated_at >= old[2].updated_at
    third = {r.page_number: r.id for r in store.upsert_stamped(again, batch.limit(1).withColumn("page_number", F.lit(3))).collect()}
    assert len(set(third.values())) == 3 and [r.page_number for r in store.sheets_of(again, "a.pdf").collect()] == [1, 2] and store.sheet(again, "a.pdf", 2).count() == 1
    fixed = store.apply_corrections(again, spark.createDataFrame([("a.pdf", 1, " Fixed "), ("x.pdf", 1, "y")], "pdf_filename string, page_number int, corrected_title string"))
    r = {x.page_number: x for x in fixed.collect()}[1]
    assert (r.sheet_title, r.title_confidence, r.title_method, r.needs_review) == ("Fixed", 1.0, "hitl_correction", 0) and fixed.count() == 2
    runs = store.start_runs(spark.createDataFrame([], store.RUNS), spark.createDataFrame([("r1", "a", 3), ("r2", "b", 3)], "id string, pdf_path string, total_pages int"))
    runs = store.update_runs(runs, spark.createDataFrame([("r1", 3, 2, 1), ("r2", 3, 3, 0)], "id string, processed_pages long, success_count long, error_count long"))
    done = store.complete_runs(runs, spark.createDataFrame([("r1",), ("r2",)], "id string"))
    assert {x.id: (x.status, x.success_count, x.completed_at is not None) for x in done.collect()} == {"r1": ("completed_with_errors", 2, True), "r2": ("completed", 3, True)}


def test_sinks(spark, tmp_path):
    rows = [("a.pdf", 1, "A1", "Plan <x>", 0.5, 0, "spatial", 1), ("a.pdf", 2, None, None, 0.9, 1, None, 2), ("a.pdf", 3, "A3", "Three", 0.95, 1, "pattern", 3)]
    d = spark.createDataFrame(rows, "pdf_filename string, page_number int, sheet_number string, sheet_title string, title_confidence double, needs_review int, title_method string, ord int")
    csv = sinks.review_csv(d, "ord").collect()
    assert [r.page_number for r in csv] == [2, 3, 1] and [r.needs_review for r in csv] == ["YES", "YES", "NO"] and csv[0].confidence == "0.90" and list(csv[0].asDict()) == readers.CORRECTIONS.replace(" string", "").split(", ")
    page = sinks.review_html(sinks.review_counts(d).first().asDict(), [r.asDict() for r in csv])
    assert "Plan &lt;x&gt;" in page and "2 of 3 sheets" in page
    summary = sinks.run_report(d.withColumn("is_valid", F.lit(True)), str(tmp_path / "run"))
    assert summary["total_pages"] == 3 and spark.read.json(str(tmp_path / "run" / "sheets")).count() == 3
    assert [r.mean_confidence for r in sinks.full_test_summary(d).collect()] == [round((0.5 + 0.9 + 0.95) / 3, 6)]
    truth = sinks.truth_rows(d.withColumn("api_success", F.lit("True")).withColumn("extra", F.lit(1)))
    assert truth.columns == list(sinks.TRUTH_COLUMNS) and sinks.missing_titles(truth).count() == 1
    named = sinks.cleaned_truth(truth, spark.createDataFrame([("a.pdf", "NORTH HALL")], "pdf_filename string, name string"))
    assert {r.project_name for r in named.collect()} == {"NORTH HALL"} and named.columns == truth.columns
    t = spark.createDataFrame([("h1", 0.5), ("h2", 0.6)], "pdf_hash string, confidence double")
    saved = sinks.save_template(t, spark.createDataFrame([("h2", 0.9), ("h3", 0.7)], "pdf_hash string, confidence double"))
    assert {(r.pdf_hash, r.confidence) for r in saved.collect()} == {("h1", 0.5), ("h2", 0.9), ("h3", 0.7)} and sinks.delete_template(saved, t).count() == 1
    crops = spark.createDataFrame([("/x/12345678/p001_titleblock.png",)], "path string")
    assert sinks.crop_copies(crops).first().target == "12345678_p001_titleblock.png"


def test_readers(spark, tmp_path):
    names = ",".join(sinks.TRUTH_COLUMNS)
    (tmp_path / "truth.csv").write_text(f"{names}\na.pdf,1,A1,First,,,,True,\na.pdf,1,A1,Second,,,,True,\na.pdf,x,A1,No page,,,,True,\n")
    assert [(r.page_number, r.sheet_title) for r in readers.read_truth(spark, str(tmp_path / "truth.csv")).collect()] == [(1, "Second")]
    (tmp_path / "expected.json").write_text(json.dumps({"a.pdf": {"1": {"sheet_number": "A1", "is_cover_sheet": True}, "2": {"sheet_title": "Two"}}}))
    got = {r.page_number: r for r in readers.read_expected(spark, str(tmp_path / "expected.json")).collect()}
    assert got[1].sheet_number == "A1" and got[1].is_cover_sheet and got[2].sheet_title == "Two" and got[2].project_number is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "h1.json").write_text(json.dumps({"pdf_hash": "h1", "confidence": 0.9, "exclusion_patterns": ["REV"]}))
    (tmp_path / "t" / "h2.json").write_text("{broken")
    assert [(r.pdf_hash, r.exclusion_patterns) for r in readers.read_templates(spark, str(tmp_path / "t")).collect()] == [("h1", ["REV"])]


def test_streams(spark, tmp_path):
    """Files that arrive are read and parsed as a stream, and distinct images are asked once."""
    from sheetwright.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(made_pdf(PAGES))
    pages = pdf.read_pages(ingest.pdf_stream(spark, str(tmp_path / "in")))
    got = ingest.drain(pages, "pages_of_a_stream", "append")
    assert [r.page_number for r in got.orderBy("page_number").collect()] == [1, 2, 3]
    images = spark.createDataFrame([("h", bytearray(b"x")), ("h", bytearray(b"x"))], "image_hash string, image binary")
    assert [tuple(r) for r in ingest.with_provider(images, lambda xs: [f"{len(x)} bytes" for x in xs]).collect()] == [("h", "1 bytes")]


def test_pixels_and_lines(spark):
    from sheetwright.functions import geometry, pages
    from sheetwright.operators import profiles

    d = spark.createDataFrame([(1, x, float(v)) for x, v in enumerate([0, 1, 4, 9])], "id int, x int, v double")
    import numpy as np

    v = np.array([0, 1, 4, 9], float)
    want = [float(np.concatenate([v[:2][::-1], v, v[::-1][:1]])[i : i + 4].mean()) for i in range(4)]
    assert [round(r.s, 9) for r in profiles.smoothed(d, 2, 1).orderBy("x").collect()] == [round(w, 9) for w in want]
    r = spark.range(1).select(geometry.page_regions(F.lit(2000), F.lit(1000), 200).alias("r"), pages.detection_pages(F.lit(6)).alias("d"), pages.detection_pages(F.lit(4)).alias("e"), pages.detection_pages(F.lit(1)).alias("f")).first()
    assert [x.name for x in r.r] == ["bottom_right", "right_strip", "bottom_strip", "bottom_left"] and (r.d, r.e, r.f) == ([1, 3, 5], [1, 2], [0]) and abs(r.r[0].box.x0 - 0.65) < 1e-9


def test_images(spark):
    import numpy as np

    from sheetwright.operators import images

    page = np.full((40, 100), 255, np.uint8)
    page[:, 70] = 0
    page[5:9, 10:14] = 0
    for data in (images.encode(page), b"P5 100 40 255\n" + page.tobytes(), b"P6\n100 40\n255\n" + np.repeat(page[:, :, None], 3, 2).tobytes()):
        assert (images.decode(data) == page).all()
    with pytest.raises(images.ImageError):
        images.decode(b"\x89PNG\r\n\x1a\n broken")
    assert (images.prepared(255 - page) == page).all() and images.prepared(page, 90).shape == (120, 300)
    assert images.longest_runs(page < 128)[[0, 10, 70]].tolist() == [0, 4, 40]
    assert images.largest_part(page < 128) == (40, 70, 0, 70, 39) and images.largest_part(page > 300) is None
    corner = np.eye(4, dtype=bool)
    assert images.largest_part(corner) == (4, 0, 0, 3, 3)
    d = spark.createDataFrame([("a", bytearray(images.encode(page)), 90), ("b", bytearray(images.encode(page)), 90), ("c", bytearray(b"none"), 0), ("d", None, 0)], "k string, image binary, angle int")
    facts = images.image_facts(d.drop("angle")).collect()
    assert sorted((r.width or 0, r.blank) for r in facts if not r.error) == [(100, True)] and sum(bool(r.error) for r in facts) == 1
    (turned,) = [r for r in images.turn(d).collect() if r.image]
    assert turned.angle == 90 and (images.decode(bytes(turned.image)) == np.rot90(page)).all()
    crops = {r.strip: r.image for r in images.crop(d.where("k = 'a'").drop("angle")).collect()}
    assert (images.decode(bytes(crops["block_right"])) == page[:, 70:]).all() and set(crops) == set(images.STRIPS)
    p = {r.x: (r.v, r.run) for r in images.column_profiles(d.drop("angle")).collect()}
    assert p[0] == (0, 0) and max(p, key=lambda x: p[x]) in (69, 71) and len(p) == 100
    assert images.main_parts(d.drop("angle")).count() == 1
    assert images.prepare(d.drop("angle")).where("image is not null").count() == 1


def test_png_filters():
    """Every filter of the format, by a plain encoder."""
    import struct

    import numpy as np

    from sheetwright.operators import images

    values = np.random.default_rng(4).integers(0, 256, (10, 7, 3)).astype(np.uint8)

    def guess(kind, left, up, corner):
        if kind == 4:
            near = [abs(left + up - corner - x) for x in (left, up, corner)]
            return (left, up, corner)[near.index(min(near))]
        return (0, left, up, (left + up) // 2)[kind]

    body = bytearray()
    for y in range(10):
        kind = y % 5
        body.append(kind)
        for i in range(21):
            v = values.reshape(10, 21).astype(int)
            left, up, corner = v[y, i - 3] if i >= 3 else 0, v[y - 1, i] if y else 0, v[y - 1, i - 3] if y and i >= 3 else 0
            body.append(int(v[y, i] - guess(kind, int(left), int(up), int(corner))) & 255)
    chunk = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(body))) + chunk(b"IEND", b"")
    assert (images.decode(data) == images.grey(values)).all()


def test_settings_and_lines(spark, tmp_path):
    from sheetwright.functions import text
    from sheetwright.operators import accuracy, classify
    from sheetwright.streaming import ingest

    assert readers.settings("# c\nexport A = 1\nB='two words'\n\nC=x=y\nA=9\nbad", {"B": "kept"}) == {"A": "1", "B": "kept", "C": "x=y"}
    assert accuracy.summary_lines({"total_pages": 3, "errors": 0})[2:] == ["total pages  3", "errors       0"]
    assert spark.range(1).select(text.stamped_name("run_", F.to_timestamp(F.lit("2024-01-02 03:04:05")), ".json")).first()[0] == "run_20240102_030405.json"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"pdf_hash": "h", "warnings": ["w"]}))
    (tmp_path / "d" / "b.json").write_text("{")
    assert [(r.pdf_hash, r.warnings) for r in readers.read_discoveries(spark, str(tmp_path / "d"), "warnings array<string>").collect()] == [("h", ["w"])]
    rows = spark.createDataFrame([("p", "A101", None), ("p", "Z9", "Unknown Drawing")], "pdf_filename string, sheet_number string, sheet_title string")
    got = {r.sheet_number: r for r in classify.with_index(rows, spark.createDataFrame([("p", "A101", "FIRST FLOOR PLAN")], "pdf_filename string, sheet_number string, title string")).collect()}
    assert got["A101"].categories[0] == "floor_plans" and {s.source for s in got["A101"].signals} == {"drawing_index", "sheet_number", "title_pattern"} and got["Z9"].index_title is None
    d = spark.createDataFrame([("a.pdf", None), ("a.pdf", "bad")], "pdf_filename string, error string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.logged_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.pdf_filename, r.pages, r.errors) for r in spark.read.json(str(tmp_path / "log")).collect()] == [("a.pdf", 2, 1)]


def test_limited_calls(spark):
    now, slept, asked = [0.0], [], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    def engine(image):
        asked.append(image)
        if image == b"refused" or image == b"once" and asked.count(b"once") == 1:
            raise providers.Refused
        return image.decode()

    limited = providers.Limited(engine, 3, (60, 120), lambda: now[0], sleep)
    assert limited([b"a", b"b", b"c", b"d"]) == ["a", "b", "c", "d"] and slept == [60]
    assert limited([b"once"]) == ["once"] and slept == [60, 60] and not limited.off
    assert limited([b"refused", b"e"]) == [None, None] and limited.off and slept[-1] == 120
    pages = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "image binary")
    first = providers.read_replies(pages.limit(1), lambda xs: [f"Plan {x.decode()}" for x in xs]).cache()

    def unknown(images):
        assert images == [b"two"]
        return ["UNKNOWN"]

    both = providers.read_replies(pages, unknown, first)
    assert sorted((r.t or "") for r in providers.with_replies(pages, both, "t").collect()) == ["", "Plan one", "Plan one"] and both.count() == 2


def test_identified_templates(spark):
    from sheetwright.operators import learn

    t = learn.identified(spark.createDataFrame([("a.pdf", 0.9)], "pdf_filename string, confidence double"), spark.createDataFrame([("a.pdf", "h")], "pdf_filename string, pdf_hash string")).first()
    assert len(t.template_id) == 36 and (t.pdf_hash, t.source_pdf) == ("h", "a.pdf") and "T" in t.created_at
