"""The fields of a page: number, title, date, scale and discipline, each by its cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import discipline_of, number_from_text, title_sheet_number
from ..functions.pages import is_cover, row_errors, title_from_text
from ..functions.scores import page_confidence
from ..functions.text import first_field
from ..functions.titles import quality_gate, validated_title
from ..rules import fixed
from .classify import settled
from .index import lookup_titles
from .spatial import best_span, nearest_value


def with_number(d: DataFrame) -> DataFrame:
    """Adds sheet_number and number_method, the first of: text, what stands near a label, text read from the title block, a title sheet's number, a model's reply.

    Needs text, page_number, is_cover_sheet, _spatial_number, _ocr_text and
    _vision_number; the last three may be null. A model's reply counts if it
    looks like a number, and replaces one read from text if they differ.
    """
    reply = F.upper(F.trim("_vision_number"))
    title_sheet = F.coalesce(F.col("is_cover_sheet"), F.lit(False)) | (F.col("page_number") == 1)
    found = {
        "_by_text": number_from_text(F.col("text")), "_by_ocr": F.when(F.col("_ocr_text").isNotNull(), number_from_text(F.col("_ocr_text"))),
        "_by_title_sheet": F.when(title_sheet, title_sheet_number(F.col("text"))), "_reply": F.when(reply.rlike(r"^[A-Z]{0,3}[-.]?\d{1,3}(?:\.\d{1,2})?$"), reply),
    }
    d = settled(d.withColumns(found), *found)
    out = lambda c, m: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("number"), F.lit(m).alias("method")))
    first = F.coalesce(out("_by_text", "extracted"), out("_spatial_number", "extracted"), out("_by_ocr", "title_block_ocr"), out("_by_title_sheet", "title_sheet_pattern"), out("_reply", "vision_api"))
    d = settled(d.withColumn("_first", first), "_first")
    other = F.coalesce(F.col("_first.method").isin("extracted", "title_block_ocr") & (F.col("_reply") != F.col("_first.number")), F.lit(False))
    return d.withColumns({
        "sheet_number": F.when(other, F.col("_reply")).otherwise(F.col("_first.number")), "number_method": F.when(other, F.lit("vision_api_verified")).otherwise(F.col("_first.method")),
    }).drop("_first", *found)


def with_title(d: DataFrame) -> DataFrame:
    """Adds sheet_title, title_method, title_confidence and needs_review by layers: drawing index, place, model, pattern, a cover's own title.

    Needs text, is_cover_sheet, index_title, _spatial_title, _vision_title and
    _project_number. A layer counts if its title is valid; titles by place
    and by pattern go through the quality gate first. Text of fewer than 100
    characters is taken as read from an image, where only keywords count.
    """
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < 100
    d = settled(d.withColumns({"_strict": F.when(short, title_from_text(F.col("text"), strict=True)), "_loose": F.when(~short, title_from_text(F.col("text")))}), "_strict", "_loose")
    d = d.withColumn("_pattern", F.coalesce("_strict", "_loose")).drop("_strict", "_loose")
    layers = (("index_title", "drawing_index", False), ("_spatial_title", "spatial", True), ("_vision_title", "vision_api", False), ("_pattern", "pattern", True))
    for c, method, gate in layers:
        d = d.withColumn(f"_v_{method}", F.when(F.col(c).isNotNull(), validated_title(F.col(c), F.lit(method), F.col("_project_number"))))
        d = d.withColumn(f"_g_{method}", F.when(F.col(c).isNotNull(), quality_gate(F.col(c), F.col("_project_number"))["ok"]) if gate else F.lit(True))
    d = settled(d, *[f"_{k}_{m}" for _, m, _ in layers for k in "vg"])
    taken = [
        F.when(F.col(f"_v_{m}.is_valid") & F.col(f"_g_{m}"), F.struct(F.col(f"_v_{m}.title").alias("title"), F.lit(m).alias("method"), F.col(f"_v_{m}.confidence").alias("confidence"), F.col(f"_v_{m}.needs_review").cast("int").alias("needs_review")))
        for _, m, _ in layers
    ]
    made = lambda t, m, c, r: F.struct(F.lit(t).cast("string").alias("title"), F.lit(m).cast("string").alias("method"), F.lit(c).alias("confidence"), F.lit(r).alias("needs_review"))
    d = d.withColumn("_t", F.coalesce(*taken, F.when(F.col("is_cover_sheet"), made(fixed.COVER_TITLE, "pattern", 0.95, 0)), made(None, None, 0.0, 1)))
    d = settled(d, "_t").drop("_pattern", *[f"_{k}_{m}" for _, m, _ in layers for k in "vg"])
    return d.withColumns({"sheet_title": F.col("_t.title"), "title_method": F.col("_t.method"), "title_confidence": F.col("_t.confidence"), "needs_review": F.col("_t.needs_review")}).drop("_t")


def extract_fields(pages: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row a page: its fields, how they were found, and its confidence.

    ``pages``: pdf_filename, page_number, text, and optionally spatial_number,
    spatial_title, ocr_text, vision_number, vision_title and project_number.
    ``index``: entries (pdf_filename, sheet_number, title, ord), looked up by
    the number that was found. A page stays in its stage but for that join.
    """
    has = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    d = pages.select("pdf_filename", "page_number", "text", *[has(c).alias(f"_{c}") for c in ("spatial_number", "spatial_title", "ocr_text", "vision_number", "vision_title", "project_number")])
    d = settled(d.withColumn("is_cover_sheet", is_cover(F.col("text"), F.col("page_number"))), "is_cover_sheet")
    d = with_number(d)
    d = lookup_titles(d, index) if index is not None else d.withColumn("index_title", F.lit(None).cast("string"))
    d = with_title(d)
    d = settled(d.withColumn("_valid", F.size(row_errors(F.col("sheet_number"), F.col("_project_number"), F.col("sheet_title"))) == 0), "_valid")
    return d.select(
        "pdf_filename", "page_number", "sheet_number", "number_method", F.col("_project_number").alias("project_number"), "sheet_title", "title_method", "title_confidence", "needs_review",
        "is_cover_sheet", "index_title", first_field(F.col("text"), "date").alias("date"), first_field(F.col("text"), "scale").alias("scale"), discipline_of(F.col("sheet_number")).alias("discipline"),
        F.col("_valid").cast("int").alias("is_valid"), page_confidence(F.col("sheet_number"), F.col("_project_number"), F.col("_valid")).alias("confidence"),
    )


def with_places(pages: DataFrame, blocks: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Pages with spatial_number from text blocks and spatial_title from title block spans; both have the page's key in ``page``."""
    near = nearest_value(blocks).select("page", F.col("value").alias("spatial_number"))
    out = pages.join(near, "page", "left")
    return out if spans is None else out.join(best_span(spans).select("page", F.col("text").alias("spatial_title")), "page", "left")
