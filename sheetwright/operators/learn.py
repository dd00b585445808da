"""Per-PDF learning: templates, neighbours, project numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, strip
from ..functions.titles import learning_gate
from ..rules import fixed


def learning_rows(d: DataFrame) -> DataFrame:
    """Rows whose title is good to learn from, without titles on more than a fifth of their PDF's pages."""
    good = d.where((F.coalesce("needs_review", F.lit(0)) != 1) & learning_gate(F.col("sheet_title"))["ok"])
    pages = d.groupBy("pdf_filename").agg(F.count("*").alias("_pages"))
    often = good.groupBy("pdf_filename", "sheet_title").agg(F.count("*").alias("_n")).join(pages, "pdf_filename")
    often = often.where(F.col("_n") > F.col("_pages") * F.lit(fixed.LEARN_REPETITION)).select("pdf_filename", "sheet_title")
    return good.join(often, ["pdf_filename", "sheet_title"], "left_anti")


def quality_confidence(rate: Column) -> Column:
    return F.when(rate >= 0.80, 0.95).when(rate >= 0.60, 0.85).when(rate >= 0.40, 0.75).otherwise(0.70)


def learn_templates(d: DataFrame) -> DataFrame:
    """A template for each PDF with five rows or more to learn from.

    pdf_filename, pages_analyzed, quality_pages_used, confidence,
    typical_length_min and _max, vector_pages, scanned_pages and
    exclusion_patterns (standard ones, then titles that failed three times or
    more, in order of appearance).
    """
    vector = F.col("extraction_method") == "vector" if "extraction_method" in d.columns else F.lit(True)
    pages = d.groupBy("pdf_filename").agg(F.count("*").alias("pages_analyzed"), F.count_if(vector).alias("vector_pages"))
    n = F.length("sheet_title")
    good = learning_rows(d).groupBy("pdf_filename").agg(F.count("*").alias("quality_pages_used"), F.min(n).alias("typical_length_min"), F.max(n).alias("typical_length_max"))
    good = good.where(F.col("quality_pages_used") >= fixed.LEARN_MIN_ROWS)
    failed = d.where((F.col("needs_review") == 1) & (F.col("sheet_title") != "")).groupBy("pdf_filename", "sheet_title")
    failed = failed.agg(F.count("*").alias("n"), F.min("page_number").alias("first")).where("n >= 3")
    more = failed.groupBy("pdf_filename").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "sheet_title"))), lambda x: quoted(x["sheet_title"])).alias("more"))
    standard = F.array(*[F.lit(p) for p in fixed.STANDARD_EXCLUSIONS])
    out = pages.join(good, "pdf_filename").join(more, "pdf_filename", "left")
    return out.select(
        "pdf_filename", "pages_analyzed", "quality_pages_used", quality_confidence(F.col("quality_pages_used") / F.col("pages_analyzed")).alias("confidence"),
        "typical_length_min", "typical_length_max", "vector_pages", (F.col("pages_analyzed") - F.col("vector_pages")).alias("scanned_pages"),
        F.concat(standard, F.coalesce("more", F.array().cast("array<string>"))).alias("exclusion_patterns"),
    )


def candidate_ok(text: Column, t: Column) -> Column:
    """Whether a text may be a title under a template ``t``."""
    least, most = F.floor(t["typical_length_min"] * 0.5), F.floor(t["typical_length_max"] * 1.5)
    excluded = F.exists(t["exclusion_patterns"], lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p)))
    return (text != "") & ~excluded & F.length(text).between(least, most) & ~text.rlike(r"^\d+$") & ~text.rlike(r"(?i)^[A-Z]{1,2}[-.]?\d{1,4}(\.\d{1,2})?$")


def _keyed(x: Column) -> Column:
    return F.upper(x).rlike("|".join(fixed.QUALITY_KEYWORDS))


def block_score(text: Column, font_size: Column) -> Column:
    """How well a block fits a title: up to 1 for its font size by 20, 2 for a keyword, up to 1 for its length."""
    n = F.length(text)
    font = F.when(font_size > 0, F.least(font_size / 20.0, F.lit(1.0))).otherwise(0.0)
    return font + F.when(_keyed(text), 2.0).otherwise(0.0) + F.when(n.between(15, 40), 1.0).when(n.between(10, 50), 0.5).otherwise(0.0)


def apply_to_blocks(blocks: Column, t: Column) -> Column:
    """(title, confidence 0.85): the block that may be a title under a template with the best score, the first of equals; null if none.

    ``blocks``: array of structs with text and font_size.
    """
    stripped = F.transform(F.coalesce(blocks, F.array()), lambda b, i: F.struct(strip(b["text"]).alias("text"), F.coalesce(b["font_size"], F.lit(0.0)).cast("double").alias("size"), i.alias("i")))
    scored = F.transform(F.filter(stripped, lambda b: candidate_ok(b["text"], t)), lambda b: F.struct(block_score(b["text"], b["size"]).alias("score"), (-b["i"]).alias("i"), b["text"].alias("text")))
    return F.when(F.size(scored) > 0, F.struct(F.array_max(scored)["text"].alias("title"), F.lit(0.85).alias("confidence")))


def apply_template(text: Column, t: Column, blocks: Column | None = None) -> Column:
    """(title, confidence): the best block if there are blocks, else the first line with a keyword (0.75), else the first line that may be a title (0.65)."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: candidate_ok(x, t))
    keyed = F.filter(lines, _keyed)
    by_line = (
        F.when(F.size(keyed) > 0, F.struct(F.get(keyed, F.lit(0)).alias("title"), F.lit(0.75).alias("confidence")))
        .when(F.size(lines) > 0, F.struct(F.get(lines, F.lit(0)).alias("title"), F.lit(0.65).alias("confidence")))
    )
    return by_line if blocks is None else F.coalesce(apply_to_blocks(blocks, t), by_line)


def keyword_line(text: Column) -> Column:
    """The first line of eight characters or more with a quality keyword."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) >= 8) & F.upper(x).rlike("|".join(fixed.QUALITY_KEYWORDS)))
    return F.get(lines, F.lit(0))


def neighbour_base(d: DataFrame) -> DataFrame:
    """Adds base (0.80 if the pages before and after succeeded, 0.70 if one did, else null) and, where there is a title_method, reference_method.

    Neighbours are the rows of the exact page numbers. Each successful row
    is counted for both its neighbours in one aggregate and joined back, so a
    gap in page numbers never matches. The reference method is that of the
    more confident neighbour, of equal ones that of the page before.
    """
    with_method = "title_method" in d.columns and "title_confidence" in d.columns
    good = d.where((F.coalesce("needs_review", F.lit(0)) != 1) & (F.coalesce("sheet_title", F.lit("")) != ""))
    good = good.select("pdf_filename", "page_number", *(["title_method", "title_confidence"] if with_method else [])).dropDuplicates(["pdf_filename", "page_number"])
    side = F.explode(F.array(*[F.struct((F.col("page_number") + k).alias("page"), F.lit(k).alias("side")) for k in (-1, 1)]))
    near = good.withColumn("_to", side).groupBy("pdf_filename", F.col("_to.page").alias("page_number"))
    near = near.agg(F.count("*").alias("_near"), *([F.max_by("title_method", F.struct(F.coalesce("title_confidence", F.lit(0.0)), "_to.side")).alias("reference_method")] if with_method else []))
    return d.join(near, ["pdf_filename", "page_number"], "left").withColumn("base", F.when(F.col("_near") == 2, 0.80).when(F.col("_near") == 1, 0.70)).drop("_near")


def _with_templates(d: DataFrame, templates: DataFrame) -> DataFrame:
    t = templates.select("pdf_filename", F.struct(*[c for c in templates.columns if c != "pdf_filename"]).alias("_t"))
    return d.join(t, "pdf_filename", "left")


def sibling_inference(d: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Adds inferred (title, confidence) for rows whose neighbours succeeded; null for the others.

    With a template of its PDF a row's title has the lesser of the
    neighbours' base and the template's confidence, else the first line with
    a keyword has 0.8 times the base.
    """
    d = neighbour_base(d)
    d = _with_templates(d, templates) if templates is not None else d.withColumn("_t", F.lit(None))
    made = F.lit(None)
    if templates is not None:
        a = apply_template(F.col("text"), F.col("_t"), F.col("blocks") if "blocks" in d.columns else None)
        d = d.withColumn("_a", F.when(F.col("_t").isNotNull(), a))
        made = F.when(F.col("_a").isNotNull(), F.struct(F.col("_a.title").alias("title"), F.least("base", "_a.confidence").alias("confidence")))
    line = keyword_line(F.col("text"))
    by_line = F.when(line.isNotNull(), F.struct(line.alias("title"), (F.col("base") * 0.8).alias("confidence")))
    return d.withColumn("inferred", F.when(F.col("base").isNotNull(), F.coalesce(made, by_line))).drop("_t", "_a")


def rescue(d: DataFrame, templates: DataFrame) -> DataFrame:
    """Titles for failed rows from the template, else from neighbours; accepted from 0.60, review cleared from 0.80.

    One pass over a snapshot: rescued rows don't count as good neighbours of
    later ones.
    """
    failed = (F.col("needs_review") == 1) | (F.coalesce(F.trim("sheet_title"), F.lit("")) == "")
    blocks = F.col("blocks") if "blocks" in d.columns else None
    d = _with_templates(neighbour_base(d), templates).withColumn("_a", F.when(failed & F.col("_t").isNotNull(), apply_template(F.col("text"), F.col("_t"), blocks)))
    d = d.withColumn("_line", F.when(failed & F.col("base").isNotNull(), keyword_line(F.col("text"))))
    got = (
        F.when(F.col("_a").isNotNull(), F.struct(F.col("_a.title").alias("title"), F.col("_a.confidence").alias("confidence"), F.lit("template").alias("method")))
        .when(F.col("_line").isNotNull(), F.struct(F.col("_line").alias("title"), (F.col("base") * 0.8).alias("confidence"), F.lit("sibling_inference").alias("method")))
    )
    d = d.withColumn("_got", F.when(failed, got)).withColumn("_ok", F.coalesce(F.col("_got.confidence") >= 0.60, F.lit(False)))
    return d.withColumns({
        "sheet_title": F.when(F.col("_ok"), F.col("_got.title")).otherwise(F.col("sheet_title")),
        "title_confidence": F.when(F.col("_ok"), F.col("_got.confidence")).otherwise(F.col("title_confidence")),
        "rescued_by": F.when(F.col("_ok"), F.col("_got.method")),
        "needs_review": F.when(F.col("_ok") & (F.col("_got.confidence") >= 0.80), 0).otherwise(F.col("needs_review")),
    }).drop("_t", "_a", "_line", "_got", "_ok", "base", "reference_method")


def project_fallback(d: DataFrame, share: float = 0.6) -> DataFrame:
    """Fills missing project numbers with the PDF's most common one if at least ``share`` of the numbered rows have it.

    Ties go to the number seen first. Counts combine before the shuffle; one
    row a PDF is joined back.
    """
    counts = d.where(strip(F.col("project_number")) != "").groupBy("pdf_filename", "project_number").agg(F.count("*").alias("n"), F.min("page_number").alias("first"))
    best = counts.groupBy("pdf_filename").agg(F.max_by("project_number", F.struct("n", -F.col("first"))).alias("_best"), F.max("n").alias("_n"), F.sum("n").alias("_all"))
    best = best.where(F.col("_n") / F.col("_all") >= share).select("pdf_filename", "_best")
    return d.join(best, "pdf_filename", "left").withColumn("project_number", F.coalesce(F.nullif(strip(F.col("project_number")), F.lit("")), F.col("_best"))).drop("_best")


def identified(templates: DataFrame, hashes: DataFrame) -> DataFrame:
    """Templates with template_id, pdf_hash (from (pdf_filename, pdf_hash)), source_pdf and created_at; ids and times are new in each run."""
    t = templates.join(hashes.select("pdf_filename", "pdf_hash"), "pdf_filename", "left")
    return t.withColumns({"template_id": F.uuid(), "source_pdf": F.col("pdf_filename"), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
