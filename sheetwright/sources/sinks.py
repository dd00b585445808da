"""Writers and report shapes."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import review_reason
from ..functions.text import safe_filename
from ..operators.accuracy import run_summary
from ..operators.classify import bucketed, legacy_type
from ..rules.build import categories
from ..rules.fixed import NOT_NEEDED


def review_csv(d: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of the review file in its eleven columns: those to review first, then the rest, each in the order of the input.

    ``order`` names the column that holds that order (else set and page).
    The index title, where there is one, is suggested; the corrected title is left blank.
    """
    col = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    text_ = lambda c: F.coalesce(col(c), F.lit(""))
    review = F.coalesce(F.col("needs_review"), F.lit(0)) == 1
    reason = review_reason(F.coalesce(F.col("xref_conflict"), F.lit(False)) if "xref_conflict" in d.columns else F.lit(False), F.col("title_confidence"), F.col("sheet_title"), col("title_method"))
    rows = d.withColumn("_review", review).orderBy(F.col("_review").desc(), *([order] if order else ["pdf_filename", "page_number"]))
    return rows.select(
        "pdf_filename", "page_number", text_("pdf_hash").alias("pdf_hash"), text_("sheet_number").alias("sheet_number"), text_("sheet_title").alias("extracted_title"),
        F.format_string("%.2f", F.coalesce("title_confidence", F.lit(0.0))).alias("confidence"), text_("title_method").alias("method"), F.when(F.col("_review"), "YES").otherwise("NO").alias("needs_review"),
        reason.alias("review_reason"), text_("index_title").alias("suggested_title"), F.lit("").alias("corrected_title"),
    )


def review_counts(d: DataFrame) -> DataFrame:
    """What the review report shows above its rows, in one row: total, to review, and counts by method."""
    m = F.coalesce("title_method", F.lit("failed"))
    m = F.when(m == "drawing_index_xref", "drawing_index").otherwise(m)
    named = ("drawing_index", "spatial", "vision_api", "pattern", "failed")
    return d.agg(F.count("*").alias("total"), F.count_if(F.coalesce("needs_review", F.lit(0)) == 1).alias("review"), *[F.count_if(m == x).alias(x) for x in named])


def review_html(counts: dict[str, int], rows: list[dict], title: str = "Review") -> str:
    """The review report: counts, a bar of methods, and a table of the rows given (a page of them, not all)."""
    e = lambda x: html.escape("" if x is None else str(x))
    total = max(1, counts["total"])
    bar = "".join(f'<span class="{e(k)}" style="width:{100 * counts[k] / total:.1f}%">{e(k)} {counts[k]}</span>' for k in counts if k not in ("total", "review") and counts[k])
    columns = ("pdf_filename", "page_number", "sheet_number", "extracted_title", "confidence", "method", "review_reason", "suggested_title")
    head = "".join(f"<th>{c.replace('_', ' ')}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{e(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{e(title)}</title><h1>{e(title)}</h1><p>{counts['review']} of {counts['total']} sheets to review</p><div>{bar}</div><table><tr>{head}</tr>{body}</table>"


def classification_csv(classified: DataFrame) -> DataFrame:
    """The classification file's fourteen columns: one row for each sheet and bucket, in order of set and page."""
    d = legacy_type(bucketed(classified))
    col = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("double")
    shown = lambda x: F.when(F.coalesce(x, F.lit(0.0)) != 0, F.format_string("%.3f", x)).otherwise("")
    return d.orderBy(F.coalesce("pdf_filename", F.lit("")), F.coalesce("page_number", F.lit(0)), "category").select(
        F.col("pdf_filename").alias("pdf_name"), "page_number", "sheet_number", "sheet_title", "decision", "relevance", F.array_join("categories", ";").alias("categories"),
        F.col("classification").alias("classification_type"), shown(F.col("confidence")).alias("classification_confidence"), shown(col("number_confidence")).alias("number_confidence"),
        shown(col("title_confidence")).alias("title_confidence"), F.col("is_combo").alias("is_combo_page"), "needs_review", F.coalesce("review_reason", F.lit("")).alias("review_reason"),
    )


def manifest(classified: DataFrame) -> DataFrame:
    """(category, pdf_filename, pages): the sheets of each bucket and set; written partitioned by category."""
    entry = F.struct("page_number", "sheet_number", "sheet_title")
    return bucketed(classified).groupBy("category", "pdf_filename").agg(F.sort_array(F.collect_list(entry)).alias("pages"))


def master_manifest(classified: DataFrame) -> DataFrame:
    """(category, count, description, folder) of every bucket, empty ones too; a few rows."""
    known = [(k, v.get("description", ""), v.get("folder")) for k, v in {**categories(), NOT_NEEDED: {}}.items()]
    names = classified.sparkSession.createDataFrame(known, "category string, description string, folder string")
    counts = bucketed(classified).groupBy("category").agg(F.count("*").alias("count"))
    return names.join(counts, "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("count"), "description", "folder")


def save_manifests(classified: DataFrame, path: str) -> None:
    """Writes the master manifest and those of the buckets that have sheets, as JSON lines."""
    master_manifest(classified).coalesce(1).write.mode("overwrite").json(f"{path}/master")
    manifest(classified).write.mode("overwrite").partitionBy("category").json(f"{path}/categories")


def run_report(d: DataFrame, path: str) -> dict[str, int]:
    """Writes a run's summary and its sheets as JSON; returns the summary."""
    summary = run_summary(d)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    d.write.mode("overwrite").json(f"{path}/sheets")
    return summary.first().asDict()


def full_test_summary(d: DataFrame) -> DataFrame:
    """(pdf_filename, pages, titles, numbers, to_review, mean_confidence): a full test's summary file, by set."""
    has = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) != "")
    return d.groupBy("pdf_filename").agg(
        F.count("*").alias("pages"), has("sheet_title").alias("titles"), has("sheet_number").alias("numbers"), F.count_if(F.coalesce("needs_review", F.lit(0)) == 1).alias("to_review"),
        F.round(F.avg(F.coalesce("title_confidence", F.lit(0.0))), 6).alias("mean_confidence"))


#: Columns of the ground truth file.
TRUTH_COLUMNS = ("pdf_filename", "page_number", "sheet_number", "sheet_title", "date", "project_name", "confidence", "api_success", "error")


def truth_rows(d: DataFrame) -> DataFrame:
    """Rows of the ground truth file: its columns, others left out, missing ones blank."""
    return d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in d.columns else F.lit("").alias(c) for c in TRUTH_COLUMNS])


def missing_titles(truth: DataFrame) -> DataFrame:
    """Rows of a ground truth file whose call went well but gave no title."""
    return truth.where((F.coalesce("sheet_title", F.lit("")) == "") & (F.col("api_success") == "True"))


def cleaned_truth(truth: DataFrame, names: DataFrame) -> DataFrame:
    """Ground truth with each set's canonical project name in place of what was read, where there is one."""
    n = names.select("pdf_filename", F.col("name").alias("_name"))
    return truth.join(n, "pdf_filename", "left").withColumn("project_name", F.coalesce("_name", "project_name")).drop("_name").select(*truth.columns)


def save_template(store: DataFrame, templates: DataFrame) -> DataFrame:
    """A new snapshot of a template store: those given replace those of their hash."""
    return store.join(templates.select("pdf_hash").distinct(), "pdf_hash", "left_anti").unionByName(templates.select(*store.columns))


def delete_template(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """A template or discovery store without some hashes."""
    return store.join(hashes.select("pdf_hash").distinct(), "pdf_hash", "left_anti")


def crop_name(pdf_hash: Column, page: Column) -> Column:
    """Where a page's title block is kept: under eight characters of the hash."""
    return F.concat(F.substring(pdf_hash, 1, 8), F.lit("/p"), F.lpad(page.cast("string"), 3, "0"), F.lit("_titleblock.png"))


def crop_copies(crops: DataFrame) -> DataFrame:
    """(path, target): flat names for crops, from their folder and name; of equal targets one copy."""
    name = F.concat_ws("_", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    return crops.select("path", safe_filename(name, 200).alias("target")).groupBy("target").agg(F.min("path").alias("path")).select("path", "target")


def organize_plan(classified: DataFrame) -> DataFrame:
    """Which page goes to which file: (pdf_filename, page_number, category, target). Categories without a folder are left out."""
    folders = {k: v["folder"] for k, v in categories().items() if v.get("folder")}
    d = bucketed(classified).where(F.col("category").isin(list(folders)))
    stem = F.regexp_replace("pdf_filename", r"(?i)\.pdf$", "")
    name = F.concat_ws("_", safe_filename(stem, 40), safe_filename(F.col("sheet_number"), 20), safe_filename(F.col("sheet_title"), 50))
    d = d.withColumn("target", F.concat("category", F.lit("/"), name, F.lit(".pdf")))
    return d.dropDuplicates(["pdf_filename", "page_number", "category"]).select("pdf_filename", "page_number", "category", "target")


def report_rows(d: DataFrame) -> DataFrame:
    """Rows of the page report: titles cut to 60 characters, a dash for nothing."""
    t = F.coalesce(F.nullif(F.trim("sheet_title"), F.lit("")), F.lit("-"))
    return d.select("pdf_filename", "page_number", F.coalesce("sheet_number", F.lit("-")).alias("sheet_number"), F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("..."))).otherwise(t).alias("title"))


def summary_html(summary: dict[str, int], title: str = "Extraction report") -> str:
    """A page with a run's few totals; rows stay in the cluster."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{v}</td></tr>" for k, v in summary.items())
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{rows}</table>"


def rate_limited(calls: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """Adds ``waits``: whether a call of (key, ts) has ``most`` calls of its key in the seconds before it."""
    w = Window.partitionBy("key").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return calls.withColumn("waits", F.count("*").over(w) > most)


def save_telemetry(d: DataFrame, path: str) -> None:
    """Writes what detectors and engines noted of each page, one folder a set, for looking into afterwards."""
    d.write.mode("overwrite").partitionBy("pdf_filename").json(path)
