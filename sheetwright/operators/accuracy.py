"""Accuracy against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable, same_title

KEY = ["pdf_filename", "page_number"]


def compared(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Extracted rows with ground truth, and whether number and title are right."""
    j = truth.join(extracted.select(*KEY, "sheet_number", "sheet_title"), KEY)
    blank = lambda c: comparable(F.col(c)) == ""
    return j.select(
        *KEY, "sheet_number", "true_number", "sheet_title", "true_title",
        (comparable(F.col("sheet_number")) == comparable(F.col("true_number"))).alias("number_ok"),
        same_title(F.col("sheet_title"), F.col("true_title")).alias("title_ok"),
        (blank("sheet_number") & blank("true_number")).alias("number_both_null"),
        (blank("sheet_title") & blank("true_title")).alias("title_both_null"),
    )


def field_accuracy(c: DataFrame) -> DataFrame:
    """(field, correct, total, accuracy) in one pass; accuracy is null without rows."""
    one = c.agg(*[f(F.col(f"{x}_ok")).alias(f"{x}_{n}") for x in ("number", "title") for n, f in (("c", F.count_if), ("t", F.count))])
    rows = F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"{x}_c").alias("correct"), F.col(f"{x}_t").alias("total")) for x in ("number", "title")])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("accuracy", F.try_divide("correct", "total"))


def truth_metrics(c: DataFrame) -> DataFrame:
    return c.agg(
        F.count("*").alias("compared"), F.count_if(F.col("number_ok") & ~F.col("number_both_null")).alias("numbers_correct"),
        F.count_if("number_both_null").alias("numbers_both_null"), F.count_if(~F.col("number_ok")).alias("numbers_wrong"),
        F.count_if(F.col("title_ok") & ~F.col("title_both_null")).alias("titles_matching"), F.count_if("title_both_null").alias("titles_both_null"),
    )


def pdf_bands(c: DataFrame) -> DataFrame:
    """Each PDF's rate of right titles and its band."""
    d = c.groupBy("pdf_filename").agg(F.count_if("title_ok").alias("correct"), F.count("*").alias("total"))
    rate = F.col("correct") / F.col("total")
    return d.withColumn("band", F.when(rate >= 0.9, "good").when(rate >= 0.3, "partial").otherwise("poor"))


def run_summary(d: DataFrame) -> DataFrame:
    """Totals of a run in one row."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return d.agg(
        F.count_distinct("pdf_filename").alias("total_pdfs"), F.count("*").alias("total_pages"), F.count_if("is_valid").alias("success_count"),
        F.count_if(~F.col("is_valid")).alias("error_count"), F.count_if(blank("sheet_title")).alias("missing_sheet_titles"), F.count_if(blank("sheet_number")).alias("missing_sheet_numbers"),
    )


def method_counts(d: DataFrame) -> DataFrame:
    """(method, n) with index overrides as drawing_index and no method as failed."""
    m = F.when(F.col("title_method").isNull(), "failed").when(F.col("title_method") == "drawing_index_xref", "drawing_index").otherwise(F.col("title_method"))
    return d.groupBy(m.alias("method")).agg(F.count("*").alias("n"))


def success_rate(d: DataFrame) -> DataFrame:
    """(n, succeeded, rate): the share of rows with a title method; 0 without rows."""
    out = d.agg(F.count("*").alias("n"), F.count("title_method").alias("succeeded"))
    return out.withColumn("rate", F.coalesce(F.try_divide("succeeded", "n"), F.lit(0.0)))


def summary_lines(summary: dict[str, object], title: str = "Summary") -> list[str]:
    """A run's few totals as lines for a console."""
    width = max([len(k) for k in summary], default=0)
    return [title, "-" * len(title), *(f"{k.replace('_', ' '):<{width}}  {v}" for k, v in summary.items())]
