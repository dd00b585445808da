"""Readers of the document model's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "page int, page_number int, sheet_number string, sheet_title string, number_conf double, title_conf double, number_confidence double, title_confidence double, crop_file string, error string"
EXTRACTION = f"extraction_completed string, sheets array<struct<pdf_filename:string,{','.join(':'.join(x.split()) for x in _PAGE.split(', '))}>>, results array<struct<pdf:string,pages:array<struct<{','.join(':'.join(x.split()) for x in _PAGE.split(', '))}>>>>"
CORRECTIONS = "pdf_filename string, page_number string, pdf_hash string, sheet_number string, extracted_title string, confidence string, method string, needs_review string, review_reason string, suggested_title string, corrected_title string"
TRUTH = "pdf_filename string, page_number string, sheet_number string, sheet_title string, date string, project_name string, confidence string, api_success string, error string"
TEMPLATE = (
    "template_id string, pdf_hash string, source_pdf string, created_at string, pages_analyzed int, quality_pages_used int, confidence double, title_block_bbox array<double>, "
    "title_zone_bbox array<double>, exclusion_patterns array<string>, typical_length_min int, typical_length_max int, vector_pages int, scanned_pages int"
)


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder, not below it: path, pdf_filename, pdf_hash (16 hex digits), length and content."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("pdf_filename"), F.substring(F.sha2("content", 256), 1, 16).alias("pdf_hash"), "length", "content")


def without_samples(files: DataFrame) -> DataFrame:
    """Without five-page samples whose full file is there too."""
    full = files.select(F.col("pdf_filename").alias("_full"))
    name = F.regexp_replace("pdf_filename", r"_5pages(?=\.|_|$)", "")
    return files.withColumn("_full", F.when(name != F.col("pdf_filename"), name)).join(full, "_full", "left_anti").drop("_full")


def read_extraction(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results in either layout: pdf_filename, page_number, sheet_number, sheet_title, number_confidence, title_confidence. Grouped results go before flat sheets."""
    d = spark.read.schema(EXTRACTION).option("multiLine", True).json(path)
    old = d.where(F.col("results").isNotNull()).select(F.explode("results").alias("r")).select(F.col("r.pdf").alias("pdf_filename"), F.explode("r.pages").alias("p"))
    new = d.where(F.col("results").isNull()).select(F.explode("sheets").alias("p")).select(F.col("p.pdf_filename").alias("pdf_filename"), "p")
    out = lambda x: x.select(
        "pdf_filename", F.coalesce("p.page_number", "p.page").alias("page_number"), "p.sheet_number", "p.sheet_title",
        F.coalesce("p.number_conf", "p.number_confidence", F.lit(0.0)).alias("number_confidence"), F.coalesce("p.title_conf", "p.title_confidence", F.lit(0.0)).alias("title_confidence"),
    )
    return out(old).unionByName(out(new))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a review file whose corrected title isn't blank."""
    d = spark.read.schema(CORRECTIONS).option("header", True).option("multiLine", True).csv(path)
    d = d.where(F.coalesce(F.trim("corrected_title"), F.lit("")) != "")
    return d.withColumn("page_number", F.expr("try_cast(page_number as int)")).withColumn("corrected_title", F.trim("corrected_title"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth rows with both keys; of repeated keys the last in file order wins."""
    d = spark.read.schema(TRUTH).option("header", True).csv(path).withColumn("_ord", F.monotonically_increasing_id())
    d = d.withColumn("page_number", F.expr("try_cast(page_number as int)")).where("pdf_filename is not null and page_number is not null")
    rest = [c for c in d.columns if c not in ("pdf_filename", "page_number", "_ord")]
    return d.groupBy("pdf_filename", "page_number").agg(F.max_by(F.struct(*rest), "_ord").alias("r")).select("pdf_filename", "page_number", "r.*")


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected values: (pdf_filename, page_number, sheet_number, project_number, sheet_title, is_cover_sheet)."""
    kind = "map<string,map<string,struct<sheet_number:string,project_number:string,sheet_title:string,is_cover_sheet:boolean>>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("pdf_filename", "pages"))
    return d.select("pdf_filename", F.explode("pages").alias("page", "v")).select("pdf_filename", F.expr("try_cast(page as int)").alias("page_number"), "v.*")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of a folder, one file each; damaged files are left out."""
    d = spark.read.schema(TEMPLATE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    return d.where("pdf_hash is not null").drop("_corrupt_record")


def read_discoveries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Cached title block descriptions of a folder, one file each, with their pdf_hash; damaged files are left out."""
    d = spark.read.schema(f"pdf_hash string, {schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    return d.where("pdf_hash is not null").drop("_corrupt_record")


def settings(text: str, given: dict[str, str]) -> dict[str, str]:
    """Settings of a key=value text beside those given, which it doesn't replace; comments and blank lines count for nothing, quotes around a value go."""
    out = dict(given)
    for line in text.splitlines():
        key, found, value = line.strip().removeprefix("export ").partition("=")
        if found and key.strip() and not key.lstrip().startswith("#"):
            value = value.strip()
            out.setdefault(key.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value)
    return out
