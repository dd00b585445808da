"""Content of pages, project names, source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_project
from ..rules import fixed
from ..rules.build import matches_any


def indicators(text: Column) -> Column:
    """Names of the painting indicators that a text shows, in order."""
    return F.array_compact(F.array(*[F.when(matches_any(text, p), F.lit(n)) for n, _, p in fixed.PAINTING_INDICATORS]))


def content_relevance(found: Column) -> Column:
    """(relevance, confidence) by how many primary and secondary indicators there are."""
    names = lambda level: [n for n, r, _ in fixed.PAINTING_INDICATORS if r == level]
    p = F.size(F.filter(found, lambda x: x.isin(names("PRIMARY"))))
    s = F.size(F.filter(found, lambda x: x.isin(names("SECONDARY"))))
    out = lambda r, c: F.struct(F.lit(r).alias("relevance"), c.cast("double").alias("confidence"))
    return (
        F.when(p >= 2, out("PRIMARY", F.least(F.lit(0.95), 0.70 + 0.10 * p))).when(p >= 1, out("PRIMARY", 0.75 + 0.05 * s))
        .when(s >= 2, out("SECONDARY", 0.70 + 0.05 * s)).when(s >= 1, out("SECONDARY", F.lit(0.60))).otherwise(out("REFERENCE", F.lit(0.50)))
    )


def content_category(found: Column) -> Column:
    has = lambda n: F.array_contains(found, n)
    return (
        F.when(has("ceiling_grid"), "reflected_ceiling_plans").when(has("room_numbers") & has("finish_callouts"), "room_finish_schedules")
        .when(has("elevation_markers"), "interior_elevations").when(has("room_numbers"), "floor_plans").when(has("door_tags"), "door_schedules").otherwise("floor_plans")
    )


def valid_project_name(name: Column) -> Column:
    return F.coalesce(F.length(name).between(3, 100) & ~matches_any(name, fixed.NON_PROJECT_PATTERNS), F.lit(False))


def canonical_names(rows: DataFrame) -> DataFrame:
    """(pdf_filename, name): each PDF's most common valid project name, an all-capital spelling first, else in capitals.

    ``rows``: pdf_filename, ord, project_name. Ties go to what comes first.
    """
    d = rows.where(valid_project_name(F.col("project_name"))).withColumn("norm", normal_project(F.col("project_name"))).where("norm <> ''")
    shout = (F.upper("project_name") == F.col("project_name")) & (F.lower("project_name") != F.col("project_name"))
    by = d.groupBy("pdf_filename", "norm").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.min(F.when(shout, F.struct("ord", "project_name"))).alias("caps"), F.min(F.struct("ord", "project_name")).alias("any"),
    )
    best = by.groupBy("pdf_filename").agg(F.max_by(F.struct("caps", "any"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("pdf_filename", F.coalesce("b.caps.project_name", F.upper("b.any.project_name")).alias("name"))


def normal_name(x: Column) -> Column:
    """A file name without its extension, in lower case, with single blanks for underscores and hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\.pdf$", ""), r"[_\-\s]+", " "))


def source_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """(pdf_name, path): the file of each name, exact, with its extension, else by equal or opening 25 characters.

    Openings meet by equality of the first 25 characters, and of whole names
    shorter than that by their length, so names and files are joined on
    keys, never crossed.
    """
    f = files.select("path", "file", "ord", normal_name(F.col("file")).alias("fn"))
    n = names.select("pdf_name", normal_name(F.col("pdf_name")).alias("nn"), F.array_distinct(F.array("pdf_name", F.concat("pdf_name", F.lit(".pdf")))).alias("tries"))
    exact = n.select("pdf_name", F.posexplode("tries").alias("rank", "file")).join(f, "file").select("pdf_name", "rank", "ord", "path")
    # either opening may be the shorter: key by each length up to 25 that occurs on the other side
    opening = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(25))), lambda i: F.substring(c, 1, 25).substr(F.lit(1), i))
    a = n.select("pdf_name", F.substring("nn", 1, 25).alias("key")).join(f.select("path", "ord", F.explode(F.array_distinct(opening(F.col("fn")))).alias("key")), "key")
    b = n.select("pdf_name", F.explode(F.array_distinct(opening(F.col("nn")))).alias("key")).join(f.select("path", "ord", F.substring("fn", 1, 25).alias("key")), "key")
    loose = a.unionByName(b).select("pdf_name", F.lit(2).alias("rank"), "ord", "path")
    return exact.unionByName(loose).groupBy("pdf_name").agg(F.min(F.struct("rank", "ord", "path")).alias("m")).select("pdf_name", F.col("m.path").alias("path"))


def crop_files(sheets: DataFrame, crops: DataFrame) -> DataFrame:
    """Sheets with their crop, by the first eight characters of the hash and the page in the crop's name."""
    c = crops.select(F.col("path").alias("crop"), F.regexp_extract("path", r"([0-9a-f]{8})/p(\d+)_", 1).alias("_h"), F.regexp_extract("path", r"([0-9a-f]{8})/p(\d+)_", 2).cast("int").alias("_p"))
    return sheets.join(c, (F.substring("pdf_hash", 1, 8) == F.col("_h")) & (F.col("page_number") == F.col("_p"))).drop("_h", "_p")
