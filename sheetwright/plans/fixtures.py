"""Relations of the document model built from the given tables.

Only integer arithmetic and fixed lists are used, so that SQL builds the same
rows. ``SHEETS_SQL`` and the others are the DuckDB definitions as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TITLES = [
    "First Floor Plan", "Reflected Ceiling Plan", "Exterior Elevations", "Room Finish Schedule", "FLOOR PLAN AND REFLECTED CEILING PLAN",
    "Foundation Plan", "Mechanical Plan", "Cover Sheet", "Plan", "1425", "Smith LLC",
]
LETTERS = "AAIASMEPCLGFTQX"


def _pick(key: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each order: pdf_filename, page_number, sheet_number, sheet_title, title_confidence, needs_review and o_orderkey."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"))
    k = F.col("o_orderkey")
    number = F.concat(
        _pick(k, list(LETTERS)), F.pmod(F.floor(k / 15), F.lit(7)).cast("string"), F.lpad(F.pmod(F.floor(k / 105), F.lit(40)).cast("string"), 2, "0")
    )
    pdf = F.concat(F.lit("set_"), F.lpad(F.pmod(F.col("o_custkey"), F.lit(40)).cast("string"), 2, "0"), F.lit(".pdf"))
    return (
        o.withColumn("pdf_filename", pdf)
        .withColumn("page_number", F.row_number().over(Window.partitionBy("pdf_filename").orderBy("o_orderkey")))
        .withColumn("sheet_number", F.when(F.pmod(k, F.lit(11)) != 0, number))
        .withColumn("sheet_title", _pick(k, [*TITLES, None]))
        .withColumn("title_confidence", F.pmod(k, F.lit(101)).cast("double") / 100)
        .withColumn("needs_review", F.when(F.pmod(k, F.lit(7)) == 0, 1).otherwise(0))
        .select("o_orderkey", "pdf_filename", "page_number", "sheet_number", "sheet_title", "title_confidence", "needs_review")
    )


_LIST = ", ".join("'" + t + "'" for t in TITLES) + ", NULL"
SHEETS_SQL = f"""sheets AS (
  SELECT o_orderkey, 'set_' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') || '.pdf' AS pdf_filename,
         CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INTEGER) AS page_number,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE substr('{LETTERS}', CAST(o_orderkey % 15 AS INTEGER) + 1, 1) || ((o_orderkey // 15) % 7) || lpad(CAST((o_orderkey // 105) % 40 AS VARCHAR), 2, '0') END AS sheet_number,
         [{_LIST}][CAST(o_orderkey % 12 AS INTEGER) + 1] AS sheet_title,
         CAST(o_orderkey % 101 AS DOUBLE) / 100 AS title_confidence,
         CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS needs_review
  FROM orders)"""


def sheet_text(s: DataFrame) -> DataFrame:
    """Adds ``text``: the sheet number behind one of several labels, alone on a line, or not at all."""
    n, k = F.coalesce(F.col("sheet_number"), F.lit("")), F.col("o_orderkey")
    t = F.coalesce(F.col("sheet_title"), F.lit(""))
    kinds = [
        F.concat(F.lit("PROJECT DATA\nSHEET NUMBER: "), n, F.lit("\nTITLE: "), t),
        F.concat(F.lit("notes\nSHEET NO: "), n, F.lit("\nmore notes")),
        F.concat(F.lit("DRAWING NO\n"), n, F.lit("\n"), t),
        F.concat(t, F.lit("\n"), n),
        F.concat(F.lit("general requirements\n"), t),
    ]
    out = kinds[-1]
    for i, x in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(F.pmod(k, F.lit(5)) == i, x).otherwise(out)
    return s.withColumn("text", out)


def index_entries(s: DataFrame) -> DataFrame:
    """(pdf_filename, sheet_number, title, ord): a drawing index of each set, every fifth number left out, every seventh spelled with a hyphen."""
    d = s.where(F.col("sheet_number").isNotNull()).groupBy("pdf_filename", "sheet_number").agg(F.min("o_orderkey").alias("ord"))
    d = d.where(F.pmod("ord", F.lit(5)) != 0)
    spelled = F.when(F.pmod("ord", F.lit(7)) == 0, F.concat(F.substring("sheet_number", 1, 1), F.lit("-"), F.substring("sheet_number", 2, 10))).otherwise(F.col("sheet_number"))
    return d.select("pdf_filename", spelled.alias("sheet_number"), _pick(F.col("ord"), [t.upper() for t in TITLES[:8]]).alias("title"), "ord")


_INDEX = ", ".join("'" + t.upper() + "'" for t in TITLES[:8])
INDEX_SQL = f"""entries AS (
  SELECT pdf_filename, CASE WHEN ord % 7 = 0 THEN substr(sheet_number, 1, 1) || '-' || substr(sheet_number, 2) ELSE sheet_number END AS sheet_number,
         [{_INDEX}][CAST(ord % 8 AS INTEGER) + 1] AS title, ord
  FROM (SELECT pdf_filename, sheet_number, min(o_orderkey) AS ord FROM sheets WHERE sheet_number IS NOT NULL GROUP BY ALL) WHERE ord % 5 <> 0)"""


def ground_truth(s: DataFrame) -> DataFrame:
    """Expected values: every ninth number altered, every tenth title missing, every 13th row left out."""
    k = F.col("o_orderkey")
    return s.where(F.pmod(k, F.lit(13)) != 0).select(
        "pdf_filename", "page_number",
        F.when(F.pmod(k, F.lit(9)) == 0, F.concat(F.col("sheet_number"), F.lit("X"))).otherwise(F.col("sheet_number")).alias("true_number"),
        F.when(F.pmod(k, F.lit(10)) != 0, F.col("sheet_title")).alias("true_title"),
    )


TRUTH_SQL = """truth AS (
  SELECT pdf_filename, page_number, CASE WHEN o_orderkey % 9 = 0 THEN sheet_number || 'X' ELSE sheet_number END AS true_number,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE sheet_title END AS true_title
  FROM sheets WHERE o_orderkey % 13 <> 0)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of a 2592 by 1728 page for each order: pos, text and box from line items' keys; every third is a label."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        k.cast("long").alias("page"), F.col("l_linenumber").cast("int").alias("pos"),
        F.pmod(p * 37, F.lit(2592)).cast("double").alias("x0"), F.pmod(p * 53 + F.col("l_suppkey"), F.lit(1728)).cast("double").alias("y0"),
        F.when(F.pmod(p, F.lit(3)) == 0, F.lit("SHEET NO")).otherwise(F.concat(_pick(p, list(LETTERS)), F.lpad(F.pmod(p, F.lit(1000)).cast("string"), 3, "0"))).alias("text"),
    )


BLOCKS_SQL = f"""blocks AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS INTEGER) AS pos, CAST((l_partkey * 37) % 2592 AS DOUBLE) AS x0,
         CAST((l_partkey * 53 + l_suppkey) % 1728 AS DOUBLE) AS y0,
         CASE WHEN l_partkey % 3 = 0 THEN 'SHEET NO' ELSE substr('{LETTERS}', CAST(l_partkey % 15 AS INTEGER) + 1, 1) || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') END AS text
  FROM lineitem)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profiles: (vec_id, x, v) from embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.posexplode("embedding").alias("x", "v")).select("vec_id", "x", F.round(F.col("v").cast("double"), 4).alias("v"))


PROFILE_SQL = """profile AS (
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS x, round(CAST(embedding[i] AS DOUBLE), 4) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
