"""The sheet store: keyed merges over Parquet snapshots, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import last_wins

KEY = ["pdf_filename", "page_number"]


def upsert(target: DataFrame, batch: DataFrame, order: str | None = None, key: list[str] = KEY) -> DataFrame:
    """A new snapshot: batch rows replace the columns that the batch has, other rows are added.

    Columns that only the target has keep their values, and are null for new
    rows. Of several batch rows of a key the last by ``order`` wins. One full
    outer join on the key; tables bucketed by the key join without a shuffle.
    """
    if order:
        batch = last_wins(batch, key, [order]).select(*[c for c in batch.columns if c != order])
    given = [c for c in batch.columns if c not in key]
    t = target.select(*key, F.struct(*[c for c in target.columns if c not in key]).alias("_t"))
    b = batch.select(*key, F.struct(*given, F.lit(True).alias("_in")).alias("_b"))
    joined = t.join(b, key, "full_outer")
    new = F.coalesce(F.col("_b._in"), F.lit(False))
    return joined.select(*key, *[F.when(new, F.col(f"_b.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) if c in given else F.col(f"_t.{c}").alias(c) for c in target.columns if c not in key])


def update_matched(target: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The target with the columns of ``changes`` where its key is in it; no rows are added."""
    given = [c for c in changes.columns if c not in key]
    c = changes.select(*key, F.struct(*given, F.lit(True).alias("_in")).alias("_c"))
    j = target.join(c, key, "left")
    return j.select(*[F.when(F.col("_c._in"), F.col(f"_c.{n}")).otherwise(F.col(n)).alias(n) if n in given else F.col(n) for n in target.columns])


def apply_corrections(target: DataFrame, corrections: DataFrame) -> DataFrame:
    """Sets the corrected title, confidence 1, method hitl_correction and no review for rows that exist, in the columns that the store has."""
    c = corrections.where(F.coalesce(F.trim("corrected_title"), F.lit("")) != "")
    new = {"sheet_title": F.trim("corrected_title"), "title_confidence": F.lit(1.0), "title_method": F.lit("hitl_correction"), "needs_review": F.lit(0)}
    if "updated_at" in target.columns:
        new["updated_at"] = F.current_timestamp()
    return update_matched(target, c.select(*KEY, *[v.alias(k) for k, v in new.items() if k in target.columns]))


def delete_keys(target: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    return target.join(keys.select(*key).distinct(), key, "left_anti")


#: The sheet store's columns; the key is kept unique by :func:`upsert`, the rest may be null.
SHEETS = (
    "id long, pdf_filename string, pdf_hash string, page_number int, sheet_number string, project_number string, sheet_title string, date string, scale string, discipline string, "
    "confidence string, extraction_method string, is_valid int, title_confidence double, title_method string, needs_review int, created_at timestamp, updated_at timestamp"
)
RUNS = "id string, pdf_path string, total_pages long, processed_pages long, success_count long, error_count long, status string, started_at timestamp, completed_at timestamp"


def create_store(spark: SparkSession, schema: str = SHEETS) -> DataFrame:
    """An empty store."""
    return spark.createDataFrame([], schema)


def upsert_stamped(target: DataFrame, batch: DataFrame, order: str | None = None, key: list[str] = KEY) -> DataFrame:
    """:func:`upsert` for a store with id, created_at and updated_at: new rows get an id above all others and both times, changed ones the second.

    Ids grow by task, so none is counted across tasks; they are unique, not dense.
    """
    now = F.current_timestamp()
    known = target.select(*key, F.lit(True).alias("_known"))
    most = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    batch = batch.drop("id", "created_at").withColumn("updated_at", now)
    out = upsert(target, batch, order, key).join(known, key, "left")
    fresh = F.col("_known").isNull()
    return out.withColumns({
        "id": F.when(fresh, F.lit(most + 1) + F.monotonically_increasing_id()).otherwise(F.col("id")),
        "created_at": F.when(fresh, F.col("updated_at")).otherwise(F.col("created_at")),
    }).select(*target.columns)


def all_sheets(store: DataFrame) -> DataFrame:
    """All rows in order of set and page."""
    return store.orderBy(*KEY)


def sheet(store: DataFrame, pdf: str, page: int) -> DataFrame:
    """The row of a key, or none; both values reach the scan as filters."""
    return store.where((F.col("pdf_filename") == pdf) & (F.col("page_number") == page))


def sheets_of(store: DataFrame, pdf: str) -> DataFrame:
    """A set's rows in order of pages."""
    return store.where(F.col("pdf_filename") == pdf).orderBy("page_number")


def run_status(errors: Column) -> Column:
    return F.when(errors == 0, "completed").otherwise("completed_with_errors")


def start_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Adds runs of (id, pdf_path, total_pages) that have just begun."""
    begun = new.select("id", "pdf_path", F.col("total_pages").cast("long").alias("total_pages"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"))
    zeros = {c: F.lit(0).cast("long") for c in ("processed_pages", "success_count", "error_count")}
    return runs.unionByName(begun.withColumns(zeros), allowMissingColumns=True)


def update_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Sets the counts (processed_pages, success_count, error_count) of runs by id."""
    return update_matched(runs, counts, ["id"])


def complete_runs(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Completes runs of ``id``: with or without errors, by their counts."""
    done = runs.join(ids.select("id").distinct(), "id", "left_semi").select("id", run_status(F.col("error_count")).alias("status"), F.current_timestamp().alias("completed_at"))
    return update_matched(runs, done, ["id"])


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` runs, newest first: a top-k per task, merged."""
    return runs.orderBy(F.col("started_at").desc()).limit(n)
