"""The human review loop: queue, statistics, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import review_priority


def review_queue(classified: DataFrame) -> DataFrame:
    """Sheets to look at with their priority: those flagged, else those of low confidence."""
    low = F.col("confidence") < 0.70
    d = classified.where(F.col("needs_review") | low)
    return d.withColumn("priority", F.when(F.col("needs_review"), review_priority(F.col("is_combo"), F.col("confidence"), F.col("has_conflict"), F.col("categories"))).when(F.col("confidence") < 0.50, 2).otherwise(1))


def queue_statistics(queue: DataFrame) -> DataFrame:
    """total, pending, reviewed and pending by priority, in one row."""
    pending = ~F.col("reviewed")
    return queue.agg(
        F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if("reviewed").alias("reviewed"),
        *[F.count_if(pending & (F.col("priority") == p)).alias(f"priority_{p}") for p in (2, 1, 0)],
    )


def decision_changes(reviewed: DataFrame) -> DataFrame:
    """(change, n) of reviewed items whose human decision differs."""
    d = reviewed.where(F.col("reviewed") & F.col("human_decision").isNotNull() & ~F.col("decision").eqNullSafe(F.col("human_decision")))
    return d.groupBy(F.concat("decision", F.lit(" -> "), "human_decision").alias("change")).agg(F.count("*").alias("n"))


def suggested_words(corrections: DataFrame, share: float = 0.6) -> DataFrame:
    """(category, words, titles) of words in 60 % or more of a category's corrected titles, two titles at least.

    ``corrections``: category, title. Occurrences count, not distinct titles.
    """
    titles = corrections.groupBy("category").agg(F.count("*").alias("titles")).where("titles >= 2")
    word = F.explode(F.split(F.upper("title"), r"\s+"))
    words = corrections.select("category", word.alias("w")).withColumn("w", F.regexp_replace("w", "[^A-Z0-9]", "")).where(F.length("w") >= 3)
    counts = words.groupBy("category", "w").agg(F.count("*").alias("n")).join(titles, "category").where(F.col("n") >= F.col("titles") * F.lit(float(share)))
    return counts.groupBy("category", "titles").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("words"))


def top_candidates(d: DataFrame, key: str, score: str, order: str, k: int = 5) -> DataFrame:
    """The k best rows of each key, ties by order. Ranks are limited before rows meet."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A queue's columns besides the sheet's own: ord is the order of arrival.
QUEUE = "ord long, sheet_number string, sheet_title string, decision string, categories array<string>, review_reason string, priority int, reviewed boolean, human_decision string, human_categories array<string>, human_notes string"


def add_items(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with more items (ord, sheet_number, sheet_title, decision, categories, review_reason, priority), not reviewed yet."""
    return queue.unionByName(items.withColumn("reviewed", F.lit(False)), allowMissingColumns=True)


def mark_reviewed(queue: DataFrame, marks: DataFrame) -> DataFrame:
    """Sets what a human decided, by ord: (ord, human_decision, human_categories, human_notes). Items stay in the queue."""
    given = ["human_decision", "human_categories", "human_notes"]
    m = marks.select("ord", F.struct(*given).alias("_m"))
    j = queue.join(m, "ord", "left")
    hit = F.col("_m").isNotNull()
    new = {c: F.when(hit, F.col(f"_m.{c}")).otherwise(F.col(c)) for c in given} | {"reviewed": hit | F.col("reviewed")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def pending(queue: DataFrame, priority: int | None = None) -> DataFrame:
    """Items that wait, of one priority if given, by priority and then in order of arrival."""
    d = queue.where(~F.col("reviewed"))
    d = d if priority is None else d.where(F.col("priority") == priority)
    return d.orderBy(F.col("priority").desc(), "ord")


def next_item(queue: DataFrame) -> DataFrame:
    """The item to review next, or none."""
    return pending(queue).limit(1)


def corrections_of(queue: DataFrame) -> DataFrame:
    """Reviewed items whose human decision differs: number, title, both decisions and categories, notes."""
    d = queue.where(F.col("reviewed") & (F.coalesce("human_decision", F.lit("")) != "") & ~F.col("decision").eqNullSafe(F.col("human_decision")))
    return d.select("ord", "sheet_number", "sheet_title", F.col("decision").alias("original_decision"), "human_decision", F.col("categories").alias("original_categories"), "human_categories", F.col("human_notes").alias("notes"))


def category_titles(corrections: DataFrame, examples: int = 3) -> DataFrame:
    """(category, titles, examples): how many corrected titles each human category has, and the first few in order of arrival.

    Titles of a category are never gathered: ranks are limited first.
    """
    d = corrections.where(F.coalesce("sheet_title", F.lit("")) != "").select(F.explode("human_categories").alias("category"), "ord", "sheet_title")
    counts = d.groupBy("category").agg(F.count("*").alias("titles"))
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).where(F.col("r") <= examples)
    first = first.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "sheet_title"))), lambda x: x["sheet_title"]).alias("examples"))
    return counts.join(first, "category")


def save_queue(queue: DataFrame, path: str) -> None:
    """Writes a queue as JSON lines."""
    queue.write.mode("overwrite").json(path)


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """A queue that :func:`save_queue` wrote."""
    return spark.read.schema(QUEUE).json(path)
