"""Three-tier classification of sheets.

Everything about a sheet follows from its number and titles, so signals are
kept as an array of the row, and sums add up in the order in which signals
arise; equal combinations are classified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import category_hint, parsed
from ..functions.text import strip
from ..functions.titles import title_components
from ..rules import fixed
from ..rules.build import any_of, categories, lookup, matches_any


def settled(d: DataFrame, *names: str) -> DataFrame:
    """The rows with the named columns computed once, before what follows.

    A one-row explode: filters and projections above refer to the columns'
    values and don't repeat their long expressions, which would grow with
    each step that uses them. It stays within the stage.
    """
    rest = [c for c in d.columns if c not in names]
    return d.select(*rest, F.explode(F.array(F.struct(*names))).alias("_settled")).select(*rest, *[F.col(f"_settled.{n}").alias(n) for n in names])


def matched_categories(text: Column, which: str = "title") -> Column:
    """Categories whose patterns a text matches, in order."""
    found = [F.when(text.rlike(any_of(c[which])), F.lit(name)) for name, c in categories().items() if c[which]]
    return F.array_compact(F.array(*found))


def _signals(cats: Column, source: str, confidence: float) -> Column:
    score = confidence * 1.0 * fixed.SIGNAL_WEIGHTS[source]
    return F.transform(cats, lambda c: F.struct(c.alias("category"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score")))


def classified(sheets: DataFrame, number: str = "sheet_number", title: str = "sheet_title", index_title: str | None = None) -> DataFrame:
    """Adds categories, signals, relevance, confidence, is_combo, has_conflict, severity, decision, needs_review and review_reason.

    ``index_title`` names a column with the drawing index's title of the
    sheet, which also stands in for a missing title. Ties of scores go to the
    category that came first.

    A verdict follows from number and titles alone, and these repeat from set
    to set, so each combination is classified once and joined back: patterns
    cost a thousand times what the shuffle of a row does. Adaptive execution
    broadcasts the verdicts if they are few, and splits a combination (such as
    no number and no title) that very many sheets share.
    """
    keys = [number, title, *([index_title] if index_title else [])]
    verdicts = classified_rows(sheets.select(*keys).distinct(), number, title, index_title)
    for c in keys:
        verdicts = verdicts.withColumnRenamed(c, f"_key_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    # columns of the same names as the verdict's are replaced by it
    own = [c for c in sheets.columns if c not in VERDICT]
    return sheets.select(*own).join(verdicts, on).drop(*[f"_key_{c}" for c in keys])


#: What classification adds.
VERDICT = ("categories", "signals", "relevance", "confidence", "is_combo", "has_conflict", "severity", "decision", "needs_review", "review_reason")


def classified_rows(sheets: DataFrame, number: str = "sheet_number", title: str = "sheet_title", index_title: str | None = None) -> DataFrame:
    """:func:`classified`, each row by itself: no join and no shuffle."""
    no = F.array().cast("array<string>")
    n, t = F.col(number), F.col(title)
    has_number = F.coalesce(n != "", F.lit(False))
    indexed = F.when(has_number, F.nullif(F.col(index_title), F.lit(""))) if index_title else F.lit(None).cast("string")
    d = sheets.withColumn("_index", indexed).withColumn("_title", F.coalesce(F.nullif(t, F.lit("")), F.col("_index"))).withColumn("_ncs", F.when(has_number, parsed(n)))
    d = settled(d.withColumn("_parts", title_components(F.col("_title"))), "_index", "_title", "_ncs", "_parts")
    d = d.withColumn(
        "_found",
        F.concat(
            _signals(F.when(F.col("_index").isNotNull(), matched_categories(F.col("_index"))).otherwise(no), "drawing_index", 0.95),
            _signals(F.array_compact(F.array(category_hint(F.col("_ncs")))), "sheet_number", 0.70),
            _signals(F.flatten(F.transform("_parts", lambda p: matched_categories(p))), "title_pattern", 0.90),
            _signals(F.when(has_number & F.col("_ncs").isNull(), matched_categories(F.upper(strip(n)), "number")).otherwise(no), "sheet_number", 0.75),
        ),
    )
    by_title = F.coalesce(matches_any(F.col("_title"), fixed.NOT_NEEDED_TITLE), F.lit(False))
    by_number = F.coalesce(matches_any(F.upper(strip(n)), fixed.NOT_NEEDED_NUMBER), F.lit(False))
    not_needed = F.array(F.lit(fixed.NOT_NEEDED))
    rest = _signals(F.when(by_title, not_needed).otherwise(no), "title_pattern", 0.85)
    rest = F.when(by_title, rest).otherwise(_signals(F.when(by_number, not_needed).otherwise(no), "title_pattern", 0.70))
    d = d.withColumn("signals", F.when(F.size("_found") > 0, F.col("_found")).otherwise(rest)).drop("_found")
    d = settled(d, "signals")
    d = d.withColumn("_cats", F.array_distinct(F.transform("signals", lambda s: s["category"])))
    total = lambda c: F.aggregate(F.filter(F.col("signals"), lambda s: s["category"] == c), F.lit(0.0), lambda a, s: a + s["score"])
    d = d.withColumn("_ranked", F.sort_array(F.transform("_cats", lambda c, i: F.struct((-total(c)).alias("down"), i.alias("i"), c.alias("category")))))
    d = settled(d, "_ranked")
    top, next_ = -F.get(F.col("_ranked"), F.lit(0))["down"], -F.get(F.col("_ranked"), F.lit(1))["down"]
    ratio = F.try_divide(next_, top)
    d = d.withColumn("categories", F.transform("_ranked", lambda x: x["category"]))
    d = d.withColumn("has_conflict", F.coalesce(ratio >= 1.0 - fixed.CONFLICT_RATIO, F.lit(False)))
    d = d.withColumn("severity", F.when(F.col("has_conflict"), ratio).otherwise(F.lit(0.0)))
    d = d.withColumn("is_combo", F.size("_parts") > 1)
    base = F.least(top / fixed.SCORE_SCALE, F.lit(1.0))
    less = F.when(F.col("has_conflict"), fixed.CONFLICT_PENALTY * F.col("severity")).otherwise(0.0) + F.when(F.col("is_combo"), fixed.COMBO_PENALTY).otherwise(0.0)
    score = F.greatest(F.lit(0.0), base - less)
    more = F.when(F.size("signals") >= 3, F.least(F.lit(1.0), score + 0.05 * (F.size("signals") - 2))).otherwise(score)
    d = d.withColumn("confidence", F.when(top.isNull(), F.lit(0.0)).otherwise(more))
    irrelevant = F.coalesce(F.col("_ncs.relevance") == "IRRELEVANT", F.lit(False))
    d = d.withColumn("relevance", F.when(irrelevant, "IRRELEVANT").otherwise(F.coalesce(lookup(F.get("categories", F.lit(0)), fixed.PAINTING_RELEVANCE), F.lit("REFERENCE"))))
    sure = F.col("confidence") >= fixed.DECISION_THRESHOLD
    d = d.withColumn(
        "decision",
        F.when(F.col("has_conflict"), "NEEDS_EVALUATION")
        .when((F.col("relevance") == "IRRELEVANT") & sure, "DEFINITELY_NOT_NEEDED")
        .when(F.col("relevance").isin("PRIMARY", "SECONDARY") & sure, "DEFINITELY_NEEDED")
        .otherwise("NEEDS_EVALUATION"),
    )
    d = settled(d, "has_conflict", "severity", "is_combo", "confidence", "relevance", "decision")
    low = F.col("confidence") < fixed.REVIEW_THRESHOLD
    shown = F.format_string("%.2f", F.col("confidence"))
    d = d.withColumn(
        "review_reason",
        F.when(
            F.col("decision") == "NEEDS_EVALUATION",
            F.when(F.col("has_conflict"), F.lit("Conflicting classification signals"))
            .when(low, F.concat(F.lit("Low confidence ("), shown, F.lit(")")))
            .when(F.col("is_combo"), F.lit("Combo page with multiple drawings"))
            .otherwise(F.lit("Classification uncertain")),
        ).when(low, F.concat(F.lit("Confidence below threshold ("), shown, F.lit(")"))),
    )
    d = d.withColumn("needs_review", F.col("review_reason").isNotNull())
    return d.drop("_index", "_title", "_ncs", "_parts", "_found", "_cats", "_ranked")


def legacy_type(d: DataFrame) -> DataFrame:
    """Adds ``classification``: matched, not_needed or unclassified by decision and categories."""
    kind = (
        F.when(F.col("decision") == "DEFINITELY_NEEDED", "matched")
        .when(F.col("decision") == "DEFINITELY_NOT_NEEDED", "not_needed")
        .when(F.size("categories") > 0, "matched")
        .otherwise("unclassified")
    )
    return d.withColumn("classification", kind)


def bucketed(d: DataFrame) -> DataFrame:
    """One row for each sheet and category that has a bucket; sheets without one are left out."""
    known = [*categories(), fixed.NOT_NEEDED]
    return d.withColumn("category", F.explode("categories")).where(F.col("category").isin(known))


def statistics(d: DataFrame) -> DataFrame:
    """(kind, name, n): counts by decision, relevance, category, combo and review in one pass over the sheets.

    Each sheet is turned into its few counted names first, and counts
    combine before the shuffle, so only one row a name and task moves.
    """
    names = F.concat(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.coalesce(x.cast("string"), F.lit("")).alias("name"))
                for kind, x in (("decision", F.col("decision")), ("relevance", F.col("relevance")), ("combo", F.col("is_combo")), ("review", F.col("needs_review")), ("total", F.lit("all")))
            ]
        ),
        F.transform("categories", lambda c: F.struct(F.lit("category").alias("kind"), F.coalesce(c, F.lit("")).alias("name"))),
    )
    return d.select(F.explode(names).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def set_statistics(d: DataFrame) -> DataFrame:
    """(pdf_filename, total, matched, not_needed, unclassified): each set's sheets by legacy type."""
    kinds = ("matched", "not_needed", "unclassified")
    return legacy_type(d).groupBy("pdf_filename").agg(F.count("*").alias("total"), *[F.count_if(F.col("classification") == k).alias(k) for k in kinds])


def summary(d: DataFrame) -> DataFrame:
    """What is reported of a classified sheet."""
    return d.select(
        "sheet_number", "sheet_title", "decision", F.get("categories", F.lit(0)).alias("primary_category"), "relevance", F.format_string("%.2f", F.col("confidence")).alias("confidence"),
        F.col("is_combo").alias("is_combo_page"), "needs_review", "review_reason", F.size("signals").alias("signal_count"),
    )


def serialised(d: DataFrame) -> DataFrame:
    """A classified sheet as one JSON text: (pdf_filename, page_number, classification)."""
    own = ("sheet_number", "sheet_title", "categories", "signals", "relevance", "confidence", "is_combo", "has_conflict", "severity", "decision", "needs_review", "review_reason")
    return d.select("pdf_filename", "page_number", F.to_json(F.struct(*own)).alias("classification"))


def painting_relevant(relevance: Column) -> Column:
    return relevance.isin("PRIMARY", "SECONDARY")


def legacy_matches(number: Column, title: Column) -> Column:
    """(categories, classification) by patterns alone: those of the title first, then those of the number, a category once; else not needed; else unclassified."""
    base = {k: v for k, v in fixed.SHEET_CATEGORIES.items()}
    found = lambda x, which: [F.when(F.coalesce(matches_any(x, c[which]), F.lit(False)), F.lit(k)) for k, c in base.items() if c.get(which)]
    n = F.upper(strip(number))
    matched = F.array_distinct(F.array_compact(F.array(*found(title, "title"), *found(n, "number"))))
    not_needed = F.coalesce(matches_any(title, fixed.NOT_NEEDED_TITLE), F.lit(False)) | F.coalesce(matches_any(n, fixed.NOT_NEEDED_NUMBER), F.lit(False))
    out = lambda c, k: F.struct(c.alias("categories"), F.lit(k).alias("classification"))
    return F.when(F.size(matched) > 0, out(matched, "matched")).when(not_needed, out(F.array(F.lit(fixed.NOT_NEEDED)), "not_needed")).otherwise(out(F.array(F.lit("unclassified_may_be_needed")), "unclassified"))


def with_index(sheets: DataFrame, index: DataFrame) -> DataFrame:
    """Sheets classified with their drawing index: (pdf_filename, sheet_number, title), matched by the number as it stands."""
    titles = index.groupBy("pdf_filename", "sheet_number").agg(F.max("title").alias("index_title"))
    return classified(sheets.join(titles, ["pdf_filename", "sheet_number"], "left"), index_title="index_title")
