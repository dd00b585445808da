"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and a document
is emitted floor(rate) times plus one copy with a probability equal to the
fraction, where rate is its source's target over its source's size. The draw
is a hash of the seed and the doc_id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, text_of, words_of


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words_of(text_of(text))).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 (included) to 1 (excluded) fixed by seed and doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets per source from a table with ``source`` and ``size``.

    Sources in order of code points, null last, take the weights in turn and
    share ``share`` times all sizes. No target is above ``cap`` times its
    source's size; what is above goes to the others by weight. In closed form
    a target is ``least(weight * level, cap * size)``: with the sources in
    order of the level at which each is full, the level is the greatest of
    (budget - caps of those before) / weights of the rest, as every such
    quotient is a lower bound and one of them is met.

    The windows below run over one row a source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_n").asc())
    every = Window.partitionBy(F.lit(1))
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        per.withColumn("_n", F.row_number().over(named))
        .withColumn("_w", F.element_at(table, F.pmod(F.col("_n") - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_before", F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_rest", F.sum("_w").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.max((F.col("_budget") - F.col("_before")) / F.col("_rest")).over(every))
        .select("source", "source_size", F.least(F.col("_w") * F.col("_level"), F.col("_cap")).alias("target"))
    )


def copies_of(rate: Column, doc_id: Column, seed: int) -> Column:
    """How many times a document is emitted."""
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def rated(docs: DataFrame, seed: int, **how) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies."""
    sizes = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")), "mix-sizes")
    targets = maybe_broadcast(materialize(source_targets(sizes, **how), "mix-targets"))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    return (
        sizes.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
        .select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", copies_of(rate, F.col("d.doc_id"), seed).alias("copies"))
    )


def mix_report(docs: DataFrame, seed: int = 17, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """What the mix takes of each document.

    Returns doc_id, size, source_size, target and taken (words taken, repeats
    counted), one row for each row of ``docs``. A null or empty text has size
    0 and nothing is taken of it; a null source is a source of its own; rows
    with equal doc_id draw alike; an empty table gives an empty result.
    """
    out = rated(docs, seed, weights=weights, share=share, cap=cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it.

    Only the targets (one row a source) are joined to the documents; texts
    are never shuffled. Documents of size 0, null texts too, follow their
    source's rate, which is 0 if the source has no words. A null source is a
    source of its own. Repeated rows, and all rows of one doc_id, null ones
    too, draw alike. Columns of other names stay as they are. An empty table
    gives an empty result.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    targets = maybe_broadcast(materialize(source_targets(sizes, weights, share, cap).select(F.col("source").alias("_mix_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_mix_rate")), "mix-rates"))
    return (
        docs.join(targets, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")), "left")
        .withColumn("_mix_copies", copies_of(F.col("_mix_rate"), F.col("doc_id"), seed).cast("int"))
        .where(F.col("_mix_copies") > 0)
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


#: The query's oracle.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (n - 1) % 3] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM per) - lower_caps) / rest) AS level
  FROM (SELECT a.n, any_value(a.w) AS w,
               coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.n < a.n)), 0) AS lower_caps,
               sum(b.w) FILTER (b.cap / b.w > a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.n >= a.n)) AS rest
        FROM weighed a, weighed b GROUP BY a.n)),
targets AS (SELECT source, source_size, least(w * level, cap) AS target FROM weighed, levels),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
