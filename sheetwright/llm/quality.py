"""Quality rules with cross-document line frequency, in SQL functions only.

Base rules look at one document. The method then hashes normalised lines,
counts the distinct documents of each host (``source``) that hold a line,
removes lines above the limits, and rejects documents that are depleted.
Documents of one whole text (exact copies) count once in that count; texts
that differ anywhere are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, row_key, text_of, trigram_hashes, words_of

#: A line is removed if this many distinct documents of its host hold it ...
MIN_DOCS = 20
#: ... and this share of the host's distinct documents.
MIN_SHARE = 0.01
#: A document is depleted if it loses more than this share of the characters in its words.
MAX_LOST = 0.5


#: Places of windows take this many low bits where they are packed with hashes.
PLACE_BITS = 20


def compact(text: Column) -> Column:
    """The text without white space but line ends."""
    return F.replace(plain(text, "\n"), F.lit(" "), F.lit(""))


def line_hashes(lines: Column) -> Column:
    """Hash of each normalised line: lower case, no blanks."""
    return F.transform(lines, lambda x: F.xxhash64(F.lower(x)))


def _packed(hashes: Column) -> Column:
    """High bits of each hash with its place in the low bits, in order; null if no hash occurs twice."""
    high = ~((1 << PLACE_BITS) - 1)
    each = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(each))


def _covered(places: Column) -> Column:
    """How many words the windows at ``places`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def repeated_words(d: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: words within 3-word windows that occur twice or more.

    Windows are sorted by hash; those equal to a neighbour repeat. Sorting
    takes hash and place in one long; where that can't tell two hashes apart,
    or a text has too many windows, pairs of hash and place are sorted.
    """
    low = (1 << PLACE_BITS) - 1
    d = d.withColumn("_packed", _packed(F.col(hashes)))
    packed, h = F.col("_packed"), F.col(hashes)
    top = lambda x: F.shiftright(x, PLACE_BITS)
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    again = F.filter(packed, lambda x, i: F.coalesce(top(x) == top(F.get(packed, i + 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(packed, i - 1)), F.lit(False)))
    d = d.withColumn("_again", again)
    again = F.col("_again")
    unclear = F.exists(F.transform(again, lambda x, i: (top(x) == top(F.get(again, i + 1))) & (F.get(h, at(x)) != F.get(h, at(F.get(again, i + 1))))), lambda x: F.coalesce(x, F.lit(False)))
    d = d.withColumn("_pairs", F.when(packed.isNotNull() & ((F.size(h) > low) | unclear), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.col("_pairs")
    exact = F.filter(pairs, lambda x, i: F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)))
    n = F.when(packed.isNull(), 0).when(pairs.isNotNull(), _covered(F.transform(exact, lambda x: x["i"]))).otherwise(_covered(F.transform(again, at)))
    return d.withColumn(out, n.cast("long")).drop("_packed", "_again", "_pairs")


def measured(docs: DataFrame) -> DataFrame:
    """One row a document: key, base measures, the text's hash t, line hashes and characters a line."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of(F.col("text")).alias("text"), row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("k"))
    d = d.withColumn("words", words_of(F.col("text")))
    d = d.withColumn("tri", trigram_hashes(F.col("words")))
    d = repeated_words(d, "tri", "n_repeat_words")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(plain(x)) != "")
    d = d.select(
        "doc_id", "source", "k",
        F.size("words").cast("long").alias("n_words"),
        F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), "n_repeat_words",
        F.xxhash64("text").alias("t"),
        F.array_remove(F.split(compact(F.col("text")), "\n"), "").alias("norm"),
    )
    return d.select(
        "doc_id", "source", "k", "n_words",
        F.length(F.array_join("norm", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "t",
        F.arrays_zip(line_hashes(F.col("norm")).alias("h"), F.transform("norm", lambda x: F.length(x)).alias("n")).alias("at"),
    )


def frequent_lines(m: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, h) of the lines above the limits; counts combine before they are shuffled."""
    hosts = m.groupBy("source").agg(F.count_distinct("t").alias("docs"))
    lines = (
        m.select("source", "t", F.explode(F.array_distinct(F.transform("at", lambda x: x["h"]))).alias("h"))
        .groupBy("source", "h").agg(F.count_distinct("t").alias("n"))
        .where(F.col("n") >= min_docs)
    )
    return (
        lines.alias("l").join(hosts.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
        .where(F.col("l.n") >= F.col("s.docs") * F.lit(float(min_share)))
        .select("l.source", "l.h")
    )


def judged(docs: DataFrame, min_docs: int, min_share: float, max_lost: float) -> tuple[DataFrame, DataFrame]:
    """The measures with the verdict, and (k, bad): the hashes of the lines that each document loses."""
    m = materialize(measured(docs), "quality-measures")
    often = materialize(frequent_lines(m, min_docs, min_share), "quality-lines")
    lost = (
        m.dropDuplicates(["k"]).select("k", "source", F.explode("at").alias("x")).alias("d")
        .join(often.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.x.h") == F.col("f.h")))
        .groupBy("k").agg(F.sum("d.x.n").alias("lost"), F.collect_set("f.h").alias("bad"))
    )
    lost = materialize(lost, "quality-lost")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.coalesce(F.col("lost"), F.lit(0)) > F.col("word_chars") * F.lit(float(max_lost))
    out = m.join(lost.select("k", "lost"), "k", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return out, lost


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_lost: float = MAX_LOST) -> DataFrame:
    """Measures and verdict for each row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and lost_chars (those in words of
    lines above the limits). A null text is empty: no words, base_failed. A null source is a
    host of its own. Repeated rows each get their row and count as one
    document. Very long texts are taken whole. A line at a limit is above it,
    and so goes; a document that loses exactly ``max_lost`` stays. Other
    columns are not looked at. An empty table gives an empty result.
    """
    out, _ = judged(docs, min_docs, min_share, max_lost)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("lost", F.lit(0)).cast("long").alias("lost_chars"))


def quality_filter(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents, all columns, without the lines above the limits.

    ``n_chars``, where there is such a column, is counted anew. Nulls, empty
    and very long texts, ties and repeated rows are as in
    :func:`quality_report`: null and empty texts fail the base rules and go,
    repeated rows stay or go together. Columns of other names stay as they
    are. An empty table gives an empty result.
    """
    out, lost = judged(docs, min_docs, min_share, max_lost)
    kept = out.where("kept").select(F.col("k").alias("_q_k")).distinct()
    bad = lost.select(F.col("k").alias("_q_k"), F.col("bad").alias("_q_bad"))
    verdict = kept.join(bad, "_q_k", "left")
    d = docs.withColumn("_q_k", row_key(F.col("doc_id"), F.col("source"), F.col("text"))).join(verdict, "_q_k")
    left = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x: ~F.array_contains(F.col("_q_bad"), F.xxhash64(F.lower(compact(x))))), "\n")
    d = d.withColumn("text", F.when(F.col("_q_bad").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The query's oracle.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (
  SELECT r, source, text, line, regexp_replace(line, '[ \x09-\x0D]+', '', 'g') AS norm FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
real AS (SELECT *, lower(norm) AS key FROM lines WHERE norm <> ''),
repeated AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM real GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
bad AS (
  SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT text) AS n FROM real GROUP BY source, key) l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
  WHERE l.n >= 20 AND l.n >= 0.01::DOUBLE * h.docs),
lost AS (SELECT r, sum(length(norm)) AS n FROM real JOIN bad ON bad.source IS NOT DISTINCT FROM real.source AND bad.key = real.key GROUP BY r),
measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS lost
  FROM d LEFT JOIN repeated p USING (r) LEFT JOIN covered c USING (r) LEFT JOIN lost l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost > word_chars * 0.5::DOUBLE AS kept
FROM measured
"""
