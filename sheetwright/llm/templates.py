"""Line dedup by a log-template tree, in SQL functions only.

A fixed-depth tree parses each line: first by its number of tokens, then by
its leading tokens, tokens with digits generalised. Within a leaf, a token
stays in the template where enough documents have it at its place, else the
place is a variable field. Lines whose template recurs across documents are
dropped. Documents of one whole text (exact copies) count once; texts that
differ anywhere are documents of their own.

Leaves that few documents reach end after the first count, and only lines of
the others are taken apart into tokens, each distinct line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, row_key, text_of, words_of

#: Leading tokens that the tree looks at below the number of tokens.
DEPTH = 3
#: A template recurs if this many distinct documents hold it.
MIN_DOCS = 20
#: Least share of fixed tokens in a template.
MIN_FIXED = 0.5
#: Lines of fewer tokens are left alone: a word or two recur in any prose.
MIN_TOKENS = 3
#: What stands for a variable field.
FIELD = "<*>"


def line_tokens(line: Column) -> Column:
    """Tokens of a line; those with a digit are variable fields."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \x09-\x0D0-9]*[0-9][^ \x09-\x0D]*", FIELD)).otherwise(line)
    return words_of(masked)


def _parsed(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """One row a document: k, the text's hash t, and its lines' place, leaf and hash."""
    d = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), text_of(F.col("text")).alias("text"))
    d = d.select("k", "text", F.transform(F.split("text", "\n"), line_tokens).alias("tokens"))
    each = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), F.size(t).alias("n"), F.xxhash64(F.size(t), F.slice(t, 1, depth)).alias("leaf"), F.xxhash64(F.size(t), t).alias("h")))
    each = F.filter(each, lambda x: x["n"] >= min_tokens)
    return d.select("k", F.xxhash64("text").alias("t"), F.transform(each, lambda x: F.struct(x["i"].alias("i"), x["leaf"].alias("leaf"), x["h"].alias("h"))).alias("at"))


def recurring_lines(docs: DataFrame, parsed: DataFrame, depth: int, min_docs: int, min_fixed: float) -> DataFrame:
    """Hashes of the lines whose template recurs; ``t``, the whole text's hash, is what counts as a document."""
    lines = parsed.select("k", "t", F.explode("at").alias("x")).select("k", "t", "x.i", "x.leaf", "x.h")
    leaves = materialize(lines.groupBy("leaf").agg(F.count_distinct("t").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "template-leaves")
    # the distinct lines of these leaves, how many documents have each, and a place of each
    mine = lines.join(maybe_broadcast(leaves), "leaf")
    counted = mine.groupBy("leaf", "h", "t").agg(F.min(F.struct("k", "i")).alias("at")).groupBy("leaf", "h").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    counted = materialize(counted.select("leaf", "h", "n", F.col("at.k").alias("k"), F.col("at.i").alias("i")), "template-counts")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), text_of(F.col("text")).alias("text"))
    texts = texts.join(maybe_broadcast(counted), "k").select("leaf", "h", "n", F.get(F.split("text", "\n"), F.col("i")).alias("line"))
    known = materialize(texts.groupBy("leaf", "h").agg(F.first("n").alias("n"), F.min("line").alias("line")), "template-lines")
    tokens = known.select("leaf", "h", "n", F.posexplode(line_tokens(F.col("line"))).alias("pos", "token"))
    held = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("docs")).where((F.col("docs") >= min_docs) & (F.col("token") != FIELD))
    fixed = tokens.join(held.drop("docs"), ["leaf", "pos", "token"])
    shapes = (
        fixed.groupBy("leaf", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("fixed"))
        .join(known, ["leaf", "h"])
        .where(F.size("fixed") >= F.lit(float(min_fixed)) * F.size(line_tokens(F.col("line"))))
        .select("leaf", "h", F.xxhash64("leaf", "fixed").alias("template"))
    )
    shapes = materialize(shapes, "template-shapes")
    recur = (
        mine.join(shapes, ["leaf", "h"]).groupBy("template").agg(F.count_distinct("t").alias("n"))
        .where(F.col("n") >= min_docs).select("template")
    )
    return shapes.join(recur, "template", "left_semi").select("h").distinct()


def _marked(docs: DataFrame, depth: int, min_docs: int, min_fixed: float, min_tokens: int) -> DataFrame:
    """(k, places): the places of the lines that each document loses."""
    parsed = materialize(_parsed(docs, depth, min_tokens), "template-parsed")
    drop = materialize(recurring_lines(docs, parsed, depth, min_docs, min_fixed), "template-recurring")
    lost = parsed.dropDuplicates(["k"]).select("k", F.explode("at").alias("x")).select("k", "x.i", "x.h").join(maybe_broadcast(drop), "h")
    return lost.groupBy("k").agg(F.collect_list("i").alias("places"))


def _without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    d = docs.withColumn("_t_k", row_key(F.col("doc_id"), F.col("text")))
    # marks grow with the documents: always a shuffle, of the same shape at every size
    d = d.join(marked.select(F.col("k").alias("_t_k"), F.col("places").alias("_t_at")).hint("merge"), "_t_k", "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_t_at"), i))
    return d.withColumn("_t_text", F.when(F.col("_t_at").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))


def template_report(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, for each row of ``docs``.

    A null text has no lines and stays null; an empty one has one empty line.
    Repeated rows each get their row and lose the same lines; very long texts
    are taken whole. Lines of equal counts need no order, as every line whose
    template recurs goes. Other columns are not looked at, whatever their
    names. An empty table gives an empty result.
    """
    out = _without(docs.select("doc_id", F.col("text").cast("string").alias("text")), _marked(docs, depth, min_docs, min_fixed, min_tokens))
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_t_at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_t_text").alias("text"),
    )


def drop_templates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents, all columns, without the lines of recurring templates.

    ``n_chars``, where there is such a column, is counted anew. Nulls, empty
    and very long texts, ties, repeated rows and empty tables are as in
    :func:`template_report`: every row stays, a null text stays null, and a
    text of recurring lines only becomes empty. Columns of other names stay
    as they are.
    """
    d = _without(docs, _marked(docs, depth, min_docs, min_fixed, min_tokens)).withColumn("text", F.col("_t_text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The query's oracle.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS MATERIALIZED (
  SELECT r, text, i, line, list_transform(regexp_extract_all(line, '[^ \x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t
  FROM (SELECT r, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
keyed AS MATERIALIZED (SELECT r, text, i, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS h, t FROM lines WHERE len(t) >= 3),
leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT text) >= 20),
mine AS MATERIALIZED (SELECT k.* FROM keyed k JOIN leaves USING (leaf)),
known AS MATERIALIZED (SELECT leaf, h, any_value(t) AS t, count(DISTINCT text) AS n FROM mine GROUP BY leaf, h),
tokens AS (SELECT leaf, h, n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM known),
held AS (SELECT leaf, pos, token FROM tokens WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING sum(n) >= 20),
shapes AS MATERIALIZED (
  SELECT leaf, h, string_agg(pos || ':' || token, ' ' ORDER BY pos) AS shape FROM tokens JOIN held USING (leaf, pos, token) JOIN (SELECT leaf, h, len(t) AS m FROM known) USING (leaf, h)
  GROUP BY leaf, h, m HAVING count(*) >= 0.5::DOUBLE * m),
recur AS (SELECT leaf, shape FROM mine JOIN shapes USING (leaf, h) GROUP BY leaf, shape HAVING count(DISTINCT text) >= 20),
gone AS (SELECT DISTINCT r, i FROM mine JOIN shapes USING (leaf, h) JOIN recur USING (leaf, shape)),
marked AS (SELECT l.r, l.i, l.line, g.r IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.r = l.r AND g.i = l.i),
left_ AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN x.text END AS text FROM d LEFT JOIN left_ x USING (r)
"""
