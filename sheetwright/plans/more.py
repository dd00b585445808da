"""More queries of the document model and their SQL: reports, learning, review, borders, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, numbers, pages, scores, text
from ..operators import accuracy, classify, content, fields, images, index, learn, profiles, review, spatial, store
from ..rules import fixed
from ..rules.build import categories
from ..sources import sinks
from ..streaming import ingest
from . import fixtures
from .queries import _CLASSIFIED, _REPORTED, _any, _classified, _list, _profile, _quote, query

# -- classification reports ------------------------------------------------------------------

_DIMS = ", ".join(f"({_quote(k)}, {_quote(v.get('description', ''))}, {_quote(v['folder']) if v.get('folder') else 'NULL'})" for k, v in {**categories(), fixed.NOT_NEEDED: {}}.items())


@query("master_manifest", f"""WITH {_CLASSIFIED}
SELECT d.category, count(s.id) AS count, d.description, d.folder FROM (VALUES {_DIMS}) d(category, description, folder) LEFT JOIN sums s ON s.category = d.category GROUP BY ALL""")
def master_manifest(spark, sf_dir):
    """O-SINK-11: every bucket, empty ones too."""
    return sinks.master_manifest(_classified(spark, sf_dir))


@query("set_statistics", f"""WITH {_CLASSIFIED},
{_REPORTED}
SELECT pdf_filename, count(*) AS total, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'not_needed') AS not_needed, count(*) FILTER (kind = 'unclassified') AS unclassified FROM reported GROUP BY ALL""")
def set_statistics(spark, sf_dir):
    """O-AGG-6 by set, O-PROJ-8."""
    return classify.set_statistics(_classified(spark, sf_dir))


@query("classification_summary", f"""WITH {_CLASSIFIED},
{_REPORTED}
SELECT sheet_number, sheet_title, decision, top AS primary_category, relevance, printf('%.2f', confidence) AS confidence, is_combo AS is_combo_page, review_reason IS NOT NULL AS needs_review, review_reason, CAST(signals AS INTEGER) AS signal_count FROM reported""")
def classification_summary(spark, sf_dir):
    """O-PROJ-9, O-PROJ-10, O-CLS-7."""
    return classify.summary(_classified(spark, sf_dir))


@query("serialised", f"""WITH {_CLASSIFIED},
{_REPORTED}
SELECT pdf_filename, page_number, decision, coalesce(len(string_split(nullif(categories, ''), ';')), 0)::INTEGER AS categories, round(confidence, 6) AS confidence FROM reported""")
def serialised(spark, sf_dir):
    """O-PROJ-7: written as JSON and read back."""
    d = classify.serialised(_classified(spark, sf_dir))
    j = F.from_json("classification", "decision string, categories array<string>, confidence double")
    return d.select("pdf_filename", "page_number", j.alias("j")).select("pdf_filename", "page_number", "j.decision", F.size("j.categories").alias("categories"), F.round("j.confidence", 6).alias("confidence"))


_BASE = ", ".join(f"({i + 1000 * (k == 'number')}, {_quote(c)}, {_quote(k)}, {_quote(p)})" for k in ("title", "number") for i, (c, v) in enumerate(fixed.SHEET_CATEGORIES.items()) for p in v[k])


@query("legacy_matches", f"""WITH base(ord, category, kind, pattern) AS (VALUES {_BASE}),
pairs AS MATERIALIZED (SELECT DISTINCT sheet_number AS n, sheet_title AS t FROM sheets),
m AS (SELECT n, t, category, min(ord) AS ord FROM pairs, base WHERE regexp_matches(CASE kind WHEN 'title' THEN t ELSE n END, pattern, 'i') GROUP BY ALL),
a AS (SELECT n, t, string_agg(category, ';' ORDER BY ord) AS c FROM m GROUP BY ALL)
SELECT p.n AS sheet_number, p.t AS sheet_title, CASE WHEN a.c IS NOT NULL THEN a.c WHEN coalesce({_any('p.t', fixed.NOT_NEEDED_TITLE)}, false) OR coalesce({_any('p.n', fixed.NOT_NEEDED_NUMBER)}, false) THEN '{fixed.NOT_NEEDED}' ELSE 'unclassified_may_be_needed' END AS categories,
  CASE WHEN a.c IS NOT NULL THEN 'matched' WHEN coalesce({_any('p.t', fixed.NOT_NEEDED_TITLE)}, false) OR coalesce({_any('p.n', fixed.NOT_NEEDED_NUMBER)}, false) THEN 'not_needed' ELSE 'unclassified' END AS classification
FROM pairs p LEFT JOIN a ON a.n IS NOT DISTINCT FROM p.n AND a.t IS NOT DISTINCT FROM p.t""")
def legacy_matches(spark, sf_dir):
    """O-SET-5, O-CLS-8, O-JOIN-9/10/11."""
    m = classify.legacy_matches(F.col("sheet_number"), F.col("sheet_title"))
    d = fixtures.sheets(spark, sf_dir).select("sheet_number", "sheet_title").distinct().select("sheet_number", "sheet_title", F.explode(F.array(m)).alias("m"))
    return d.select("sheet_number", "sheet_title", F.array_join("m.categories", ";").alias("categories"), "m.classification")


@query("index_titles", f"""SELECT s.pdf_filename, s.page_number, e.title AS index_title FROM sheets s LEFT JOIN entries e ON e.pdf_filename = s.pdf_filename AND e.sheet_number = s.sheet_number""", "sheets entries")
def index_titles(spark, sf_dir):
    """O-JOIN-4, O-CLS-1, O-MISC-7: the index as classification takes it, by the number as it stands."""
    s = fixtures.sheets(spark, sf_dir)
    return classify.with_index(s, fixtures.index_entries(s)).select("pdf_filename", "page_number", "index_title")


@query("success_rate", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 > 0) AS succeeded, count(*) FILTER (o_orderkey % 3 > 0) / count(*) AS rate FROM sheets")
def success_rate(spark, sf_dir):
    """O-AGG-3."""
    return accuracy.success_rate(fixtures.sheets(spark, sf_dir).select(F.when(F.pmod("o_orderkey", F.lit(3)) > 0, "pattern").alias("title_method")))


@query("every_nth_page", "SELECT pdf_filename, page_number FROM sheets WHERE (page_number - 1) % 7 = 0 AND page_number <= 7 * 20")
def every_nth_page(spark, sf_dir):
    """O-SORT-9: sampling is the operator."""
    return fixtures.sheets(spark, sf_dir).where(pages.every_nth(F.col("page_number"), 7, 20)).select("pdf_filename", "page_number")


@query("keyword_tests", f"""SELECT DISTINCT sheet_title, regexp_matches(upper(sheet_title), '\\b(?:{'|'.join(fixed.VALID_TITLE_KEYWORDS)})S?\\b') AS plural, regexp_matches(upper(sheet_title), '\\b(?:{'|'.join(fixed.VALID_TITLE_KEYWORDS)})\\b') AS word,
  (SELECT bool_or(contains(upper(sheet_title), k)) FROM (VALUES {', '.join(f'({_quote(k)})' for k in fixed.QUALITY_KEYWORDS)}) q(k)) AS anywhere FROM sheets WHERE sheet_title IS NOT NULL""")
def keyword_tests(spark, sf_dir):
    """O-FLT-13."""
    t = F.col("sheet_title")
    return fixtures.sheets(spark, sf_dir).where("sheet_title is not null").select("sheet_title").distinct().select(
        "sheet_title", text.has_title_keyword(t).alias("plural"), text.has_title_keyword(t, plural=False).alias("word"), text.contains_keyword(t, fixed.QUALITY_KEYWORDS).alias("anywhere"))


@query("index_book", """SELECT pdf_filename, sheet_number, CASE WHEN ord % 3 = 0 THEN 'REPLACED' ELSE title END AS title FROM entries WHERE pdf_filename <> 'set_01.pdf'""", "sheets entries")
def index_book(spark, sf_dir):
    """O-TT-17: entries set over others, and a set's entries cleared."""
    e = fixtures.index_entries(fixtures.sheets(spark, sf_dir))
    book = index.set_entries(e, e.where(F.pmod("ord", F.lit(3)) == 0).withColumn("title", F.lit("REPLACED")))
    return index.clear_entries(book, e.where("pdf_filename = 'set_01.pdf'")).select("pdf_filename", "sheet_number", "title")


@query("deskew", """WITH s AS (SELECT l_suppkey % 30 AS page, degrees(atan2((l_partkey % 5) * 0.5 - 0.5, 10.0)) AS a FROM lineitem)
SELECT page, round(CASE WHEN count(*) FILTER (abs(a) < 45) >= 5 AND abs(median(a) FILTER (abs(a) < 45)) <= 5 THEN median(a) FILTER (abs(a) < 45) ELSE 0 END, 9) AS angle FROM s GROUP BY ALL""", "blocks")
def deskew(spark, sf_dir):
    """O-IMG-6."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.pmod("l_suppkey", F.lit(30)).alias("page"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(10.0).alias("x2"), (F.pmod("l_partkey", F.lit(5)) * 0.5 - 0.5).alias("y2"))
    return images.deskew_angle(d).withColumn("angle", F.round("angle", 9))


# -- learning -----------------------------------------------------------------------------------

_METHODS = "['pattern', 'spatial', 'vision_api', 'drawing_index'][CAST(o_orderkey % 4 AS INTEGER) + 1]"


def _methods(s):
    return s.withColumn("title_method", F.element_at(F.array(*[F.lit(x) for x in ("pattern", "spatial", "vision_api", "drawing_index")]), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int")))


@query("neighbour_methods", f"""WITH g AS (SELECT pdf_filename, page_number, {_METHODS} AS m, title_confidence AS c FROM sheets WHERE needs_review = 0 AND sheet_title <> '')
SELECT s.pdf_filename, s.page_number, CASE WHEN p.m IS NOT NULL AND (q.m IS NULL OR p.c >= q.c) THEN p.m ELSE q.m END AS reference_method
FROM sheets s LEFT JOIN g p ON p.pdf_filename = s.pdf_filename AND p.page_number = s.page_number - 1 LEFT JOIN g q ON q.pdf_filename = s.pdf_filename AND q.page_number = s.page_number + 1""")
def neighbour_methods(spark, sf_dir):
    """O-WIN-11, O-JOIN-7."""
    return learn.neighbour_base(_methods(fixtures.sheets(spark, sf_dir))).select("pdf_filename", "page_number", "reference_method")


_KEYED = "(" + " OR ".join(f"contains(upper(line), {_quote(k)})" for k in fixed.QUALITY_KEYWORDS) + ")"
_TEXT = """texts AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'PROJECT DATA' || chr(10) || 'SHEET NUMBER: ' || coalesce(sheet_number, '') || chr(10) || 'TITLE: ' || coalesce(sheet_title, '')
    WHEN 1 THEN 'notes' || chr(10) || 'SHEET NO: ' || coalesce(sheet_number, '') || chr(10) || 'more notes' WHEN 2 THEN 'DRAWING NO' || chr(10) || coalesce(sheet_number, '') || chr(10) || coalesce(sheet_title, '')
    WHEN 3 THEN coalesce(sheet_title, '') || chr(10) || coalesce(sheet_number, '') ELSE 'general requirements' || chr(10) || coalesce(sheet_title, '') END AS text FROM sheets),
lines AS (SELECT o_orderkey, pdf_filename, k, trim(line) AS line FROM (SELECT o_orderkey, pdf_filename, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts)),
near AS (SELECT s.o_orderkey, CASE n.c WHEN 2 THEN 0.8 WHEN 1 THEN 0.7 END::DOUBLE AS base FROM sheets s LEFT JOIN (
  SELECT a.pdf_filename, a.page_number, count(*) AS c FROM sheets a JOIN sheets b ON a.pdf_filename = b.pdf_filename AND abs(a.page_number - b.page_number) = 1
  WHERE b.needs_review = 0 AND b.sheet_title <> '' GROUP BY ALL) n USING (pdf_filename, page_number))"""
_KEYLINE = f"(SELECT o_orderkey, arg_min(line, k) AS line FROM lines WHERE length(line) >= 8 AND {_KEYED} GROUP BY ALL)"


@query("sibling_lines", f"""WITH {_TEXT}
SELECT s.pdf_filename, s.page_number, CASE WHEN n.base IS NOT NULL THEN l.line END AS title, CASE WHEN l.line IS NOT NULL THEN round(n.base * 0.8, 6) END AS confidence
FROM sheets s JOIN near n USING (o_orderkey) LEFT JOIN {_KEYLINE} l USING (o_orderkey)""")
def sibling_lines(spark, sf_dir):
    """O-TT-13 without a template."""
    d = learn.sibling_inference(fixtures.sheet_text(fixtures.sheets(spark, sf_dir)))
    return d.select("pdf_filename", "page_number", F.col("inferred.title").alias("title"), F.round("inferred.confidence", 6).alias("confidence"))


_TEMPLATES = f"""good AS (SELECT *, sheet_title AS t FROM sheets WHERE needs_review = 0 AND length(sheet_title) >= 5 AND NOT {_any('sheet_title', fixed.GARBAGE_PATTERNS)}
    AND (SELECT count(*) FROM (VALUES {', '.join(f'({_quote(k)})' for k in fixed.QUALITY_KEYWORDS)}) q(k) WHERE contains(upper(sheet_title), k)) > 0
    AND (len(string_split(sheet_title, ' ')) >= 2 OR (length(sheet_title) >= 15 AND upper(sheet_title) NOT IN {_list(fixed.QUALITY_KEYWORDS)}))),
often AS (SELECT g.pdf_filename, g.t FROM good g JOIN (SELECT pdf_filename, count(*) AS p FROM sheets GROUP BY ALL) USING (pdf_filename) GROUP BY g.pdf_filename, g.t, p HAVING count(*) > 0.2 * p),
learned AS (SELECT pdf_filename, floor(min(length(t)) * 0.5) AS lo, floor(max(length(t)) * 1.5) AS hi FROM good WHERE (pdf_filename, t) NOT IN (SELECT (pdf_filename, t) FROM often) GROUP BY ALL HAVING count(*) >= 5),
failed AS (SELECT pdf_filename, sheet_title AS f FROM sheets WHERE needs_review = 1 AND sheet_title <> '' GROUP BY ALL HAVING count(*) >= 3),
fits AS (SELECT l.* FROM lines l JOIN learned t USING (pdf_filename) WHERE line <> '' AND length(line) BETWEEN lo AND hi AND NOT {_any('line', fixed.STANDARD_EXCLUSIONS)} AND NOT regexp_matches(line, '^[0-9]+$')
    AND NOT regexp_matches(line, '^[A-Z]{{1,2}}[-.]?[0-9]{{1,4}}([.][0-9]{{1,2}})?$', 'i') AND NOT EXISTS (SELECT 1 FROM failed x WHERE x.pdf_filename = l.pdf_filename AND contains(lower(line), lower(f)))),
applied AS (SELECT o_orderkey, coalesce(arg_min(line, k) FILTER ({_KEYED}), arg_min(line, k)) AS title, CASE WHEN count(*) FILTER ({_KEYED}) > 0 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM fits GROUP BY ALL)"""


@query("sibling_templates", f"""WITH {_TEXT},
{_TEMPLATES}
SELECT s.pdf_filename, s.page_number, CASE WHEN n.base IS NOT NULL THEN coalesce(a.title, l.line) END AS title,
  CASE WHEN n.base IS NULL THEN NULL WHEN a.title IS NOT NULL THEN round(least(n.base, a.confidence), 6) WHEN l.line IS NOT NULL THEN round(n.base * 0.8, 6) END AS confidence
FROM sheets s JOIN near n USING (o_orderkey) LEFT JOIN applied a USING (o_orderkey) LEFT JOIN {_KEYLINE} l USING (o_orderkey)""")
def sibling_templates(spark, sf_dir):
    """O-TT-13 with templates, O-TT-12, O-FLT-15, O-JOIN-21."""
    s = fixtures.sheet_text(fixtures.sheets(spark, sf_dir))
    d = learn.sibling_inference(s, learn.learn_templates(s))
    return d.select("pdf_filename", "page_number", F.col("inferred.title").alias("title"), F.round("inferred.confidence", 6).alias("confidence"))


@query("rescue", f"""WITH {_TEXT},
{_TEMPLATES},
got AS (SELECT s.*, CASE WHEN a.title IS NOT NULL THEN a.title WHEN n.base IS NOT NULL THEN l.line END AS g, CASE WHEN a.title IS NOT NULL THEN a.confidence WHEN n.base IS NOT NULL AND l.line IS NOT NULL THEN n.base * 0.8 END AS c,
    CASE WHEN a.title IS NOT NULL THEN 'template' ELSE 'sibling_inference' END AS m, needs_review = 1 OR coalesce(trim(sheet_title), '') = '' AS weak
  FROM sheets s JOIN near n USING (o_orderkey) LEFT JOIN applied a USING (o_orderkey) LEFT JOIN {_KEYLINE} l USING (o_orderkey)),
ok AS (SELECT *, weak AND coalesce(c >= 0.6, false) AS ok FROM got)
SELECT pdf_filename, page_number, CASE WHEN ok THEN g ELSE sheet_title END AS sheet_title, round(CASE WHEN ok THEN c ELSE title_confidence END, 6) AS title_confidence,
  CASE WHEN ok AND c >= 0.8 THEN 0 ELSE needs_review END AS needs_review, CASE WHEN ok THEN m END AS rescued_by FROM ok""")
def rescue(spark, sf_dir):
    """O-TT-12..14, O-JOIN-21, O-FLT-2, O-FLT-15."""
    s = fixtures.sheet_text(fixtures.sheets(spark, sf_dir))
    return learn.rescue(s, learn.learn_templates(s)).select("pdf_filename", "page_number", "sheet_title", F.round("title_confidence", 6).alias("title_confidence"), "needs_review", "rescued_by")


@query("template_blocks", f"""WITH learned AS (SELECT 4 AS lo, 60 AS hi),
b AS (SELECT pdf_filename, page_number, unnest([1, 2, 3]) AS k, unnest([coalesce(sheet_title, ''), 'SCALE: NTS', 'general plan notes ' || o_orderkey % 100]) AS line, unnest([o_orderkey % 30, 30, 8]) AS size FROM sheets),
f AS (SELECT *, least(size / 20.0::DOUBLE, 1) * CAST(size > 0 AS INTEGER) + CASE WHEN {_KEYED} THEN 2 ELSE 0 END + CASE WHEN length(line) BETWEEN 15 AND 40 THEN 1 WHEN length(line) BETWEEN 10 AND 50 THEN 0.5 ELSE 0 END AS score
  FROM b, learned WHERE line <> '' AND length(line) BETWEEN lo AND hi AND NOT {_any('line', fixed.STANDARD_EXCLUSIONS)} AND NOT regexp_matches(line, '^[0-9]+$'))
SELECT pdf_filename, page_number, arg_max(line, round(score, 6) * 1000 - k) AS title, 0.85::DOUBLE AS confidence FROM f GROUP BY ALL""")
def template_blocks(spark, sf_dir):
    """O-TT-12 over blocks, O-SCORE-3."""
    s, k = fixtures.sheets(spark, sf_dir), F.col("o_orderkey")
    block = lambda t, n: F.struct(t.alias("text"), n.cast("double").alias("font_size"))
    blocks = F.array(block(F.coalesce("sheet_title", F.lit("")), F.pmod(k, F.lit(30))), block(F.lit("SCALE: NTS"), F.lit(30)), block(F.concat(F.lit("general plan notes "), F.pmod(k, F.lit(100)).cast("string")), F.lit(8)))
    t = F.struct(F.lit(8).alias("typical_length_min"), F.lit(40).alias("typical_length_max"), F.array(*[F.lit(p) for p in fixed.STANDARD_EXCLUSIONS]).alias("exclusion_patterns"))
    d = s.select("pdf_filename", "page_number", F.explode(F.array(learn.apply_to_blocks(blocks, t))).alias("a"))
    return d.where("a is not null").select("pdf_filename", "page_number", "a.title", "a.confidence")


# -- review and reports -------------------------------------------------------------------------

_QUEUE = """q AS (SELECT o_orderkey AS ord, sheet_number, sheet_title, CASE o_orderkey % 3 WHEN 0 THEN 'NEEDS_EVALUATION' ELSE 'DEFINITELY_NEEDED' END AS decision, CAST(o_orderkey % 3 AS INTEGER) AS priority,
  o_orderkey % 4 = 0 AS reviewed, CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'NEEDS_EVALUATION' ELSE 'DEFINITELY_NEEDED' END END AS human, substr(coalesce(sheet_number, 'X'), 1, 1) AS category FROM sheets)"""


def _queue(spark, sf_dir):
    s, k = fixtures.sheets(spark, sf_dir), F.col("o_orderkey")
    items = s.select(
        k.alias("ord"), "sheet_number", "sheet_title", F.when(F.pmod(k, F.lit(3)) == 0, "NEEDS_EVALUATION").otherwise("DEFINITELY_NEEDED").alias("decision"), F.array().cast("array<string>").alias("categories"),
        F.lit("").alias("review_reason"), F.pmod(k, F.lit(3)).cast("int").alias("priority"))
    marks = s.where(F.pmod(k, F.lit(4)) == 0).select(
        k.alias("ord"), F.when(F.pmod(k, F.lit(5)) == 0, "NEEDS_EVALUATION").otherwise("DEFINITELY_NEEDED").alias("human_decision"), F.array(F.substring(F.coalesce("sheet_number", F.lit("X")), 1, 1)).alias("human_categories"), F.lit("").alias("human_notes"))
    return review.mark_reviewed(review.add_items(spark.createDataFrame([], review.QUEUE), items), marks)


@query("pending_reviews", f"WITH {_QUEUE} SELECT ord, priority, sheet_number FROM q WHERE NOT reviewed AND priority = 2 ORDER BY ord")
def pending_reviews(spark, sf_dir):
    """O-FLT-23, O-SORT-3, O-MISC-1."""
    return review.pending(_queue(spark, sf_dir), 2).select("ord", "priority", "sheet_number")


@query("next_review", f"WITH {_QUEUE} SELECT ord, priority FROM q WHERE NOT reviewed ORDER BY priority DESC, ord LIMIT 1")
def next_review(spark, sf_dir):
    """O-FLT-23: the one item to review next."""
    return review.next_item(_queue(spark, sf_dir)).select("ord", "priority")


@query("review_corrections", f"WITH {_QUEUE} SELECT ord, sheet_title, decision AS original_decision, human AS human_decision FROM q WHERE reviewed AND decision <> human")
def review_corrections(spark, sf_dir):
    """O-JOIN-22, O-MISC-1."""
    return review.corrections_of(_queue(spark, sf_dir)).select("ord", "sheet_title", "original_decision", "human_decision")


@query("category_titles", f"""WITH {_QUEUE}, c AS (SELECT * FROM q WHERE reviewed AND decision <> human AND sheet_title <> '')
SELECT category, count(*) AS titles, string_agg(sheet_title, '|' ORDER BY ord) FILTER (r <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS r FROM c) GROUP BY ALL""")
def category_titles(spark, sf_dir):
    """O-AGG-15, O-SORT-11."""
    d = review.category_titles(review.corrections_of(_queue(spark, sf_dir)))
    return d.select("category", "titles", F.array_join("examples", "|").alias("examples"))


@query("review_file", f"""SELECT pdf_filename, page_number, '' AS pdf_hash, coalesce(sheet_number, '') AS sheet_number, coalesce(sheet_title, '') AS extracted_title, printf('%.2f', title_confidence) AS confidence, {_METHODS} AS method,
  CASE WHEN needs_review = 1 THEN 'YES' ELSE 'NO' END AS needs_review, CASE WHEN title_confidence < 0.7 THEN 'Low confidence' WHEN coalesce(trim(sheet_title), '') = '' THEN 'No title found' WHEN o_orderkey % 4 = 0 THEN 'Pattern extraction' ELSE 'Manual review' END AS review_reason,
  '' AS suggested_title, '' AS corrected_title FROM sheets""")
def review_file(spark, sf_dir):
    """O-SINK-7, O-PROJ-6."""
    return sinks.review_csv(_methods(fixtures.sheets(spark, sf_dir)), "o_orderkey")


@query("review_counts", "SELECT count(*) AS total, sum(needs_review)::BIGINT AS review, count(*) FILTER (o_orderkey % 4 = 3) AS drawing_index, count(*) FILTER (o_orderkey % 4 = 1) AS spatial, count(*) FILTER (o_orderkey % 4 = 2) AS vision_api, count(*) FILTER (o_orderkey % 4 = 0) AS pattern, CAST(0 AS BIGINT) AS failed FROM sheets")
def review_counts(spark, sf_dir):
    """O-SINK-8, O-AGG-2."""
    return sinks.review_counts(_methods(fixtures.sheets(spark, sf_dir)))


@query("report_rows", "SELECT pdf_filename, page_number, coalesce(sheet_number, '-') AS sheet_number, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS title FROM (SELECT *, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN sheet_title || ' of the upper and the lower levels of the whole north building' ELSE sheet_title END), ''), '-') AS t FROM sheets)")
def report_rows(spark, sf_dir):
    """O-SINK-9."""
    long = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat("sheet_title", F.lit(" of the upper and the lower levels of the whole north building"))).otherwise(F.col("sheet_title"))
    return sinks.report_rows(fixtures.sheets(spark, sf_dir).withColumn("sheet_title", long))


@query("full_test_summary", "SELECT pdf_filename, count(*) AS pages, count(*) FILTER (sheet_title <> '') AS titles, count(*) FILTER (sheet_number <> '') AS numbers, count(*) FILTER (needs_review = 1) AS to_review, round(avg(title_confidence), 6) AS mean_confidence FROM sheets GROUP BY ALL")
def full_test_summary(spark, sf_dir):
    """O-SINK-18, O-AGG-13."""
    return sinks.full_test_summary(fixtures.sheets(spark, sf_dir))


@query("truth_rows", "SELECT pdf_filename, CAST(page_number AS VARCHAR) AS page_number, coalesce(sheet_number, '') AS sheet_number, coalesce(sheet_title, '') AS sheet_title, '' AS date, '' AS project_name, '' AS confidence, '' AS api_success, '' AS error FROM sheets")
def truth_rows(spark, sf_dir):
    """O-SINK-19."""
    return sinks.truth_rows(fixtures.sheets(spark, sf_dir))


@query("missing_titles", "SELECT pdf_filename, page_number FROM sheets WHERE coalesce(sheet_title, '') = '' AND o_orderkey % 5 <> 0")
def missing_titles(spark, sf_dir):
    """O-FLT-29."""
    return sinks.missing_titles(fixtures.sheets(spark, sf_dir).withColumn("api_success", F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "False").otherwise("True"))).select("pdf_filename", "page_number")


@query("cleaned_truth", "SELECT pdf_filename, page_number, CASE WHEN substr(pdf_filename, 5, 2) < '20' THEN 'HALL ' || substr(pdf_filename, 5, 2) ELSE 'as read' END AS project_name FROM sheets")
def cleaned_truth(spark, sf_dir):
    """O-SINK-20, O-JOIN-20."""
    s = fixtures.sheets(spark, sf_dir)
    two = F.substring("pdf_filename", 5, 2)
    names = s.select("pdf_filename").distinct().where(two < "20").select("pdf_filename", F.concat(F.lit("HALL "), two).alias("name"))
    return sinks.cleaned_truth(s.select("pdf_filename", "page_number", F.lit("as read").alias("project_name")), names)


@query("template_store", "SELECT pdf_filename AS pdf_hash, CASE WHEN substr(pdf_filename, 5, 2) >= '30' THEN 2 ELSE 1 END AS version FROM sheets WHERE substr(pdf_filename, 5, 2) >= '10' GROUP BY ALL")
def template_store(spark, sf_dir):
    """O-SINK-14/15: saved over and deleted."""
    two = F.substring("pdf_hash", 5, 2)
    t = fixtures.sheets(spark, sf_dir).select(F.col("pdf_filename").alias("pdf_hash"), F.lit(1).alias("version")).distinct()
    return sinks.delete_template(sinks.save_template(t, t.where(two >= "30").withColumn("version", F.lit(2))), t.where(two < "10"))


@query("run_status", "SELECT pdf_filename AS id, CASE WHEN count(*) FILTER (needs_review = 1 AND o_orderkey % 5 = 0) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status, count(*) FILTER (needs_review = 1 AND o_orderkey % 5 = 0) AS error_count FROM sheets GROUP BY ALL")
def run_status(spark, sf_dir):
    """O-SINK-5."""
    s = fixtures.sheets(spark, sf_dir)
    bad = (F.col("needs_review") == 1) & (F.pmod("o_orderkey", F.lit(5)) == 0)
    counts = s.groupBy(F.col("pdf_filename").alias("id")).agg(F.count("*").alias("processed_pages"), F.count_if(~bad).alias("success_count"), F.count_if(bad).alias("error_count"))
    runs = store.start_runs(spark.createDataFrame([], store.RUNS), counts.select("id", F.col("id").alias("pdf_path"), F.col("processed_pages").alias("total_pages")))
    return store.complete_runs(store.update_runs(runs, counts), counts.select("id")).select("id", "status", "error_count")


@query("sheets_of_a_set", "SELECT page_number, sheet_number FROM sheets WHERE pdf_filename = 'set_07.pdf' ORDER BY page_number")
def sheets_of_a_set(spark, sf_dir):
    """O-SCAN-16, O-SORT-1: the scan by set is the operator."""
    return store.sheets_of(fixtures.sheets(spark, sf_dir), "set_07.pdf").select("page_number", "sheet_number")


@query("hitl_corrections", "SELECT pdf_filename, page_number, CASE WHEN o_orderkey % 17 = 0 THEN 'Corrected ' || page_number ELSE sheet_title END AS sheet_title, CASE WHEN o_orderkey % 17 = 0 THEN 'hitl_correction' ELSE " + _METHODS + " END AS title_method FROM sheets")
def hitl_corrections(spark, sf_dir):
    """O-SINK-3, O-JOIN-17 with the method."""
    s = _methods(fixtures.sheets(spark, sf_dir))
    fixes = s.where(F.pmod("o_orderkey", F.lit(17)) == 0).select("pdf_filename", "page_number", F.concat(F.lit(" Corrected "), F.col("page_number").cast("string")).alias("corrected_title"))
    return store.apply_corrections(s, fixes).select("pdf_filename", "page_number", "sheet_title", "title_method")


# -- pages ------------------------------------------------------------------------------------------


@query("extract_fields")
def extract_fields(spark, sf_dir):
    """O-PROJ-2/3, O-TT-1/2/4/5, O-SN-1..7: the cascade; tests hold it against cases."""
    s = fixtures.sheets(spark, sf_dir)
    return fields.extract_fields(fixtures.sheet_text(s), fixtures.index_entries(s)).select("pdf_filename", "page_number", "sheet_number", "number_method", "sheet_title", "title_method", F.round("title_confidence", 6).alias("title_confidence"), "needs_review", "is_cover_sheet", "discipline", "confidence")


_READ = """c AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN replace(sheet_number, '0', 'O') WHEN 1 THEN replace(sheet_number, '1', 'l') WHEN 2 THEN 'AD' || o_orderkey % 10 || 'O' WHEN 3 THEN 'X' || sheet_number WHEN 4 THEN 'QOI' ELSE sheet_title END AS t FROM sheets)"""


@query("repaired_numbers", f"""WITH {_READ}, m AS (SELECT o_orderkey, t, CASE WHEN length(t) >= 2 AND substr(t, 1, 2) IN ('AD', 'ST', 'AS', 'EL', 'RC', 'FP', 'SP', 'MP', 'EP') THEN 2 ELSE 1 END AS k FROM c),
x AS (SELECT o_orderkey, t, substr(t, 1, k) || translate(substr(t, k + 1), 'OQIl', '0011') AS made FROM m)
SELECT o_orderkey, coalesce(nullif(regexp_extract(made, '[A-Z]{{1,2}}[-.]?[0-9]{{1,3}}([.][0-9]{{1,2}})?'), ''), made) AS number, coalesce(regexp_matches('SHEET ' || t, '(SHEET|EET|NO[.]?:?)\\s*\\n*\\s*[A-Z][0-9]') OR regexp_matches('SHEET ' || t, '\\b[A-Z][0-9]+[.][0-9]+\\b'), false) AS shown FROM x""")
def repaired_numbers(spark, sf_dir):
    """O-SN-10, O-SN-11."""
    k, n = F.pmod("o_orderkey", F.lit(6)), F.col("sheet_number")
    t = F.when(k == 0, F.replace(n, F.lit("0"), F.lit("O"))).when(k == 1, F.replace(n, F.lit("1"), F.lit("l"))).when(k == 2, F.concat(F.lit("AD"), F.pmod("o_orderkey", F.lit(10)).cast("string"), F.lit("O"))).when(k == 3, F.concat(F.lit("X"), n)).when(k == 4, "QOI").otherwise(F.col("sheet_title"))
    d = fixtures.sheets(spark, sf_dir).select("o_orderkey", t.alias("t"))
    return d.select("o_orderkey", numbers.repaired_candidate(F.col("t")).alias("number"), numbers.edge_text_ok(F.concat(F.lit("SHEET "), F.col("t"))).alias("shown"))


_RULES = """r AS (SELECT o_orderkey, sheet_number AS n, CASE o_orderkey % 7 WHEN 0 THEN '2024' WHEN 1 THEN '4321' WHEN 2 THEN '60601' WHEN 3 THEN '5512' WHEN 4 THEN 'P-77' ELSE sheet_number END AS p,
  ' - ' || coalesce(sheet_title, 'TITLE') || ' : ' AS t, 'cover t1.' || o_orderkey % 10 || ' and T-' || o_orderkey % 1000 AS x, title_confidence AS c FROM sheets)"""
_AROUND = "'at 4321 N. MAIN STREET, IL 60601, call 312-555-5512, issued 1/2/2024'"


@query("page_rules", f"""WITH {_RULES}
SELECT o_orderkey, CASE WHEN upper(t2) IN {_list(fixed.BARE_TITLE_LABELS)} THEN NULL ELSE t2 END AS title, substr(t2, 1, 5) AS opening, 'T1.' || o_orderkey % 10 AS title_sheet, o_orderkey % 7 <= 3 AS false_project,
  CASE WHEN p <> '' AND n <> '' AND c >= 0.5 THEN 'high' WHEN p <> '' AND n <> '' THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(',', CASE WHEN regexp_matches(coalesce(p, ''), '^[A-Z]') THEN 'starts_with_letter' END, CASE WHEN n = p AND n <> '' THEN 'identical_values' END) AS mixed
FROM (SELECT *, trim(regexp_replace(regexp_replace(t, '^[ :-]+', ''), '[ :-]+$', '')) AS t2 FROM r)""")
def page_rules(spark, sf_dir):
    """O-TT-7, O-STR-15, O-SN-7, O-FLT-11, O-PROJ-2, O-FLT-7."""
    s, k = fixtures.sheets(spark, sf_dir), F.col("o_orderkey")
    p = F.pmod(k, F.lit(7))
    p = F.when(p == 0, "2024").when(p == 1, "4321").when(p == 2, "60601").when(p == 3, "5512").when(p == 4, "P-77").otherwise(F.col("sheet_number"))
    d = s.select("o_orderkey", F.col("sheet_number").alias("n"), p.alias("p"), F.concat(F.lit(" - "), F.coalesce("sheet_title", F.lit("TITLE")), F.lit(" : ")).alias("t"),
                 F.concat(F.lit("cover t1."), F.pmod(k, F.lit(10)).cast("string"), F.lit(" and T-"), F.pmod(k, F.lit(1000)).cast("string")).alias("x"), F.col("title_confidence").alias("c"))
    around = F.lit(_AROUND.strip("'"))
    return d.select(
        "o_orderkey", text.clean_title(F.col("t")).alias("title"), text.preview(F.regexp_replace("t", r"^[\s\-:]+|[\s\-:]+$", ""), 5).alias("opening"), numbers.title_sheet_number(F.col("x")).alias("title_sheet"),
        numbers.false_project(F.col("p"), around).alias("false_project"), scores.page_confidence(F.col("n"), F.col("p"), F.col("c") >= 0.5).alias("confidence"),
        F.array_join(pages.contamination(F.col("n"), F.col("p")), ",").alias("mixed"),
    )


_LABELS = _list(fixed.TITLE_LABELS)
_SPANS = """spans AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS ord, ['First Floor Plan', 'SCALE', 'Reflected Ceiling Plan', 'PROJECT: x', 'Notes', 'A wing of the old north building with stairs'][CAST(l_partkey % 6 AS INTEGER) + 1] AS t,
  CAST(l_partkey % 700 AS DOUBLE) AS x0, CAST((l_partkey * 7 + l_suppkey) % 1700 AS DOUBLE) AS y0, CAST(4 + l_partkey % 30 AS DOUBLE) AS size FROM lineitem)"""
_WORDS_ = "(" + " OR ".join(f"regexp_matches(upper(t), {_quote(chr(92) + 'b' + k + chr(92) + 'b')})" for k in fixed.VALID_TITLE_KEYWORDS) + ")"


@query("best_span", f"""WITH {_SPANS},
z AS (SELECT *, CASE WHEN (y0 + 10) / 1728 < 0.15 THEN 'header' WHEN (y0 + 10) / 1728 < 0.65 THEN 'title' ELSE 'info' END AS zone, abs(x0 + 50 - 396) < 792 * 0.2 AS centred FROM spans),
s AS (SELECT *, CASE WHEN upper(t) IN {_LABELS} OR regexp_matches(upper(t), '^(PROJECT|SCALE) *:') OR size < 8 THEN 0 ELSE
    CASE zone WHEN 'title' THEN 20 WHEN 'header' THEN 5 ELSE -10 END + CASE WHEN size > 12 THEN least(CAST(floor((size - 12) / 2) AS INTEGER) * 10, 50) ELSE 0 END + CASE WHEN {_WORDS_} THEN 15 ELSE 0 END
    + CASE WHEN zone = 'title' AND centred THEN 10 ELSE 0 END + CASE WHEN length(t) BETWEEN 10 AND 30 THEN 5 WHEN length(t) > 35 THEN -10 WHEN length(t) < 5 THEN -5 ELSE 0 END END AS score FROM z)
SELECT page, arg_max(t, score * CAST(100000000 AS BIGINT) - ord) AS text, CAST(max(score) AS INTEGER) AS score FROM s WHERE score > 0 GROUP BY page""", "blocks")
def best_span(spark, sf_dir):
    """O-WIN-1, O-SCORE-2, O-FLT-12, O-TT-2, O-MATH-3."""
    p = F.col("l_partkey")
    texts = F.array(*[F.lit(x) for x in ("First Floor Plan", "SCALE", "Reflected Ceiling Plan", "PROJECT: x", "Notes", "A wing of the old north building with stairs")])
    x0, y0 = F.pmod(p, F.lit(700)), F.pmod(p * 7 + F.col("l_suppkey"), F.lit(1700))
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + p).alias("ord"), F.element_at(texts, (F.pmod(p, F.lit(6)) + 1).cast("int")).alias("text"),
        geometry.box(x0, y0, x0 + 100, y0 + 20).alias("box"), (F.pmod(p, F.lit(30)) + 4).cast("double").alias("font_size"), geometry.box(0, 0, 792, 1728).alias("block"))
    return spatial.best_span(d)


@query("touching_boxes", """WITH b AS (SELECT *, x0 + 300 AS x1, y0 + 200 AS y1 FROM blocks)
SELECT a.page, count(*) AS pairs FROM b a JOIN b ON a.page = b.page AND a.pos < b.pos AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY ALL""", "blocks")
def touching_boxes(spark, sf_dir):
    """O-JOIN-23."""
    b = fixtures.blocks(spark, sf_dir).withColumns({"x1": F.col("x0") + 300, "y1": F.col("y0") + 200})
    return spatial.intersecting(b, b).groupBy("page").agg(F.count("*").alias("pairs"))


@query("geometry", """SELECT page, pos, x0 * 0.36::DOUBLE AS px, x0 / 0.36::DOUBLE AS back, CAST(trunc(x0 / 2592 * 1000) AS INTEGER) AS whole, y0 + 0.15 * 200 AS zone_top, y0 + 0.65 * 200 AS zone_bottom,
  x0 + 50 BETWEEN 1000 - 0.05 * 800 AND 1800 + 0.05 * 800 AND y0 + 100 BETWEEN 500 - 0.05 * 600 AND 1100 + 0.05 * 600 AS inside, round(degrees(atan2(y0, x0)), 6) AS angle, round(sqrt(x0 * x0 + y0 * y0), 6) AS length,
  (1296 + x0 / 2592 * 1296) / 2592 AS global_x, CASE WHEN greatest(x0, 1000) < least(x0 + 100, 1800) AND greatest(y0, 500) < least(y0 + 200, 1100) THEN (least(x0 + 100, 1800) - greatest(x0, 1000)) * (least(y0 + 200, 1100) - greatest(y0, 500)) END AS common FROM blocks""", "blocks")
def geometry_(spark, sf_dir):
    """O-MATH-1/2/4/5/8/9, O-FLT-16, O-JOIN-23."""
    d = fixtures.blocks(spark, sf_dir).withColumn("b", geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + 100, F.col("y0") + 200))
    region, zero = geometry.box(1000, 500, 1800, 1100), F.lit(0.0)
    share = geometry.box(F.col("x0") / 2592, 0, 1, 1)
    common = geometry.intersection(F.col("b"), region)
    return d.select(
        "page", "pos", geometry.to_points(F.col("b"))["x0"].alias("px"), geometry.to_pixels(F.col("b"))["x0"].alias("back"), geometry.fraction_to_pixels(share, F.lit(1000), F.lit(1000))["x0"].alias("whole"),
        geometry.title_zone(F.col("b"))["y0"].alias("zone_top"), geometry.title_zone(F.col("b"))["y1"].alias("zone_bottom"), geometry.inside_region(F.col("b"), region).alias("inside"),
        F.round(geometry.line_angle(zero, zero, F.col("x0"), F.col("y0")), 6).alias("angle"), F.round(geometry.line_length(zero, zero, F.col("x0"), F.col("y0")), 6).alias("length"),
        scores.global_x(F.lit(1296), F.lit(1296), F.col("x0") / 2592, F.lit(2592)).alias("global_x"), F.when(common.isNotNull(), geometry.area(common)).alias("common"),
    )


# -- borders -----------------------------------------------------------------------------------------

_PIXELS = "pixels AS (SELECT l_suppkey % 20 AS id, l_linenumber AS page, l_partkey % 40 AS x, l_orderkey % 10 AS y, l_quantity > 20 AS edge, l_quantity AS v FROM lineitem)"


def _pixels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.pmod("l_suppkey", F.lit(20)).alias("id"), F.col("l_linenumber").alias("page"), F.pmod("l_partkey", F.lit(40)).alias("x"), F.pmod("l_orderkey", F.lit(10)).alias("y"), (F.col("l_quantity") > 20).alias("edge"), F.col("l_quantity").alias("v"))


@query("edge_agreement", f"""WITH {_PIXELS} SELECT id, count(*) FILTER (n >= 7) AS seven, count(*) FILTER (n = 7) AS all_, count(*) FILTER (n >= 5) AS majority, count(*) FILTER (n > 0) AS any_ FROM (SELECT id, x, y, count(*) FILTER (edge) AS n FROM pixels GROUP BY ALL) GROUP BY ALL""", "blocks")
def edge_agreement(spark, sf_dir):
    """O-AGG-24, O-SET-7, O-RES-2/7."""
    a = profiles.agreement(_pixels(spark, sf_dir), 7)
    n = _pixels(spark, sf_dir).groupBy("id", "x", "y").agg(F.count_if("edge").alias("n")).groupBy("id").agg(F.count_if(F.col("n") >= 7).alias("seven"))
    return a.groupBy("id").agg(F.count_if("all").alias("all_"), F.count_if("majority").alias("majority"), F.count_if("any").alias("any_")).join(n, "id")


@query("column_counts", f"WITH {_PIXELS} SELECT id, x, count(*) FILTER (edge) AS v FROM pixels GROUP BY ALL", "blocks")
def column_counts(spark, sf_dir):
    """O-AGG-25."""
    return profiles.column_counts(_pixels(spark, sf_dir))


@query("strong_columns", f"""WITH {_PIXELS}, c AS (SELECT id, x, count(*) FILTER (edge) AS v FROM pixels GROUP BY ALL), w AS (SELECT id, max(x) + 1 AS w FROM c GROUP BY ALL)
SELECT id, count(*) AS n, min(x) AS first, max(x) AS last FROM c JOIN w USING (id) WHERE x >= floor(w * 0.5) AND x < floor(w * 0.97) AND v > 0.05 * 100 GROUP BY ALL""", "blocks")
def strong_columns(spark, sf_dir):
    """O-RES-4/8/9."""
    return profiles.strong_columns(profiles.column_counts(_pixels(spark, sf_dir)), 100, 0.05, 0.5, 0.97)


@query("dense_start", f"""WITH {_PIXELS}, c AS (SELECT id, x, count(*) FILTER (edge) AS v FROM pixels GROUP BY ALL), w AS (SELECT id, max(x) + 1 AS w FROM c GROUP BY ALL),
r AS (SELECT c.*, w, floor(w * 0.5) AS s FROM c JOIN w USING (id) WHERE x >= floor(w * 0.5)), m AS (SELECT id, avg(v) FILTER (x >= w - floor((w - s) * 0.1)) AS m FROM r GROUP BY ALL)
SELECT id, min(x) AS x FROM r JOIN m USING (id) WHERE v > m * 0.3 GROUP BY ALL""", "blocks")
def dense_start(spark, sf_dir):
    """O-RES-3."""
    return profiles.dense_start(profiles.column_counts(_pixels(spark, sf_dir)))


@query("steady_box", f"""WITH {_PIXELS}, v AS (SELECT id, x, y, var_pop(v) AS var FROM pixels GROUP BY ALL), c AS (SELECT id, quantile_cont(var, 0.1) AS cut FROM v GROUP BY ALL)
SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v JOIN c USING (id) WHERE var <= cut GROUP BY ALL""", "blocks")
def steady_box(spark, sf_dir):
    """O-RES-1."""
    return profiles.steady_box(_pixels(spark, sf_dir))


_LINES = "lines_ AS (SELECT l_suppkey % 50 AS id, l_partkey % 7 AS cluster, (l_partkey % 1000) / 1000.0::DOUBLE AS pos, (l_orderkey % 100) / 100.0::DOUBLE AS length FROM lineitem)"


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.pmod("l_suppkey", F.lit(50)).alias("id"), F.pmod("l_partkey", F.lit(7)).alias("cluster"), (F.pmod("l_partkey", F.lit(1000)) / 1000).alias("pos"), (F.pmod("l_orderkey", F.lit(100)) / 100).alias("length"))


@query("cluster_summary", f"WITH {_LINES} SELECT id, cluster, round(avg(pos), 9) AS mean, min(pos) AS least, max(pos) AS most, round(sum(length), 6) AS total_length, max(length) AS max_length, count(*) AS segments FROM lines_ GROUP BY ALL", "blocks")
def cluster_summary(spark, sf_dir):
    """O-AGG-22."""
    return profiles.cluster_summary(_lines(spark, sf_dir)).withColumns({"mean": F.round("mean", 9), "total_length": F.round("total_length", 6)})


@query("rightmost_long_line", f"""WITH {_LINES}, g AS (SELECT id, pos, CAST(round(pos * 100) AS BIGINT) AS k FROM lines_ WHERE length > 0.97 AND CAST(pos * 1000 AS BIGINT) % 10 <> 5)
SELECT id, max(k) / 100 AS x FROM (SELECT a.id, a.k, count(*) AS n FROM (SELECT DISTINCT id, k FROM g) a JOIN g b ON a.id = b.id AND abs(b.pos - a.k / 100) < 0.015 GROUP BY ALL) WHERE n >= 2 GROUP BY id""", "blocks")
def rightmost_long_line(spark, sf_dir):
    """O-WIN-10."""
    d = _lines(spark, sf_dir).where(F.pmod(F.round(F.col("pos") * 1000).cast("long"), F.lit(10)) != 5)
    return profiles.rightmost_long_line(d, 0.97)


@query("refined_border", f"""WITH {_LINES}, e AS (SELECT id * 7 + cluster AS id, 0.8 + pos / 20 AS x1, length FROM lines_ WHERE length > 0.96),
m AS (SELECT id, median(x1) AS x1, max(x1) - min(x1) AS spread, count(*) AS n FROM e GROUP BY ALL)
SELECT id, round(x1, 9) AS x1, round(spread, 9) AS spread, CASE WHEN n = 1 THEN 0.7 WHEN spread < 0.02 THEN 0.95 WHEN spread < 0.05 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN n = 1 THEN 'ai_vision_single' ELSE 'ai_vision_multi' END AS method, n FROM m""", "blocks")
def refined_border(spark, sf_dir):
    """O-AGG-21, O-MATH-7."""
    e = _lines(spark, sf_dir).where("length > 0.96").select((F.col("id") * 7 + F.col("cluster")).alias("id"), (0.8 + F.col("pos") / 20).alias("x1"))
    return profiles.refined_border(e).withColumns({"x1": F.round("x1", 9), "spread": F.round("spread", 9)})


@query("compared_methods", """WITH e AS (SELECT vec_id AS id, v AS a, CASE WHEN x % 2 = 0 THEN v + 0.01 END AS b, CASE WHEN x % 3 = 0 THEN v * 1.2 END AS c, x FROM profile WHERE x < 6)
SELECT id * 6 + x AS id, a AS cv, b AS hybrid, c AS ai, CASE WHEN (b IS NOT NULL) OR (c IS NOT NULL) THEN round(greatest(a, b, c) - least(a, b, c), 9) + 0.0 END AS spread, CASE WHEN (b IS NOT NULL) OR (c IS NOT NULL) THEN round(greatest(a, b, c) - least(a, b, c), 9) < 0.03 END AS agree FROM e""", "profile")
def compared_methods(spark, sf_dir):
    """O-RES-12."""
    p = _profile(spark, sf_dir).where("x < 6").withColumn("id", F.col("id") * 6 + F.col("x"))
    all_ = F.array(F.struct(F.lit("cv").alias("method"), F.col("v").alias("x1")), F.struct(F.lit("hybrid").alias("method"), F.when(F.col("x") % 2 == 0, F.col("v") + 0.01).alias("x1")), F.struct(F.lit("ai").alias("method"), F.when(F.col("x") % 3 == 0, F.col("v") * 1.2).alias("x1")))
    d = profiles.compared_methods(p.select("id", F.explode(all_).alias("m")).select("id", "m.*").where("x1 is not null"), ["cv", "hybrid", "ai"])
    return d.withColumns({"spread": F.round("spread", 9) + 0.0, "agree": F.round("spread", 9) < 0.03})


@query("page_angles", """WITH s AS (SELECT l_suppkey % 30 AS page, degrees(atan2((l_partkey % 11) * 10.0 - 20, (l_orderkey % 5) * 10.0)) AS a FROM lineitem WHERE l_linenumber <= 3),
c AS (SELECT page, count(*) AS lines, count(*) FILTER (abs(a - 90) < 10 OR abs(a + 90) < 10) AS up, count(*) FILTER (abs(a) < 10) AS flat, count(*) FILTER (abs(a) % 90 < 5 OR abs(a) % 90 > 85) AS straight FROM s GROUP BY ALL)
SELECT page, CASE WHEN lines >= 10 AND up > flat * 1.5 THEN 90 ELSE 0 END AS angle, CASE WHEN lines < 10 THEN 0 WHEN up > flat * 1.5 THEN up / lines ELSE straight / lines END AS confidence, lines FROM c""", "blocks")
def page_angles(spark, sf_dir):
    """O-AGG-29."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 3")
    zero = F.lit(0.0)
    return profiles.page_angles(d.select(F.pmod("l_suppkey", F.lit(30)).alias("page"), zero.alias("x1"), zero.alias("y1"), (F.pmod("l_orderkey", F.lit(5)) * 10.0).alias("x2"), (F.pmod("l_partkey", F.lit(11)) * 10.0 - 20).alias("y2")))


@query("best_region", """WITH r AS (SELECT l_orderkey AS page, CAST(l_linenumber AS INTEGER) AS ord, 'region_' || l_linenumber AS region, CAST(l_partkey % 5 AS INTEGER) AS keywords, (l_suppkey % 10) / 10.0::DOUBLE AS density FROM lineitem),
b AS (SELECT page, arg_max(struct_pack(r := region, k := keywords, s := keywords + CASE WHEN density > 0.5 THEN 0.5 ELSE 0 END), (keywords + CASE WHEN density > 0.5 THEN 0.5 ELSE 0 END) * 100 - ord) FILTER (keywords >= 2) AS b FROM r GROUP BY ALL)
SELECT page, coalesce(b.r, 'bottom_right_tight') AS region, coalesce(b.k, 0) AS keywords, coalesce(b.s, 0)::DOUBLE AS score, CASE WHEN b IS NULL THEN 'LOW' WHEN b.k >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM b""", "blocks")
def best_region(spark, sf_dir):
    """O-SCORE-8, O-IMG-12."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("ord"), F.concat(F.lit("region_"), F.col("l_linenumber").cast("string")).alias("region"), F.pmod("l_partkey", F.lit(5)).cast("int").alias("keywords"),
        (F.pmod("l_suppkey", F.lit(10)) / 10).alias("density"))
    return profiles.best_region(d, 0.5)


@query("final_border", """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN 0.7 + (o_orderkey % 23) / 100.0::DOUBLE END AS a, CASE WHEN o_orderkey % 4 > 0 THEN 0.7 + (o_orderkey % 19) / 100.0::DOUBLE END AS b, (o_orderkey % 11) / 10.0::DOUBLE AS ca FROM orders)
SELECT o_orderkey, round(CASE WHEN a IS NULL THEN 0.85 WHEN b IS NULL OR ca >= 0.95 THEN a ELSE least(a, b) END, 9) AS balanced, round(CASE WHEN a IS NULL THEN 0.85 WHEN b IS NULL OR ca >= 0.95 THEN a ELSE greatest(a, b) END, 9) AS conservative,
  CASE WHEN a IS NULL THEN 'no_images' WHEN ca >= 0.95 THEN 'coarse' WHEN b IS NULL THEN 'coarse_fallback' ELSE 'balanced' END AS method FROM e""", "blocks")
def final_border(spark, sf_dir):
    """O-SCORE-10/11, O-MISC-5, O-IMG-16."""
    k = F.col("o_orderkey")
    a = F.when(F.pmod(k, F.lit(9)) > 0, 0.7 + F.pmod(k, F.lit(23)) / 100)
    b = F.when(F.pmod(k, F.lit(4)) > 0, 0.7 + F.pmod(k, F.lit(19)) / 100)
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", a.alias("a"), b.alias("b"), (F.pmod(k, F.lit(11)) / 10).alias("ca"))
    made = lambda how: scores.final_border(F.col("a"), F.col("ca"), F.lit("coarse"), F.col("b"), F.lit(0.8), how)
    return d.select("o_orderkey", F.round(made("balanced")["x1"], 9).alias("balanced"), F.round(made("conservative")["x1"], 9).alias("conservative"), made("balanced")["method"].alias("method"))


# -- files and streams ------------------------------------------------------------------------------


@query("source_files", """WITH n AS (SELECT DISTINCT replace(pdf_filename, '.pdf', '') AS pdf_name FROM sheets)
SELECT pdf_name, '/in/' || CASE WHEN CAST(substr(pdf_name, 5) AS INTEGER) % 2 = 0 THEN pdf_name || '.pdf' ELSE 'Set-' || substr(pdf_name, 5) || ' final.PDF' END AS path FROM n""")
def source_files(spark, sf_dir):
    """O-JOIN-18: exact names, names with an extension, and openings of normalised names."""
    names = fixtures.sheets(spark, sf_dir).select(F.regexp_replace("pdf_filename", r"\.pdf$", "").alias("pdf_name")).distinct()
    two = F.substring("pdf_name", 5, 2)
    file = F.when(two.cast("int") % 2 == 0, F.concat("pdf_name", F.lit(".pdf"))).otherwise(F.concat(F.lit("Set-"), two, F.lit(" final.PDF")))
    files = names.select(file.alias("file"), F.concat(F.lit("/in/"), file).alias("path"), two.cast("int").alias("ord"))
    return content.source_files(names, files)


@query("crop_files", "SELECT pdf_filename, page_number, '/crops/' || left(md5(pdf_filename), 8) || '/p' || lpad(CAST(page_number AS VARCHAR), 3, '0') || '_titleblock.png' AS crop FROM sheets WHERE page_number < 100 AND page_number % 3 = 0")
def crop_files(spark, sf_dir):
    """O-JOIN-19, O-SCAN-19, O-SINK-22."""
    s = fixtures.sheets(spark, sf_dir).withColumn("pdf_hash", F.md5("pdf_filename"))
    crops = s.where("page_number < 100 and page_number % 3 = 0").select(F.concat(F.lit("/crops/"), sinks.crop_name(F.col("pdf_hash"), F.col("page_number"))).alias("path"))
    return content.crop_files(s, crops).select("pdf_filename", "page_number", "crop")


@query("windowed_counts", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL", "blocks")
def windowed_counts(spark, sf_dir):
    """Tumbling windows over a stream of events, drained to its end; no survey operator, the streaming counterpart of O-AGG-2."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"))
    return ingest.drain(ingest.windowed_counts(e, "1 hour"), "windowed_counts_drained").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
