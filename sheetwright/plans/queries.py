"""The queries of the document model and their SQL; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, numbers, scores, text, titles
from ..operators import accuracy, classify, index, learn, profiles, review, spatial, store
from ..rules import fixed
from ..rules.build import categories
from ..sources import sinks
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = {"sheets": fixtures.SHEETS_SQL, "entries": fixtures.INDEX_SQL, "truth": fixtures.TRUTH_SQL, "blocks": fixtures.BLOCKS_SQL, "profile": fixtures.PROFILE_SQL}


def query(name: str, sql: str | None = None, needs: str = "sheets"):
    """Register a query, and its SQL behind the fixtures it needs."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            parts = [_WITH[n] for n in needs.split()]
            body = sql.strip()
            start = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            ORACLE_SQL[name] = start + ",\n".join(parts) + (",\n" + body[len(start):] if body.startswith("WITH ") else "\n" + body)
        return f

    return register


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


def _any(x: str, patterns, flags: str = "i") -> str:
    """Whether any pattern is found, each tried by itself."""
    return "(" + " OR ".join(f"regexp_matches({x}, {_quote(p)}, '{flags}')" for p in patterns) + ")"


# -- classification ----------------------------------------------------------------

_PATTERNS = ", ".join(f"({i}, {_quote(c)}, {_quote(p)})" for i, (c, v) in enumerate(categories().items()) for p in v["title"])
_RELEVANCE = ", ".join(f"({_quote(c)}, {_quote(r)})" for c, r in fixed.PAINTING_RELEVANCE.items())
_NCS = ", ".join(f"({_quote(d)}, {'NULL' if t is None else t}, {_quote(r)})" for (d, t), r in fixed.NCS_RELEVANCE.items())
_SEP = r"(?i)(\n|\s+AND\s+|\s+&\s+|\s+/\s+|\s+-\s+-\s+)"
_TYPES = "CASE " + " ".join(f"WHEN {_any('part', ps)} THEN {_quote(t)}" for t, ps in fixed.DRAWING_TYPES.items()) + " END"

_CLASSIFIED = f"""patterns(ord, category, pattern) AS (VALUES {_PATTERNS}),
relevance(category, level) AS (VALUES {_RELEVANCE}),
ncs(discipline, kind, level) AS (VALUES {_NCS}),
rows_ AS MATERIALIZED (
  SELECT o_orderkey AS id, pdf_filename, page_number, sheet_number AS n, sheet_title AS t, substr(sheet_number, 1, 1) AS d,
         CASE WHEN regexp_full_match(sheet_number, '[A-Z]{{1,2}}[-.]?[0-9]{{2,4}}(\\.[0-9]{{1,2}})?') THEN CAST(regexp_extract(sheet_number, '[0-9]') AS INTEGER) END AS kind
  FROM sheets),
pieces AS MATERIALIZED (
  SELECT id, part, {_TYPES} AS kind, k FROM (
    SELECT id, unnest(regexp_split_to_array(t, {_quote(_SEP)})) AS part, generate_subscripts(regexp_split_to_array(t, {_quote(_SEP)}), 1) AS k FROM rows_ WHERE t <> '') WHERE trim(part) <> ''),
shape AS (
  SELECT id, count(*) >= 2 AND (count(DISTINCT kind) >= 2 OR count(*) FILTER (length(part) >= 5) >= 2) AS combo FROM pieces GROUP BY id),
parts AS MATERIALIZED (
  SELECT r.id, CASE WHEN s.combo THEN trim(p.part) ELSE r.t END AS part, p.k FROM rows_ r JOIN shape s USING (id) JOIN pieces p USING (id) WHERE s.combo OR p.k = 1),
hit AS MATERIALIZED (
  SELECT DISTINCT p.part, m.ord, m.category FROM (SELECT DISTINCT part FROM parts) p JOIN patterns m ON regexp_matches(p.part, m.pattern, 'i')),
first_signals AS MATERIALIZED (
  SELECT id, category, 0.9::DOUBLE * 1.0::DOUBLE * 0.4::DOUBLE AS score, 1000 + k * 100 + ord AS ord FROM (
    SELECT p.id, p.k, h.ord, h.category FROM parts p JOIN hit h ON h.part = p.part)
  UNION ALL
  SELECT id, category, 0.7::DOUBLE * 1.0::DOUBLE * 0.25::DOUBLE, 0 FROM (
    SELECT id, CASE WHEN d IN ('A', 'I') THEN CASE kind WHEN 1 THEN 'floor_plans' WHEN 2 THEN 'elevations' WHEN 6 THEN 'room_finish_schedules' WHEN 0 THEN 'cover_sheets' END
                    WHEN d IN ('S', 'M', 'E', 'P', 'C', 'L') THEN 'properly_classified_not_needed' END AS category
    FROM rows_ WHERE kind IS NOT NULL) WHERE category IS NOT NULL),
signals AS MATERIALIZED (
  SELECT * FROM first_signals
  UNION ALL
  SELECT id, 'properly_classified_not_needed', CASE WHEN by_title THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END * 1.0::DOUBLE * 0.4::DOUBLE, 0 FROM (
    SELECT id, coalesce({_any('t', fixed.NOT_NEEDED_TITLE)}, false) AS by_title, coalesce({_any('n', fixed.NOT_NEEDED_NUMBER)}, false) AS by_number
    FROM rows_ WHERE id NOT IN (SELECT id FROM first_signals)) WHERE by_title OR by_number),
sums AS (SELECT id, category, list_sum(list(score ORDER BY ord)) AS score, min(ord) AS ord FROM signals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM sums),
tops AS (
  SELECT r.id, r.pdf_filename, r.page_number, r.d, r.kind, a.category AS top, a.score AS s1, b.score AS s2, coalesce(s.combo, false) AS is_combo,
         coalesce(g.n, 0) AS n
  FROM rows_ r LEFT JOIN (SELECT id, count(*) AS n FROM signals GROUP BY id) g ON g.id = r.id LEFT JOIN ranked a ON a.id = r.id AND a.r = 1 LEFT JOIN ranked b ON b.id = r.id AND b.r = 2 LEFT JOIN shape s ON s.id = r.id),
judged AS (
  SELECT t.*, coalesce(s2 / s1 >= 0.5, false) AS has_conflict,
         CASE WHEN d IN ('S', 'M', 'E', 'P', 'C', 'L', 'F', 'T', 'Q') THEN 'IRRELEVANT' ELSE coalesce(v.level, 'REFERENCE') END AS relevance,
         greatest(0, least(s1 / 0.25, 1) - CASE WHEN s2 / s1 >= 0.5 THEN 0.15::DOUBLE * (s2 / s1) ELSE 0 END - CASE WHEN is_combo THEN 0.1::DOUBLE ELSE 0 END) AS c
  FROM tops t LEFT JOIN relevance v ON v.category = t.top),
final AS (
  SELECT *, CASE WHEN s1 IS NULL THEN 0 WHEN n >= 3 THEN least(1, c + 0.05::DOUBLE * (n - 2)) ELSE c END AS confidence FROM judged),
decided AS (
  SELECT id, pdf_filename, page_number, top AS category, relevance, round(confidence, 6) AS confidence, is_combo, has_conflict, n,
         CASE WHEN has_conflict THEN 'NEEDS_EVALUATION' WHEN relevance = 'IRRELEVANT' AND confidence >= 0.85 THEN 'DEFINITELY_NOT_NEEDED'
              WHEN relevance IN ('PRIMARY', 'SECONDARY') AND confidence >= 0.85 THEN 'DEFINITELY_NEEDED' ELSE 'NEEDS_EVALUATION' END AS decision
  FROM final)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(fixtures.sheets(spark, sf_dir))


@query("classify_sheets", f"WITH {_CLASSIFIED} SELECT pdf_filename, page_number, category, relevance, confidence, is_combo, has_conflict, CAST(n AS INTEGER) AS n_signals, decision FROM decided")
def classify_sheets(spark, sf_dir):
    """O-CLS-1..6, O-AGG-5, O-WIN-2, O-SCORE-4..7, O-TT-15."""
    return _classified(spark, sf_dir).select(
        "pdf_filename", "page_number", F.get("categories", F.lit(0)).alias("category"), "relevance", F.round("confidence", 6).alias("confidence"),
        "is_combo", "has_conflict", F.size("signals").alias("n_signals"), "decision",
    )


@query("decision_counts", f"WITH {_CLASSIFIED} SELECT decision, relevance, count(*) AS sheets, round(avg(confidence), 6) AS mean_confidence FROM decided GROUP BY ALL")
def decision_counts(spark, sf_dir):
    """O-AGG-6, O-FLT-24: the flagship: tiers by relevance."""
    return _classified(spark, sf_dir).groupBy("decision", "relevance").agg(F.count("*").alias("sheets"), F.round(F.avg(F.round("confidence", 6)), 6).alias("mean_confidence"))


@query("classification_statistics", f"""WITH {_CLASSIFIED}
SELECT 'decision' AS kind, decision AS name, count(*) AS n FROM decided GROUP BY ALL
UNION ALL SELECT 'relevance', relevance, count(*) FROM decided GROUP BY ALL
UNION ALL SELECT 'combo', CAST(is_combo AS VARCHAR), count(*) FROM decided GROUP BY ALL
UNION ALL SELECT 'review', CAST(decision = 'NEEDS_EVALUATION' OR confidence < 0.7 AS VARCHAR), count(*) FROM decided GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM sums GROUP BY ALL
UNION ALL SELECT 'total', 'all', count(*) FROM decided HAVING count(*) > 0""")
def classification_statistics(spark, sf_dir):
    """O-AGG-6."""
    return classify.statistics(_classified(spark, sf_dir))


@query("category_buckets", f"""WITH {_CLASSIFIED}
SELECT category, pdf_filename, count(*) AS sheets FROM sums JOIN rows_ USING (id) WHERE category <> 'elevations' GROUP BY ALL""")
def category_buckets(spark, sf_dir):
    """O-SINK-10/11, O-SET-6: sheets of each bucket and set."""
    return classify.bucketed(_classified(spark, sf_dir)).groupBy("category", "pdf_filename").agg(F.count("*").alias("sheets"))


@query("review_queue", f"""WITH {_CLASSIFIED}
SELECT pdf_filename, page_number, greatest(CASE WHEN is_combo THEN 1 ELSE 0 END, CASE WHEN confidence < 0.5 THEN 2 ELSE 0 END, CASE WHEN has_conflict THEN 2 ELSE 0 END, CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS priority
FROM decided WHERE decision = 'NEEDS_EVALUATION' OR confidence < 0.7""")
def review_queue(spark, sf_dir):
    """O-FLT-21/22, O-SCORE-9."""
    return review.review_queue(_classified(spark, sf_dir)).select("pdf_filename", "page_number", "priority")


@query("content_triggers", f"""WITH {_CLASSIFIED}
SELECT d.pdf_filename, d.page_number, (d.confidence < 0.65 OR d.is_combo OR d.has_conflict OR d.category IS NULL OR coalesce({_any('r.t', fixed.AMBIGUOUS_TITLES)}, false)) AS analyze,
       CASE WHEN d.confidence < 0.65 OR d.has_conflict OR d.category IS NULL THEN 2 WHEN d.is_combo OR coalesce({_any('r.t', fixed.AMBIGUOUS_TITLES)}, false) THEN 1 ELSE 0 END AS priority
FROM decided d JOIN rows_ r USING (id)""")
def content_triggers(spark, sf_dir):
    """O-FLT-19/20, O-CLS-9."""
    c = _classified(spark, sf_dir)
    t = scores.triggers(F.col("confidence"), F.col("is_combo"), F.col("has_conflict"), F.col("sheet_title"), F.col("categories"))
    return c.select("pdf_filename", "page_number", t["analyze"].alias("analyze"), t["priority"].alias("priority"))


_SAFE = lambda x, n: f"coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(coalesce({x}, 'untitled'), '[<>:\"/\\\\|?*\\s]+', '_', 'g'), '^_+|_+$', '', 'g'), {n}), '_+$', ''), ''), 'untitled')"
_FOLDERS = _list(k for k, v in categories().items() if v.get("folder"))


@query("organize_plan", f"""WITH {_CLASSIFIED}
SELECT pdf_filename, page_number, category, category || '/' || {_SAFE("regexp_replace(pdf_filename, '[.]pdf$', '')", 40)} || '_' || {_SAFE('n', 20)} || '_' || {_SAFE('t', 50)} || '.pdf' AS target
FROM sums JOIN rows_ USING (id) WHERE category IN {_FOLDERS}""")
def organize_plan(spark, sf_dir):
    """O-SINK-12, O-PROJ-12, O-SET-8, O-STR-9."""
    return sinks.organize_plan(_classified(spark, sf_dir))


_REPORTED = """reported AS (
  SELECT f.id, f.pdf_filename, f.page_number, r.n AS sheet_number, r.t AS sheet_title, d.decision, f.relevance, f.confidence, f.is_combo, f.has_conflict, f.n AS signals, s.title_confidence,
         c.categories, d.category AS top,
         CASE WHEN d.decision = 'NEEDS_EVALUATION' THEN CASE WHEN f.has_conflict THEN 'Conflicting classification signals' WHEN f.confidence < 0.7 THEN printf('Low confidence (%.2f)', f.confidence)
                WHEN f.is_combo THEN 'Combo page with multiple drawings' ELSE 'Classification uncertain' END
              WHEN f.confidence < 0.7 THEN printf('Confidence below threshold (%.2f)', f.confidence) END AS review_reason,
         CASE d.decision WHEN 'DEFINITELY_NEEDED' THEN 'matched' WHEN 'DEFINITELY_NOT_NEEDED' THEN 'not_needed' ELSE CASE WHEN d.category IS NULL THEN 'unclassified' ELSE 'matched' END END AS kind
  FROM final f JOIN decided d USING (id) JOIN rows_ r USING (id) JOIN sheets s ON s.o_orderkey = f.id
  LEFT JOIN (SELECT id, string_agg(category, ';' ORDER BY r) AS categories FROM ranked GROUP BY id) c ON c.id = f.id)"""


@query("classification_csv", f"""WITH {_CLASSIFIED},
{_REPORTED}
SELECT pdf_filename AS pdf_name, page_number, sheet_number, sheet_title, decision, relevance, categories, kind AS classification_type,
  CASE WHEN confidence <> 0 THEN printf('%.3f', confidence) ELSE '' END AS classification_confidence, '' AS number_confidence, CASE WHEN title_confidence <> 0 THEN printf('%.3f', title_confidence) ELSE '' END AS title_confidence,
  is_combo AS is_combo_page, review_reason IS NOT NULL AS needs_review, coalesce(review_reason, '') AS review_reason
FROM reported JOIN sums USING (id) WHERE category <> 'elevations'""")
def classification_csv(spark, sf_dir):
    """O-SINK-10, O-SORT-5/6, O-PROJ-8, O-FLT-21."""
    return sinks.classification_csv(_classified(spark, sf_dir))


@query("manifest", f"""WITH {_CLASSIFIED}
SELECT category, pdf_filename, count(*) AS n, string_agg(page_number || ':' || coalesce(n, ''), ';' ORDER BY page_number) AS pages FROM sums JOIN rows_ USING (id) WHERE category <> 'elevations' GROUP BY ALL""")
def manifest(spark, sf_dir):
    """O-SINK-11."""
    shown = F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), F.coalesce(p["sheet_number"], F.lit(""))))
    return sinks.manifest(_classified(spark, sf_dir)).select("category", "pdf_filename", F.size("pages").cast("long").alias("n"), F.array_join(shown, ";").alias("pages"))


# -- numbers -----------------------------------------------------------------------


@query("parse_numbers", f"""SELECT DISTINCT sheet_number, substr(sheet_number, 1, 1) AS discipline, CAST(substr(sheet_number, 2, 1) AS INTEGER) AS sheet_type, CAST(substr(sheet_number, 3) AS INTEGER) AS sequence,
  coalesce((SELECT r FROM (VALUES {_NCS}) v(d, k, r) WHERE d = substr(sheet_number, 1, 1) AND k = CAST(substr(sheet_number, 2, 1) AS INTEGER)),
           (SELECT r FROM (VALUES {_NCS}) v(d, k, r) WHERE d = substr(sheet_number, 1, 1) AND k IS NULL), 'REFERENCE') AS relevance
FROM sheets WHERE sheet_number IS NOT NULL""")
def parse_numbers(spark, sf_dir):
    """O-STR-12, O-JOIN-12, O-CLS-2."""
    p = numbers.parsed(F.col("sheet_number"))
    s = fixtures.sheets(spark, sf_dir).select("sheet_number").distinct().where("sheet_number is not null").select("sheet_number", p.alias("p"))
    return s.select("sheet_number", "p.discipline", "p.sheet_type", "p.sequence", "p.relevance")


_TRIED = "(SELECT CASE o_orderkey % 9 WHEN 0 THEN sheet_title WHEN 1 THEN 'T.O' WHEN 2 THEN 'DWG' WHEN 3 THEN '1' || sheet_number WHEN 4 THEN sheet_number || '.1' WHEN 5 THEN sheet_number || 'XX' WHEN 6 THEN 'A' ELSE sheet_number END AS v FROM sheets)"


def _tried(spark, sf_dir):
    k, n = F.pmod("o_orderkey", F.lit(9)), F.col("sheet_number")
    v = F.when(k == 0, F.col("sheet_title")).when(k == 1, "T.O").when(k == 2, "DWG").when(k == 3, F.concat(F.lit("1"), n)).when(k == 4, F.concat(n, F.lit(".1"))).when(k == 5, F.concat(n, F.lit("XX"))).when(k == 6, "A").otherwise(n)
    return fixtures.sheets(spark, sf_dir).select(v.alias("v"))


@query("number_validity", f"""WITH c AS (SELECT v, upper(trim(v)) AS u FROM {_TRIED})
SELECT v, reason, reason = 'valid' AS ok, count(*) AS n FROM (
  SELECT v, CASE WHEN coalesce(v, '') = '' THEN 'empty_or_none' WHEN length(u) < 2 THEN 'too_short:' || length(u) WHEN length(u) > 10 THEN 'too_long:' || length(u)
    WHEN NOT regexp_matches(u, '^[A-Z]') THEN 'no_letter_prefix' WHEN NOT regexp_matches(u, '[0-9]') THEN 'no_digits' WHEN u IN {_list(fixed.NUMBER_BLACKLIST)} THEN 'blacklisted:' || u
    WHEN replace(u, '.', '') IN {_list(fixed.NUMBER_BLACKLIST)} THEN 'blacklisted:' || replace(u, '.', '')
    WHEN NOT regexp_full_match(u, '[A-Z]{{1,2}}[-.]?[0-9]{{1,4}}([.][0-9]{{1,2}})?') THEN 'pattern_mismatch' ELSE 'valid' END AS reason FROM c) GROUP BY ALL""")
def number_validity(spark, sf_dir):
    """O-FLT-3."""
    c = numbers.number_check(F.col("v"))
    return _tried(spark, sf_dir).select("v", c["reason"].alias("reason"), c["ok"].alias("ok")).groupBy("v", "reason", "ok").agg(F.count("*").alias("n"))


@query("number_candidates", f"""SELECT v, length(v) BETWEEN 2 AND 8 AND regexp_matches(v, '^[A-Z]') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 1 AND 3 AS fits, count(*) AS n FROM {_TRIED} GROUP BY ALL""")
def number_candidates(spark, sf_dir):
    """O-FLT-9."""
    return _tried(spark, sf_dir).groupBy("v", numbers.candidate_shape(F.col("v")).alias("fits")).agg(F.count("*").alias("n"))


@query("number_variants", """SELECT sheet_number, unnest([sheet_number, substr(sheet_number, 1, 2) || '.' || substr(sheet_number, 3), substr(sheet_number, 1, 3) || '.' || substr(sheet_number, 4), substr(sheet_number, 1, 1) || '-' || substr(sheet_number, 2)]) AS variant,
  unnest([0, 1, 2, 3]) AS step FROM (SELECT DISTINCT sheet_number FROM sheets WHERE sheet_number IS NOT NULL)""")
def number_variants(spark, sf_dir):
    """O-STR-13."""
    d = fixtures.sheets(spark, sf_dir).where("sheet_number is not null").select("sheet_number").distinct()
    return d.select("sheet_number", F.posexplode(numbers.variants(F.col("sheet_number"))).alias("step", "variant"))


@query("disciplines", f"""SELECT coalesce(m.name, CASE WHEN sheet_number IS NOT NULL THEN 'Unknown' END) AS discipline, count(*) AS n
FROM sheets LEFT JOIN (VALUES {', '.join(f"({_quote(k)}, {_quote(v)})" for k, v in fixed.DISCIPLINE_CODES.items())}) m(letter, name) ON letter = substr(sheet_number, 1, 1) GROUP BY 1""")
def disciplines(spark, sf_dir):
    """O-PROJ-4."""
    return fixtures.sheets(spark, sf_dir).groupBy(numbers.discipline_of(F.col("sheet_number")).alias("discipline")).agg(F.count("*").alias("n"))


@query("numbers_from_text", """SELECT pdf_filename, page_number, CASE WHEN o_orderkey % 5 < 4 THEN sheet_number END AS found FROM sheets""")
def numbers_from_text(spark, sf_dir):
    """O-SN-1, O-SN-3, O-SN-5, O-WIN-4/5, O-STR-2/3."""
    return fixtures.sheet_text(fixtures.sheets(spark, sf_dir)).select("pdf_filename", "page_number", numbers.number_from_text(F.col("text")).alias("found"))


# -- titles -------------------------------------------------------------------------

_GARBAGE = "(" + " OR ".join(f"regexp_matches(t, {_quote(p)}, '{'i' if i else 'c'}')" for p, i in fixed.TITLE_GARBAGE) + ")"
_GNAME = "CASE " + " ".join(f"WHEN regexp_matches(t, {_quote(p)}, '{'i' if i else 'c'}') THEN {_quote(p[:30].replace(chr(92), ''))}" for p, i in fixed.TITLE_GARBAGE) + " END"
_KEY = "(" + " OR ".join(f"regexp_matches(upper(t), {_quote(chr(92) + 'b' + k + 'S?' + chr(92) + 'b')})" for k in fixed.VALID_TITLE_KEYWORDS) + ")"
_WORDS = "len(string_split(t, ' '))"
_TITLED = "(SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN sheet_title WHEN 1 THEN upper(sheet_title) WHEN 2 THEN sheet_title || ' ' || o_orderkey % 50 ELSE 'Level ' || o_orderkey % 9 END AS t FROM sheets)"


def _titled(spark, sf_dir):
    k, t = F.pmod("o_orderkey", F.lit(4)), F.col("sheet_title")
    v = F.when(k == 0, t).when(k == 1, F.upper(t)).when(k == 2, F.concat(t, F.lit(" "), F.pmod("o_orderkey", F.lit(50)).cast("string"))).otherwise(F.concat(F.lit("Level "), F.pmod("o_orderkey", F.lit(9)).cast("string")))
    return fixtures.sheets(spark, sf_dir).select(v.alias("t")).distinct()


@query("quality_gate", f"""SELECT t, reason, split_part(reason, ':', 1) IN ('valid_single_word', 'keyword_with_context', 'keyword_long', 'single_keyword_valid', 'multi_word') AS ok FROM (
  SELECT t, CASE WHEN coalesce(t, '') = '' THEN 'empty_title' WHEN length(t) < 3 THEN 'too_short:' || length(t) WHEN {_GARBAGE} THEN 'garbage_pattern:' || {_GNAME}
    WHEN upper(t) IN {_list(fixed.SINGLE_KEYWORD_REJECTS)} THEN 'single_keyword:' || upper(t) WHEN upper(t) IN {_list(fixed.VALID_SINGLE_WORDS)} THEN 'valid_single_word:' || upper(t)
    WHEN {_KEY} AND {_WORDS} >= 2 THEN 'keyword_with_context:' || {_WORDS} || '_words' WHEN {_KEY} AND length(t) >= 15 THEN 'keyword_long:' || length(t) || '_chars'
    WHEN {_KEY} THEN 'single_keyword_valid:' || upper(t) WHEN {_WORDS} >= 2 AND length(t) >= 8 THEN 'multi_word:' || {_WORDS} || '_words' ELSE 'insufficient_context' END AS reason FROM {_TITLED})""")
def quality_gate(spark, sf_dir):
    """O-FLT-4."""
    g = titles.quality_gate(F.col("t"))
    return _titled(spark, sf_dir).select("t", g["reason"].alias("reason"), g["ok"].alias("ok"))


_CASED = """CASE WHEN t = upper(t) AND t <> lower(t) THEN array_to_string(list_transform(string_split(t, ' '), lambda w, i:
  CASE WHEN w IN {ac} THEN w WHEN i > 1 AND lower(w) IN {small} THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') ELSE t END""".replace("{ac}", _list(fixed.TITLE_ACRONYMS)).replace("{small}", _list(fixed.SMALL_WORDS))


@query("validate_titles", f"""WITH v AS (SELECT t, {_GARBAGE} AS bad, {_KEY} AS key FROM {_TITLED})
SELECT t, coalesce(t <> '' AND length(t) >= 3 AND NOT bad, false) AS is_valid, CASE WHEN t <> '' AND length(t) >= 3 AND NOT bad THEN {_CASED} END AS title,
       CASE WHEN t <> '' AND length(t) >= 3 AND NOT bad THEN round(0.8::DOUBLE + CASE WHEN key THEN 0.05 ELSE 0 END - CASE WHEN length(t) > 60 THEN 0.1 ELSE 0 END - CASE WHEN length(t) < 15 AND NOT key THEN 0.05 ELSE 0 END, 6) ELSE 0 END AS confidence FROM v""")
def validate_titles(spark, sf_dir):
    """O-FLT-28, O-SCORE-1, O-STR-4/5."""
    d = _titled(spark, sf_dir).select("t", titles.validated_title(F.col("t"), F.lit("spatial")).alias("v"))
    return d.select("t", "v.is_valid", "v.title", F.round("v.confidence", 6).alias("confidence"))


_LEARN_KEY = "(" + " OR ".join(f"contains(upper(t), {_quote(k)})" for k in fixed.QUALITY_KEYWORDS) + ")"
_LEARN = f"""CASE WHEN coalesce(trim(t), '') = '' THEN 'empty' WHEN length(t) < 5 THEN 'too_short' WHEN {_any('t', fixed.GARBAGE_PATTERNS)} THEN 'garbage_pattern'
  WHEN {_WORDS} = 1 AND upper(t) IN {_list(fixed.QUALITY_KEYWORDS)} THEN 'single_keyword' WHEN {_LEARN_KEY} AND {_WORDS} >= 2 THEN 'keyword_with_context'
  WHEN {_LEARN_KEY} AND length(t) >= 15 THEN 'keyword_long_enough' ELSE 'no_keyword_or_context' END"""


@query("learning_gate", f"SELECT t, {_LEARN} AS reason FROM {_TITLED}")
def learning_gate(spark, sf_dir):
    """O-FLT-8."""
    return _titled(spark, sf_dir).select("t", titles.learning_gate(F.col("t"))["reason"].alias("reason"))


@query("drawing_types", f"SELECT part AS t, {_TYPES} AS drawing_type FROM (SELECT t AS part FROM {_TITLED})")
def drawing_types(spark, sf_dir):
    """O-TT-16."""
    return _titled(spark, sf_dir).select("t", titles.drawing_type(F.col("t")).alias("drawing_type"))


@query("field_matches", """SELECT nullif(regexp_extract(x, '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}'), '') AS date, nullif(regexp_extract(x, '[A-Z]?[0-9]{4,}[-.]?[0-9]*'), '') AS project, count(*) AS n
FROM (SELECT 'Issued ' || (o_orderkey % 12 + 1) || '/' || (o_orderkey % 28 + 1) || '/24 job P' || (o_orderkey % 7 + 2020) || '-0' || o_orderkey % 5 AS x FROM sheets) GROUP BY ALL""")
def field_matches(spark, sf_dir):
    """O-STR-6, O-DATE-2."""
    k = F.col("o_orderkey")
    part = lambda m, a: (F.pmod(k, F.lit(m)) + a).cast("string")
    x = F.concat(F.lit("Issued "), part(12, 1), F.lit("/"), part(28, 1), F.lit("/24 job P"), part(7, 2020), F.lit("-0"), part(5, 0))
    return fixtures.sheets(spark, sf_dir).select(x.alias("x")).groupBy(text.first_field(F.col("x"), "date").alias("date"), text.first_field(F.col("x"), "project_number").alias("project")).agg(F.count("*").alias("n"))


@query("string_functions", """SELECT DISTINCT sheet_title, regexp_replace(lower(sheet_title), '[^a-z0-9]', '', 'g') AS file_key, upper(trim(coalesce(sheet_title, ''))) AS comparable,
  trim(regexp_replace(sheet_title || '   x ', '\\s+', ' ', 'g')) AS collapsed, regexp_replace('A1.O ' || sheet_title, '([0-9]\\.)O', '\\10', 'g') AS repaired FROM sheets""")
def string_functions(spark, sf_dir):
    """O-STR-1/3/7/10."""
    t = F.col("sheet_title")
    return fixtures.sheets(spark, sf_dir).select("sheet_title").distinct().select(
        "sheet_title", text.normal_filename(t).alias("file_key"), text.comparable(t).alias("comparable"), text.collapse(F.concat(t, F.lit("   x "))).alias("collapsed"), text.repair_zero(F.concat(F.lit("A1.O "), t)).alias("repaired"),
    )


# -- index -----------------------------------------------------------------------------

_LOOKUP = """asked AS (SELECT DISTINCT pdf_filename, sheet_number AS n FROM sheets WHERE sheet_number IS NOT NULL),
tried AS (
  SELECT pdf_filename, n, 0 AS step, n AS key FROM asked UNION ALL SELECT pdf_filename, n, 2, substr(n, 1, 2) || '.' || substr(n, 3) FROM asked
  UNION ALL SELECT pdf_filename, n, 3, substr(n, 1, 3) || '.' || substr(n, 4) FROM asked UNION ALL SELECT pdf_filename, n, 4, substr(n, 1, 1) || '-' || substr(n, 2) FROM asked),
hits AS (SELECT t.pdf_filename, n, arg_min(title, step) AS index_title, min(step) AS step FROM tried t JOIN entries e ON e.pdf_filename = t.pdf_filename AND e.sheet_number = t.key GROUP BY ALL)"""


@query("index_lookup", f"WITH {_LOOKUP} SELECT pdf_filename, n AS sheet_number, index_title, CASE WHEN step = 0 THEN 'exact' ELSE 'variant' END AS index_step FROM hits", "sheets entries")
def index_lookup(spark, sf_dir):
    """O-JOIN-1, O-JOIN-2."""
    s = fixtures.sheets(spark, sf_dir)
    d = index.lookup_titles(s.select("pdf_filename", "sheet_number").distinct(), fixtures.index_entries(s), similar=False)
    return d.where("index_step is not null").select("pdf_filename", "sheet_number", "index_title", "index_step")


@query("index_similar")
def index_similar(spark, sf_dir):
    """O-JOIN-3: numbers with a letter doubled or a digit too many; a test holds the ratios against difflib."""
    s = fixtures.sheets(spark, sf_dir)
    k, n = F.col("o_orderkey"), F.col("sheet_number")
    altered = F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.substring(n, 1, 1), n)).otherwise(F.concat(n, F.pmod(k, F.lit(10)).cast("string")))
    asked = s.where("sheet_number is not null").select("pdf_filename", altered.alias("sheet_number")).distinct()
    return index.lookup_titles(asked, fixtures.index_entries(s)).where("index_step = 'similar'")


@query("cross_reference", f"""WITH {_LOOKUP},
m AS (SELECT s.*, ['pattern', 'spatial', 'vision_api'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS title_method, h.index_title FROM sheets s LEFT JOIN hits h ON h.pdf_filename = s.pdf_filename AND h.n = s.sheet_number),
f AS (SELECT *, coalesce(title_method <> 'vision_api' AND index_title IS NOT NULL AND sheet_title IS DISTINCT FROM index_title, false) AS o,
             coalesce(title_method = 'vision_api' AND upper(sheet_title) <> upper(index_title), false) AS c FROM m)
SELECT pdf_filename, page_number, CASE WHEN o THEN index_title ELSE sheet_title END AS sheet_title, CASE WHEN o THEN 'drawing_index_xref' ELSE title_method END AS title_method,
       CASE WHEN o THEN 0.95 ELSE title_confidence END AS title_confidence, CASE WHEN o THEN 0 WHEN c THEN 1 ELSE needs_review END AS needs_review, o AS xref_override, c AS xref_conflict FROM f""", "sheets entries")
def cross_reference(spark, sf_dir):
    """O-JOIN-8."""
    s = fixtures.sheets(spark, sf_dir)
    d = index.lookup_titles(s, fixtures.index_entries(s), similar=False)
    d = d.withColumn("title_method", F.element_at(F.array(F.lit("pattern"), F.lit("spatial"), F.lit("vision_api")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")))
    return index.cross_reference(d).select("pdf_filename", "page_number", "sheet_title", "title_method", "title_confidence", "needs_review", "xref_override", "xref_conflict")


_PAGES = """pages_ AS (SELECT pdf_filename AS pdf, CAST(1 + ord % 3 AS INTEGER) AS page, ord, sheet_number, title FROM entries)"""


def _index_pages(spark, sf_dir):
    e = fixtures.index_entries(fixtures.sheets(spark, sf_dir)).withColumn("page", (F.pmod("ord", F.lit(3)) + 1).cast("int"))
    # every separator; a line that begins like a number but is no entry continues nothing
    between = F.element_at(F.array(*[F.lit(x) for x in ("   ", "\t", " - ", "     ", " \u2013 ", " ")]), (F.pmod("ord", F.lit(6)) + 1).cast("int"))
    below = F.when(F.pmod("ord", F.lit(4)) == 0, "\nOF UPPER FLOORS").when(F.pmod("ord", F.lit(4)) == 1, "\nA9:REFUSED").otherwise("")
    line = F.concat("sheet_number", between, "title", below)
    lines = e.groupBy(F.col("pdf_filename").alias("pdf"), "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select("pdf", "page", F.concat(F.lit("DRAWING INDEX\n\nARCHITECTURAL\n"), "body").alias("text"))


@query("parse_index", f"""WITH {_PAGES}
SELECT pdf, sheet_number, arg_max(title || CASE WHEN ord % 4 = 0 THEN ' OF UPPER FLOORS' ELSE '' END, CAST(page AS BIGINT) * 1000000000 + ord) AS title, max(page) AS page FROM pages_ WHERE title <> 'COVER SHEET' GROUP BY ALL""", "sheets entries")
def parse_index(spark, sf_dir):
    """O-TT-8/9/11, O-WIN-3, O-FLT-18, O-SET-2, O-SORT-10."""
    return index.parse_index(_index_pages(spark, sf_dir)).select("pdf", "sheet_number", "title", "page")


# -- learning ------------------------------------------------------------------------------

_GOOD = f"""good AS (SELECT * FROM (SELECT *, sheet_title AS t FROM sheets) WHERE needs_review = 0 AND ({_LEARN}) IN ('keyword_with_context', 'keyword_long_enough')),
kept AS (SELECT * FROM good g WHERE (SELECT count(*) FROM good h WHERE h.pdf_filename = g.pdf_filename AND h.t = g.t) <= 0.2 * (SELECT count(*) FROM sheets s WHERE s.pdf_filename = g.pdf_filename))"""


@query("learn_templates", f"""WITH {_GOOD}
SELECT k.pdf_filename, p.pages_analyzed, count(*) AS quality_pages_used, CAST(min(length(t)) AS INTEGER) AS typical_length_min, CAST(max(length(t)) AS INTEGER) AS typical_length_max, any_value(x.more) AS more
FROM kept k JOIN (SELECT pdf_filename, count(*) AS pages_analyzed FROM sheets GROUP BY ALL) p USING (pdf_filename)
LEFT JOIN (SELECT pdf_filename, string_agg(regexp_replace(t, '([^A-Za-z0-9_])', '\\\\\\1', 'g'), '|' ORDER BY first) AS more
  FROM (SELECT pdf_filename, sheet_title AS t, min(page_number) AS first FROM sheets WHERE needs_review = 1 AND sheet_title <> '' GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL) x USING (pdf_filename)
GROUP BY k.pdf_filename, p.pages_analyzed HAVING count(*) >= 5""")
def learn_templates(spark, sf_dir):
    """O-AGG-7, O-AGG-9, O-AGG-8."""
    more = F.nullif(F.array_join(F.slice("exclusion_patterns", len(fixed.STANDARD_EXCLUSIONS) + 1, 1 << 20), "|"), F.lit(""))
    return learn.learn_templates(fixtures.sheets(spark, sf_dir)).select("pdf_filename", "pages_analyzed", "quality_pages_used", "typical_length_min", "typical_length_max", more.alias("more"))


@query("neighbours", """SELECT s.pdf_filename, s.page_number, CASE n.c WHEN 2 THEN 0.8 WHEN 1 THEN 0.7 END::DOUBLE AS base FROM sheets s LEFT JOIN (
  SELECT a.pdf_filename, a.page_number, count(*) AS c FROM sheets a JOIN sheets b ON a.pdf_filename = b.pdf_filename AND abs(a.page_number - b.page_number) = 1
  WHERE b.needs_review = 0 AND b.sheet_title <> '' GROUP BY ALL) n USING (pdf_filename, page_number)""")
def neighbours(spark, sf_dir):
    """O-JOIN-7, O-FLT-26."""
    return learn.neighbour_base(fixtures.sheets(spark, sf_dir)).select("pdf_filename", "page_number", "base")


@query("rescue")
def rescue(spark, sf_dir):
    """O-TT-12..14, O-JOIN-21, O-FLT-2, O-FLT-15."""
    s = fixtures.sheet_text(fixtures.sheets(spark, sf_dir))
    return learn.rescue(s, learn.learn_templates(s)).select("pdf_filename", "page_number", "sheet_title", "title_confidence", "needs_review", "rescued_by")


_PROJECT = "(SELECT pdf_filename, page_number, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 10 < 4 + CAST(substr(pdf_filename, 5, 2) AS INTEGER) % 5 THEN 'P' || substr(pdf_filename, 5, 2) || '00' ELSE 'X' || o_orderkey % 4 || '999' END AS p FROM sheets)"


@query("project_fallback", f"""WITH j AS (SELECT * FROM {_PROJECT}),
c AS (SELECT pdf_filename, p, count(*) AS n, min(page_number) AS first FROM j WHERE p IS NOT NULL GROUP BY ALL),
b AS (SELECT pdf_filename, arg_max(p, CAST(n AS BIGINT) * 1000000 - first) AS best, max(n) AS n, sum(n) AS total FROM c GROUP BY ALL)
SELECT j.pdf_filename, j.page_number, coalesce(j.p, CASE WHEN b.n / b.total >= 0.6 THEN b.best END) AS project_number FROM j LEFT JOIN b USING (pdf_filename)""")
def project_fallback(spark, sf_dir):
    """O-AGG-4."""
    s, k = fixtures.sheets(spark, sf_dir), F.col("o_orderkey")
    two = F.substring("pdf_filename", 5, 2)
    p = F.when(F.pmod(k, F.lit(3)) == 0, None).when(F.pmod(k, F.lit(10)) < 4 + two.cast("int") % 5, F.concat(F.lit("P"), two, F.lit("00"))).otherwise(F.concat(F.lit("X"), F.pmod(k, F.lit(4)).cast("string"), F.lit("999")))
    return learn.project_fallback(s.withColumn("project_number", p)).select("pdf_filename", "page_number", "project_number")


# -- store, review, accuracy ------------------------------------------------------------------


@query("upsert", """SELECT coalesce(a.pdf_filename, b.pdf_filename) AS pdf_filename, coalesce(a.page_number, b.page_number) AS page_number, CASE WHEN b.page_number IS NULL THEN a.sheet_title ELSE b.sheet_title END AS sheet_title, a.sheet_number
FROM (SELECT * FROM sheets WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT pdf_filename, page_number, upper(sheet_title) AS sheet_title FROM sheets WHERE o_orderkey % 2 = 0) b USING (pdf_filename, page_number)""")
def upsert(spark, sf_dir):
    """O-SINK-2."""
    s = fixtures.sheets(spark, sf_dir)
    a = s.where(F.pmod("o_orderkey", F.lit(3)) != 0).select("pdf_filename", "page_number", "sheet_title", "sheet_number")
    b = s.where(F.pmod("o_orderkey", F.lit(2)) == 0).select("pdf_filename", "page_number", F.upper("sheet_title").alias("sheet_title"))
    return store.upsert(a, b).select("pdf_filename", "page_number", "sheet_title", "sheet_number")


@query("corrections", """SELECT pdf_filename, page_number, CASE WHEN o_orderkey % 17 = 0 THEN 'Corrected ' || page_number ELSE sheet_title END AS sheet_title,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE title_confidence END AS title_confidence, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE needs_review END AS needs_review FROM sheets""")
def corrections(spark, sf_dir):
    """O-SINK-3, O-JOIN-17, O-SCAN-10."""
    s = fixtures.sheets(spark, sf_dir)
    fixes = s.select("pdf_filename", "page_number", F.when(F.pmod("o_orderkey", F.lit(17)) == 0, F.concat(F.lit("Corrected "), F.col("page_number").cast("string"))).otherwise(" ").alias("corrected_title"))
    return store.apply_corrections(s, fixes).select("pdf_filename", "page_number", "sheet_title", "title_confidence", "needs_review")


@query("delete_keys", "SELECT pdf_filename, page_number FROM sheets WHERE needs_review = 0")
def delete_keys(spark, sf_dir):
    """O-SINK-4."""
    s = fixtures.sheets(spark, sf_dir)
    return store.delete_keys(s, s.where("needs_review = 1")).select("pdf_filename", "page_number")


@query("decision_changes", """SELECT 'NEEDS_EVALUATION -> ' || h AS change, count(*) AS n FROM (SELECT ['DEFINITELY_NEEDED', 'NEEDS_EVALUATION', 'DEFINITELY_NOT_NEEDED'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS h FROM sheets WHERE needs_review = 1) WHERE h <> 'NEEDS_EVALUATION' GROUP BY ALL""")
def decision_changes(spark, sf_dir):
    """O-AGG-15, O-JOIN-22."""
    h = F.element_at(F.array(F.lit("DEFINITELY_NEEDED"), F.lit("NEEDS_EVALUATION"), F.lit("DEFINITELY_NOT_NEEDED")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return review.decision_changes(fixtures.sheets(spark, sf_dir).select((F.col("needs_review") == 1).alias("reviewed"), F.lit("NEEDS_EVALUATION").alias("decision"), h.alias("human_decision")))


@query("queue_statistics", """SELECT count(*) AS total, count(*) FILTER (needs_review = 0) AS pending, count(*) FILTER (needs_review = 1) AS reviewed, count(*) FILTER (needs_review = 0 AND o_orderkey % 3 = 2) AS priority_2,
  count(*) FILTER (needs_review = 0 AND o_orderkey % 3 = 1) AS priority_1, count(*) FILTER (needs_review = 0 AND o_orderkey % 3 = 0) AS priority_0 FROM sheets""")
def queue_statistics(spark, sf_dir):
    """O-AGG-14, O-FLT-23."""
    return review.queue_statistics(fixtures.sheets(spark, sf_dir).select((F.col("needs_review") == 1).alias("reviewed"), F.pmod("o_orderkey", F.lit(3)).alias("priority")))


@query("suggested_words", """WITH t AS (SELECT substr(sheet_number, 1, 1) || o_orderkey % 12 AS category, upper(sheet_title) AS title FROM sheets WHERE sheet_title IS NOT NULL AND sheet_number IS NOT NULL),
c AS (SELECT category, count(*) AS titles FROM t GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT category, regexp_replace(w, '[^A-Z0-9]', '', 'g') AS w FROM (SELECT category, unnest(string_split(title, ' ')) AS w FROM t) WHERE length(regexp_replace(w, '[^A-Z0-9]', '', 'g')) >= 3)
SELECT category, titles, string_agg(w, ' ' ORDER BY w) AS words FROM (SELECT category, titles, w, count(*) AS n FROM w JOIN c USING (category) GROUP BY ALL) WHERE n >= titles * 0.6 GROUP BY ALL""")
def suggested_words(spark, sf_dir):
    """O-AGG-16."""
    d = fixtures.sheets(spark, sf_dir).where("sheet_title is not null and sheet_number is not null")
    category = F.concat(F.substring("sheet_number", 1, 1), F.pmod("o_orderkey", F.lit(12)).cast("string"))
    return review.suggested_words(d.select(category.alias("category"), F.col("sheet_title").alias("title")))


_CMP = """c AS (SELECT t.pdf_filename, upper(trim(coalesce(s.sheet_number, ''))) AS a, upper(trim(coalesce(t.true_number, ''))) AS b, upper(trim(coalesce(s.sheet_title, ''))) AS x, upper(trim(coalesce(t.true_title, ''))) AS y
  FROM truth t JOIN sheets s ON s.pdf_filename = t.pdf_filename AND s.page_number = t.page_number),
ok AS (SELECT *, a = b AS number_ok, CASE WHEN x = '' OR y = '' THEN x = y ELSE strpos(x, y) > 0 OR strpos(y, x) > 0 END AS title_ok FROM c)"""


def _compared(spark, sf_dir):
    s = fixtures.sheets(spark, sf_dir)
    return accuracy.compared(s, fixtures.ground_truth(s))


@query("field_accuracy", f"WITH {_CMP} SELECT 'number' AS field, count(*) FILTER (number_ok) AS correct, count(*) AS total, count(*) FILTER (number_ok) / count(*) AS accuracy FROM ok UNION ALL SELECT 'title', count(*) FILTER (title_ok), count(*), count(*) FILTER (title_ok) / count(*) FROM ok", "sheets truth")
def field_accuracy(spark, sf_dir):
    """O-JOIN-16, O-AGG-10, O-STR-7/8."""
    return accuracy.field_accuracy(_compared(spark, sf_dir))


@query("truth_metrics", f"WITH {_CMP} SELECT count(*) AS compared, count(*) FILTER (number_ok AND a <> '') AS numbers_correct, count(*) FILTER (a = '' AND b = '') AS numbers_both_null, count(*) FILTER (NOT number_ok) AS numbers_wrong, count(*) FILTER (title_ok AND (x <> '' OR y <> '')) AS titles_matching, count(*) FILTER (x = '' AND y = '') AS titles_both_null FROM ok", "sheets truth")
def truth_metrics(spark, sf_dir):
    """O-JOIN-15, O-AGG-11."""
    return accuracy.truth_metrics(_compared(spark, sf_dir))


@query("pdf_bands", f"WITH {_CMP} SELECT pdf_filename, count(*) FILTER (title_ok) AS correct, count(*) AS total, CASE WHEN count(*) FILTER (title_ok) / count(*) >= 0.9 THEN 'good' WHEN count(*) FILTER (title_ok) / count(*) >= 0.3 THEN 'partial' ELSE 'poor' END AS band FROM ok GROUP BY ALL", "sheets truth")
def pdf_bands(spark, sf_dir):
    """O-AGG-12."""
    return accuracy.pdf_bands(_compared(spark, sf_dir))


@query("run_summary", "SELECT count(DISTINCT pdf_filename) AS total_pdfs, count(*) AS total_pages, count(*) FILTER (sheet_title IS NOT NULL) AS success_count, count(*) FILTER (sheet_title IS NULL) AS error_count, count(*) FILTER (sheet_title IS NULL) AS missing_sheet_titles, count(*) FILTER (sheet_number IS NULL) AS missing_sheet_numbers FROM sheets")
def run_summary(spark, sf_dir):
    """O-AGG-1, O-AGG-3, O-AGG-28, O-FLT-5."""
    return accuracy.run_summary(fixtures.sheets(spark, sf_dir).withColumn("is_valid", F.col("sheet_title").isNotNull()))


@query("confidence_histogram", "SELECT CASE WHEN title_confidence >= 0.9 THEN '0.9+' WHEN title_confidence >= 0.7 THEN '0.7-0.9' WHEN title_confidence >= 0.5 THEN '0.5-0.7' ELSE '<0.5' END AS bucket, count(*) AS n FROM sheets GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    """O-PROJ-13, O-AGG-13."""
    return fixtures.sheets(spark, sf_dir).groupBy(scores.histogram_bucket(F.col("title_confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("page_totals", "SELECT pdf_filename, count(*) AS pages, sum(needs_review) AS to_review FROM sheets GROUP BY ROLLUP (pdf_filename)")
def page_totals(spark, sf_dir):
    """O-AGG-30, O-SORT-1."""
    return fixtures.sheets(spark, sf_dir).rollup("pdf_filename").agg(F.count("*").alias("pages"), F.sum("needs_review").alias("to_review"))


# -- geometry -----------------------------------------------------------------------------------


@query("nearest_value", r"""SELECT page, arg_min(value, (d2, lpos, vpos, value)) AS value, round(sqrt(min(d2)), 6) AS dist FROM (
  SELECT l.page, v.text AS value, l.pos AS lpos, v.pos AS vpos, (v.x0 - l.x0) * (v.x0 - l.x0) + (v.y0 - l.y0) * (v.y0 - l.y0) AS d2
  FROM blocks l JOIN blocks v ON l.page = v.page WHERE l.text = 'SHEET NO' AND v.text <> 'SHEET NO' AND abs(v.x0 - l.x0) <= 0.07 * 2592 AND abs(v.y0 - l.y0) <= 150) GROUP BY page""", "blocks")
def nearest_value(spark, sf_dir):
    """O-JOIN-5, O-SN-4."""
    return spatial.nearest_value(fixtures.blocks(spark, sf_dir)).select("page", "value", F.round("dist", 6).alias("dist"))


@query("band_value", """SELECT page, arg_min(v, (lpos, pos, v)) AS value FROM (SELECT l.page, l.pos AS lpos, b.pos, b.text AS v FROM blocks l JOIN blocks b ON l.page = b.page AND b.pos BETWEEN l.pos - 1 AND l.pos + 3 WHERE l.text = 'SHEET NO' AND b.text <> 'SHEET NO') GROUP BY page""", "blocks")
def band_value(spark, sf_dir):
    """O-JOIN-6, O-SN-4b."""
    return spatial.band_value(fixtures.blocks(spark, sf_dir))


@query("zones", """SELECT zone, count(*) AS n FROM (SELECT CASE WHEN y0 / 1728 < 0.15 THEN 'header' WHEN y0 / 1728 < 0.65 THEN 'title' ELSE 'info' END AS zone FROM blocks) GROUP BY ALL""", "blocks")
def zones(spark, sf_dir):
    """O-MATH-3."""
    return fixtures.blocks(spark, sf_dir).groupBy(geometry.vertical_zone(F.col("y0"), geometry.box(0, 0, 2592, 1728)).alias("zone")).agg(F.count("*").alias("n"))


@query("boxes", """SELECT page, pos, x0 * 72.0::DOUBLE / 200 AS pt_x0, (x0 + x0 + 300) / 2 AS centre_x, CAST(12000 AS DOUBLE) AS area, x0 + 300 >= 2000 AND y0 + 40 >= 1400 AS overlaps,
  greatest(0, least(x0 + 300, 2592) - greatest(x0, 2000)) * greatest(0, least(y0 + 40, 1728) - greatest(y0, 1400)) AS common FROM blocks""", "blocks")
def boxes(spark, sf_dir):
    """O-MATH-1/2, O-JOIN-23."""
    b = geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + 300, F.col("y0") + 40)
    region = geometry.box(2000, 1400, 2592, 1728)
    return fixtures.blocks(spark, sf_dir).withColumn("b", b).select(
        "page", "pos", (F.col("x0") * 72.0 / 200).alias("pt_x0"), geometry.centre(F.col("b"))["x"].alias("centre_x"), geometry.area(F.col("b")).alias("area"),
        geometry.overlaps(F.col("b"), region).alias("overlaps"), F.coalesce(geometry.area(geometry.intersection(F.col("b"), region)), F.lit(0.0)).alias("common"),
    )


@query("consensus", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 0.8 + (vec_id % 7) / 100.0 END::DOUBLE AS a, CASE WHEN vec_id % 3 <> 0 THEN 0.81 + (vec_id % 9) / 50.0 END::DOUBLE AS b, CASE WHEN vec_id % 4 <> 0 THEN 0.82 + (vec_id % 4) / 100.0 END::DOUBLE AS h FROM (SELECT DISTINCT vec_id FROM profile)),
l AS (SELECT *, list_filter([a, b, h], lambda x: x IS NOT NULL) AS v FROM e),
m AS (SELECT *, len(v) AS n, list_max(v) - list_min(v) AS raw, list_filter(v, lambda x: abs(x - list_median(v)) < 0.1) AS f FROM l)
SELECT vec_id, round(CASE WHEN n = 0 THEN 0.88 WHEN n = 1 THEN v[1] WHEN raw > 0.1 THEN coalesce(h, list_max(v)) ELSE list_median(f) END, 6) AS x1,
       CASE WHEN n = 0 THEN 'computed_fallback_all_failed' WHEN n = 1 THEN CASE WHEN a IS NOT NULL THEN 'cv_transition' WHEN b IS NOT NULL THEN 'cv_majority' ELSE 'hough_lines' END
            WHEN raw > 0.1 AND h IS NOT NULL THEN 'hough_lines_preferred' WHEN raw > 0.1 THEN 'consensus_conservative_high_spread' ELSE 'consensus_median' END AS method FROM m""", "profile")
def consensus(spark, sf_dir):
    """O-AGG-20, O-MATH-7, O-SCORE-11."""
    k = F.col("vec_id")
    part = lambda mod, base, m, by: F.when(F.pmod(k, F.lit(mod)) != 0, F.lit(base) + F.pmod(k, F.lit(m)) / F.lit(by))
    c = scores.consensus(part(5, 0.8, 7, 100.0), part(3, 0.81, 9, 50.0), part(4, 0.82, 4, 100.0))
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").distinct().select("vec_id", c.alias("c"))
    return d.select("vec_id", F.round("c.x1", 6).alias("x1"), "c.method")


def _profile(spark, sf_dir):
    return fixtures.profile(spark, sf_dir).withColumnRenamed("vec_id", "id")


@query("first_sustained", """SELECT id, min(x) AS x FROM (SELECT vec_id AS id, x, min(v) OVER w AS low, count(*) OVER w AS n FROM profile WINDOW w AS (PARTITION BY vec_id ORDER BY x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 AND low > 0 GROUP BY id""", "profile")
def first_sustained(spark, sf_dir):
    """O-WIN-7."""
    return profiles.first_sustained(_profile(spark, sf_dir), 0.0, 3)


@query("smoothed", """WITH w AS (SELECT vec_id, max(x) + 1 AS n FROM profile GROUP BY ALL)
SELECT p.vec_id AS id, p.x, round(avg(q.v), 9) + 0.0 AS s FROM profile p JOIN w USING (vec_id), (SELECT unnest(range(-5, 5)) AS k) JOIN profile q ON q.vec_id = p.vec_id
  AND q.x = CASE WHEN p.x + k < 0 THEN -1 - (p.x + k) WHEN p.x + k >= n THEN 2 * n - 1 - (p.x + k) ELSE p.x + k END GROUP BY ALL""", "profile")
def smoothed(spark, sf_dir):
    """O-WIN-6."""
    return profiles.smoothed(_profile(spark, sf_dir)).select("id", "x", (F.round("s", 9) + 0.0).alias("s"))


@query("longest_run", """SELECT id, max(n) AS longest FROM (SELECT id, g, count(*) AS n FROM (SELECT vec_id AS id, x, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS g FROM profile WHERE v > 0) GROUP BY ALL) GROUP BY id""", "profile")
def longest_run(spark, sf_dir):
    """O-WIN-8, O-RES-6."""
    return profiles.longest_run(_profile(spark, sf_dir), 0.0)


@query("noise_level", """SELECT p.vec_id AS id, round(quantile_cont(v, 0.95), 6) AS level FROM profile p JOIN (SELECT vec_id, (max(x) + 1) / 2 AS half FROM profile GROUP BY ALL) h USING (vec_id) WHERE x < half GROUP BY ALL""", "profile")
def noise_level(spark, sf_dir):
    """O-AGG-26, O-RES-10."""
    return profiles.noise_level(_profile(spark, sf_dir)).select("id", F.round("level", 6).alias("level"))


@query("peaks", """SELECT p.vec_id AS id, count(*) AS n, min(x) AS first, max(x) AS last FROM profile p JOIN (SELECT vec_id, avg(v) + stddev_pop(v) AS cut FROM profile GROUP BY ALL) c USING (vec_id) WHERE v > cut GROUP BY ALL""", "profile")
def peaks(spark, sf_dir):
    """O-AGG-27, O-RES-11."""
    return profiles.peaks(_profile(spark, sf_dir))


@query("gradient", """SELECT vec_id AS id, x, round(CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END, 6) AS g FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM profile WINDOW w AS (PARTITION BY vec_id ORDER BY x))""", "profile")
def gradient(spark, sf_dir):
    """O-WIN-13."""
    return profiles.gradient(_profile(spark, sf_dir)).select("id", "x", F.round("g", 6).alias("g"))


@query("position_bins", """SELECT id, round(arg_max(mean, bin), 6) AS x FROM (SELECT vec_id AS id, CAST(floor(v / 0.02) AS BIGINT) AS bin, count(*) AS n, avg(v) AS mean FROM profile GROUP BY ALL) WHERE n >= 2 GROUP BY id""", "profile")
def position_bins(spark, sf_dir):
    """O-AGG-23, O-WIN-10."""
    return profiles.position_bins(_profile(spark, sf_dir).withColumnRenamed("v", "pos")).select("id", F.round("x", 6).alias("x"))


@query("clusters", """WITH RECURSIVE o AS (SELECT vec_id AS id, v AS pos, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS i FROM profile),
f AS (SELECT id, i, pos AS total, 1 AS n, 1 AS cluster FROM o WHERE i = 1
  UNION ALL SELECT f.id, o.i, CASE WHEN abs(o.pos - f.total / f.n) <= 0.01 THEN f.total + o.pos ELSE o.pos END, CASE WHEN abs(o.pos - f.total / f.n) <= 0.01 THEN f.n + 1 ELSE 1 END,
    f.cluster + CASE WHEN abs(o.pos - f.total / f.n) <= 0.01 THEN 0 ELSE 1 END FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1)
SELECT id, round(arg_max(total, i), 4) + 0.0 AS total, CAST(max(n) AS INTEGER) AS n FROM f GROUP BY id, cluster""", "profile")
def clusters(spark, sf_dir):
    """O-WIN-9."""
    return profiles.clusters(_profile(spark, sf_dir).withColumnRenamed("v", "pos")).select("id", (F.round(F.col("mean") * F.col("n"), 4) + 0.0).alias("total"), "n")


# -- events ----------------------------------------------------------------------------------------


@query("top_candidates", """SELECT pdf_filename, page_number, title_confidence, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY title_confidence DESC, page_number) AS r FROM sheets) WHERE r <= 5""")
def top_candidates(spark, sf_dir):
    """O-SORT-4, O-SORT-11, O-WIN-1."""
    return review.top_candidates(fixtures.sheets(spark, sf_dir), "pdf_filename", "title_confidence", "page_number").select("pdf_filename", "page_number", "title_confidence", "rank")


# -- pages and content ---------------------------------------------------------------------------------

from ..functions import pages as page_functions  # noqa: E402
from ..operators import content  # noqa: E402


@query("cover_sheets", """SELECT pdf_filename, page_number, o_orderkey % 5 > 2 AND (contains(upper(coalesce(sheet_title, '')), 'COVER SHEET')) AS is_cover FROM sheets""")
def cover_sheets(spark, sf_dir):
    """O-FLT-10."""
    d = fixtures.sheet_text(fixtures.sheets(spark, sf_dir))
    return d.select("pdf_filename", "page_number", page_functions.is_cover(F.col("text"), F.col("page_number")).alias("is_cover"))


@query("page_analysis", """SELECT pdf_filename, page_number, n AS text_length, n > 0 AS has_text, n < 50 AND o_orderkey % 2 = 0 AS is_scanned, CASE WHEN n >= 50 THEN 'vector' ELSE 'ocr' END AS recommendation
FROM (SELECT *, CAST(length(repeat(coalesce(sheet_title, ''), 1 + CAST(o_orderkey % 4 AS INTEGER))) AS INTEGER) AS n FROM sheets)""")
def page_analysis(spark, sf_dir):
    """O-PROJ-1, O-FLT-14."""
    d = fixtures.sheets(spark, sf_dir)
    side = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, 1200).otherwise(900)
    text_ = F.expr("repeat(coalesce(sheet_title, ''), cast(1 + o_orderkey % 4 as int))")
    a = page_functions.page_analysis(text_, F.array(F.struct(side.alias("width"), side.alias("height"))))
    return d.select("pdf_filename", "page_number", a.alias("a")).select("pdf_filename", "page_number", "a.text_length", "a.has_text", "a.is_scanned", "a.recommendation")


@query("validate_rows", """SELECT pdf_filename, page_number, CAST((n IS NOT NULL AND NOT regexp_matches(n, '^[A-Z]'))::INT + (p IS NOT NULL AND p LIKE 'X%' AND length(p) <= 3)::INT + (n IS NOT DISTINCT FROM p AND n IS NOT NULL)::INT + (sheet_title IS NULL)::INT AS INTEGER) AS errors,
  CAST((n IS NULL)::INT + (p IS NULL OR length(regexp_replace(p, '[^0-9]', '', 'g')) < 4)::INT AS INTEGER) AS warnings
FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN '9' || sheet_number ELSE sheet_number END AS n, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'XY1' WHEN 2 THEN '20240156' ELSE '123' END AS p FROM sheets)""")
def validate_rows(spark, sf_dir):
    """O-FLT-5/6/7."""
    k = F.col("o_orderkey")
    n = F.when(F.pmod(k, F.lit(6)) == 0, F.concat(F.lit("9"), F.col("sheet_number"))).otherwise(F.col("sheet_number"))
    p = F.when(F.pmod(k, F.lit(4)) == 0, None).when(F.pmod(k, F.lit(4)) == 1, "XY1").when(F.pmod(k, F.lit(4)) == 2, "20240156").otherwise("123")
    return fixtures.sheets(spark, sf_dir).select(
        "pdf_filename", "page_number", F.size(page_functions.row_errors(n, p, F.col("sheet_title"))).alias("errors"), F.size(page_functions.row_warnings(n, p, F.lit(None).cast("string"))).alias("warnings"),
    )


@query("titles_from_text")
def titles_from_text(spark, sf_dir):
    """O-TT-4, O-TT-6, O-TT-7, O-STR-6."""
    d = fixtures.sheet_text(fixtures.sheets(spark, sf_dir))
    return d.select("pdf_filename", "page_number", page_functions.title_from_text(F.col("text")).alias("title"))


@query("sample_pages", """SELECT pdf_filename, n AS pages, unnest(CASE WHEN n <= 3 THEN range(1, n + 1) ELSE list_transform(range(0, CASE WHEN n <= 10 THEN 3 WHEN n <= 30 THEN 4 WHEN n <= 100 THEN 5 ELSE 6 END),
  lambda i: 1 + i * greatest(1, (n - 1) // CASE WHEN n <= 10 THEN 3 WHEN n <= 30 THEN 4 WHEN n <= 100 THEN 5 ELSE 6 END)) END)::INTEGER AS page FROM (SELECT pdf_filename, count(*) AS n FROM sheets GROUP BY ALL)""")
def sample_pages(spark, sf_dir):
    """O-SORT-7/8/9."""
    d = fixtures.sheets(spark, sf_dir).groupBy("pdf_filename").agg(F.count("*").alias("pages"))
    return d.select("pdf_filename", "pages", F.explode(page_functions.sample_pages(F.col("pages"))).alias("page"))


_INDICATED = "(SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'ROOM 101 PT-1 ACT CEILING' WHEN 1 THEN 'SEE ELEV D101' WHEN 2 THEN 'WALL TYPE A' WHEN 3 THEN coalesce(sheet_title, '') WHEN 4 THEN 'RM 12 paint type' ELSE '' END AS x FROM sheets)"
_COUNTS = ", ".join(f"CAST({_any('x', p)} AS INTEGER) AS {n}" for n, _, p in fixed.PAINTING_INDICATORS)


@query("content_relevance", f"""SELECT x, CASE WHEN p >= 1 THEN 'PRIMARY' WHEN s >= 1 THEN 'SECONDARY' ELSE 'REFERENCE' END AS relevance,
  round(CASE WHEN p >= 2 THEN least(0.95, 0.7 + 0.1 * p) WHEN p = 1 THEN 0.75 + 0.05 * s WHEN s >= 2 THEN 0.7 + 0.05 * s WHEN s = 1 THEN 0.6 ELSE 0.5 END::DOUBLE, 6) AS confidence, count(*) AS n,
  CASE WHEN ceiling_grid = 1 THEN 'reflected_ceiling_plans' WHEN room_numbers = 1 AND finish_callouts = 1 THEN 'room_finish_schedules' WHEN elevation_markers = 1 THEN 'interior_elevations' WHEN room_numbers = 1 THEN 'floor_plans' WHEN door_tags = 1 THEN 'door_schedules' ELSE 'floor_plans' END AS category
FROM (SELECT *, room_numbers + finish_callouts + ceiling_grid AS p, wall_tags + elevation_markers + door_tags AS s FROM (SELECT x, {_COUNTS} FROM {_INDICATED})) GROUP BY ALL""")
def content_relevance(spark, sf_dir):
    """O-AGG-18, O-AGG-19, O-CLS-9."""
    k = F.pmod("o_orderkey", F.lit(6))
    x = F.when(k == 0, "ROOM 101 PT-1 ACT CEILING").when(k == 1, "SEE ELEV D101").when(k == 2, "WALL TYPE A").when(k == 3, F.coalesce("sheet_title", F.lit(""))).when(k == 4, "RM 12 paint type").otherwise("")
    found = content.indicators(F.col("x"))
    d = fixtures.sheets(spark, sf_dir).select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    r = content.content_relevance(found)
    return d.select("x", "n", r["relevance"].alias("relevance"), F.round(r["confidence"], 6).alias("confidence"), content.content_category(found).alias("category"))


@query("canonical_names", """WITH v AS (SELECT pdf_filename, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'The Pearl' WHEN 1 THEN 'THE PEARL.' WHEN 2 THEN 'Cascade East' WHEN 3 THEN '1200 sf shell' ELSE 'The Pearl' END AS name FROM sheets),
u AS (SELECT *, regexp_replace(upper(name), '[.,;:]+$', '') AS norm FROM v WHERE name NOT LIKE '1200%'),
b AS (SELECT pdf_filename, norm, count(*) AS n, min(ord) AS first, arg_min(name, ord) FILTER (name = upper(name)) AS caps, arg_min(name, ord) AS other FROM u GROUP BY ALL)
SELECT pdf_filename, arg_max(coalesce(caps, upper(other)), CAST(n AS BIGINT) * 100000000 - first) AS name FROM b GROUP BY ALL""")
def canonical_names(spark, sf_dir):
    """O-AGG-17, O-FLT-25, O-STR-11, O-SINK-20."""
    k = F.pmod("o_orderkey", F.lit(5))
    name = F.when(k == 0, "The Pearl").when(k == 1, "THE PEARL.").when(k == 2, "Cascade East").when(k == 3, "1200 sf shell").otherwise("The Pearl")
    return content.canonical_names(fixtures.sheets(spark, sf_dir).select("pdf_filename", F.col("o_orderkey").alias("ord"), name.alias("project_name")))


@query("method_counts", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'drawing_index' WHEN 2 THEN 'spatial' ELSE 'drawing_index' END AS method, count(*) AS n FROM sheets GROUP BY ALL")
def method_counts(spark, sf_dir):
    """O-AGG-2, O-PROJ-5."""
    k = F.pmod("o_orderkey", F.lit(4))
    m = F.when(k == 1, "drawing_index").when(k == 2, "spatial").when(k == 3, "drawing_index_xref")
    return accuracy.method_counts(fixtures.sheets(spark, sf_dir).select(m.alias("title_method")))


@query("rate_limited", """SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (c > 10) AS BIGINT) AS waits FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS c FROM events) GROUP BY ALL""", "sheets")
def rate_limited(spark, sf_dir):
    """O-WIN-12."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "user_id", "ts")
    return sinks.rate_limited(e).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if("waits").alias("waits"))


from . import more  # noqa: E402, F401  registers the other queries
