"""Drawing indexes: parsing, lookup, cross-reference."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import variants
from ..functions.text import clean_title, strip
from ..rules import fixed
from ..rules.build import let, lookup

def normal_number(raw: Column) -> Column:
    """A sheet number with reading errors in its digits repaired; null if it isn't one.

    A misread letter pair stands for letter, digit and point. Else up to two
    letters and a separator go before repaired digits; of the spellings with
    and without separator, then with a point before the last digit, the first
    that is a number is taken, and the last one if none is.
    """
    keys, values = "".join(fixed.INDEX_CHAR_FIXES), "".join(fixed.INDEX_CHAR_FIXES.values())
    repaired = lambda x: F.regexp_replace(F.translate(x, keys, values), r"[^0-9.\-]", "")
    form = r"^([A-Z]{1,2})([-.]?)(.+)$"

    def parts(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, form, i)
        rest = repaired(s.substr(F.lit(3), F.length(s)))
        pair = F.when(rest != "", F.concat(lookup(F.substring(s, 1, 2), fixed.INDEX_PREFIX_FIXES), rest))
        return F.struct(pair.alias("pair"), part(1).alias("prefix"), part(2).alias("separator"), repaired(part(3)).alias("digits"))

    def spelled(p: Column) -> Column:
        pointed = F.when(~F.contains(p["digits"], F.lit(".")) & (F.length(p["digits"]) >= 2), F.regexp_replace(p["digits"], r"(.)$", ".$1")).otherwise(p["digits"])
        all_ = F.array(*[F.concat(p["prefix"], x) for x in (F.concat(p["separator"], p["digits"]), p["digits"], F.concat(p["separator"], pointed), pointed)])
        return F.when((p["prefix"] != "") & (p["digits"] != ""), all_)

    def chosen(p: Column) -> Column:
        first = let(spelled(p), lambda a: F.coalesce(F.get(F.filter(a, lambda x: x.rlike(fixed.INDEX_NUMBER)), F.lit(0)), F.when(F.length(F.get(a, F.lit(3))) >= 3, F.get(a, F.lit(3)))))
        return F.when(p["pair"].rlike(fixed.INDEX_NUMBER), p["pair"]).otherwise(first)

    return F.when(F.length(raw) >= 2, let(F.upper(strip(raw)), lambda s: let(parts(s), chosen)))


def index_entry(line: Column) -> Column:
    """(number, title) of a line; null if it is no entry.

    The line is cut at the first separator of the list that leaves a number
    before it and a title of three characters or more behind it, else behind
    a number at its start.
    """
    entry = lambda c: let(c, lambda x: F.struct(normal_number(strip(x["l"])).alias("number"), clean_title(strip(x["r"]), 3).alias("title")))
    whole = lambda c: let(entry(c), lambda m: F.when(m["number"].isNotNull() & m["title"].isNotNull(), m))
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    # each cut is only tried if those before it made no entry
    tried = [F.when(F.contains(line, F.lit(sep)), whole(pair(F.substring_index(line, sep, 1), F.substring(line, F.instr(line, F.lit(sep)) + len(sep), F.length(line))))) for sep in fixed.INDEX_SEPARATORS]
    form = "^(" + fixed.INDEX_RAW_NUMBER + r")\s+(.+)$"
    tried.append(F.when(line.rlike(form), whole(pair(F.regexp_extract(line, form, 1), F.regexp_extract(line, form, 2)))))
    return F.when(F.length(line) >= 3, F.coalesce(*tried))


def embedded_entries(pages: DataFrame) -> DataFrame:
    """(pdf, page, sheet_number, title, at) of entries in running text: a number before one of the known titles.

    Titles are looked for in order; of several entries of a number the first wins.
    """

    def entries_of(i: int, title: str) -> Column:
        p = F.lit(f"(?i)({fixed.INDEX_RAW_NUMBER})\\s+({title})")
        both = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("n"), F.regexp_extract_all("text", p, F.lit(2)).alias("t"))
        return F.transform(both, lambda x, k: F.struct(F.lit(i).alias("i"), k.alias("k"), x["n"].alias("n"), x["t"].alias("t")))

    found = [entries_of(i, title) for i, title in enumerate(fixed.INDEX_TITLES)]
    d = pages.select("pdf", "page", F.explode(F.concat(*found)).alias("x"))
    d = d.select("pdf", "page", F.struct("x.i", "x.k").alias("at"), normal_number(F.col("x.n")).alias("sheet_number"), F.col("x.t").alias("raw"))
    d = d.where(F.col("sheet_number").isNotNull() & (F.length(F.trim("raw")) >= 4)).withColumn("title", clean_title(F.col("raw"), 3)).where("title is not null")
    return d.groupBy("pdf", "page", "sheet_number").agg(F.min_by("title", "at").alias("title"), F.min("at").alias("at"))


def parse_index(pages: DataFrame) -> DataFrame:
    """Index entries of the first pages of each PDF: (pdf, sheet_number, title, page, line_no).

    ``pages``: (pdf, page, text). Only pages with an index keyword are read.
    A line that is no entry, header or preamble and doesn't begin like a
    number continues the entry before it. A page with fewer than three
    entries is searched for entries in running text too (line_no null), which
    add numbers that it lacks. Of several entries of a number the last wins.
    """
    keyword = "|".join(fixed.DRAWING_INDEX_KEYWORDS)
    mine = pages.where((F.col("page") <= fixed.INDEX_PAGES) & F.upper("text").rlike(keyword)).select("pdf", "page", "text")
    lines = mine.select("pdf", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", strip(F.col("raw")))
    up = F.upper("line")
    header = "^(?:" + "|".join(fixed.DISCIPLINE_HEADERS) + ")(?: .*)?$"
    lines = lines.where((F.col("line") != "") & ~up.rlike(keyword) & ~up.rlike("|".join(fixed.INDEX_PREAMBLE)) & ~up.rlike(header))
    # a row explode settles the long expression once
    lines = lines.withColumn("entry", F.explode(F.array(index_entry(F.col("line"))))).withColumn("is_entry", F.col("entry").isNotNull())
    lines = lines.where(F.col("is_entry") | ((F.length("line") >= 3) & ~F.col("line").rlike(r"(?i)^[A-Z]{1,2}[-.]?\d")))
    lines = lines.withColumn("n", F.sum(F.col("is_entry").cast("int")).over(Window.partitionBy("pdf", "page").orderBy("line_no")))
    part = F.struct("line_no", F.coalesce("entry.title", "line").alias("part"))
    entries = (
        lines.where("n > 0").groupBy("pdf", "page", "n")
        .agg(F.max("entry.number").alias("sheet_number"), F.min("line_no").alias("line_no"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), " ").alias("title"))
    )
    entries = last_wins(entries.drop("n"), ["pdf", "page", "sheet_number"], ["line_no"])
    few = mine.join(entries.groupBy("pdf", "page").agg(F.count("*").alias("n")), ["pdf", "page"], "left").where(F.coalesce("n", F.lit(0)) < 3)
    # on one page, an entry of a line goes before one in running text
    both = entries.select("pdf", "page", "sheet_number", "title", "line_no", F.lit(1).alias("by_line")).unionByName(
        embedded_entries(few).select("pdf", "page", "sheet_number", "title", F.lit(None).cast("int").alias("line_no"), F.lit(0).alias("by_line")))
    return last_wins(both, ["pdf", "sheet_number"], ["page", "by_line", "line_no"]).select("pdf", "sheet_number", "title", "page", "line_no")


def last_wins(d: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so rows of one key combine before the shuffle."""
    rest = [c for c in d.columns if c not in key]
    return d.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def lookup_titles(sheets: DataFrame, index: DataFrame, similar: bool = True) -> DataFrame:
    """Adds index_title and index_step (exact, variant, similar or null) to (pdf_filename, sheet_number, ...).

    Numbers are normalised first. Exact and variant spellings are one
    equi-join on the exploded spellings, the first that hits. Only if
    ``similar`` is asked for are numbers without a hit compared with similar
    keys of their own PDF, as distinct pairs of PDF and number; keys in index
    order win ties.
    """
    d = sheets.withColumn("_n", F.col("sheet_number"))
    raw = d.where(F.coalesce("_n", F.lit("")) != "").select("pdf_filename", "_n").distinct()
    asked = raw.withColumn("_p", F.explode(F.array(F.coalesce(normal_number(F.col("_n")), F.upper("_n")))))
    tried = asked.select("pdf_filename", "_n", F.posexplode(F.concat(F.array("_p"), variants(F.col("_p")))).alias("_step", "_key"))
    keys = index.select("pdf_filename", F.col("sheet_number").alias("_key"), "title")
    hits = tried.join(keys, ["pdf_filename", "_key"]).groupBy("pdf_filename", "_n").agg(F.min_by(F.struct("title", "_step"), "_step").alias("_hit"))
    hits = hits.select("pdf_filename", "_n", F.col("_hit.title").alias("index_title"), F.when(F.col("_hit._step") == 0, "exact").otherwise("variant").alias("index_step"))
    if similar:
        missed = asked.join(hits, ["pdf_filename", "_n"], "left_anti")
        near = similar_keys(missed.select("pdf_filename", "_n", "_p"), index)
        hits = hits.unionByName(near.select("pdf_filename", "_n", F.col("title").alias("index_title"), F.lit("similar").alias("index_step")))
    return d.join(hits, ["pdf_filename", "_n"], "left").drop("_n")


def _shortened(x: Column, most: int) -> Column:
    """The text without up to a third of its characters, in every way, each once."""
    def without_each(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))

    out = step = F.array(x)
    for i in range(most):
        one = F.array_distinct(F.flatten(F.transform(step, without_each)))
        step = F.when(F.length(x) >= 3 * (i + 1), one).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, step)
    return F.array_distinct(out)


#: Numbers of up to so many characters meet by what is left without a third of them.
SHORT = 11


def similar_keys(missed: DataFrame, index: DataFrame) -> DataFrame:
    """(pdf_filename, _n, title, ratio): the key of the same PDF that is most like ``_p``, from a ratio of 0.80.

    A ratio of 0.80 leaves two texts a common subsequence of 0.4 times both
    lengths, so each loses a third of its characters at most: texts meet
    where these remainders are equal, and no others are compared. Longer
    texts (in practice none) are compared where their lengths allow the ratio.
    """
    n = F.length
    asked = missed.select("pdf_filename", "_p").distinct()
    keys = index.select("pdf_filename", F.col("sheet_number").alias("key"), "title", "ord")
    left = asked.where(n("_p") <= SHORT).select("pdf_filename", "_p", F.explode(_shortened(F.col("_p"), SHORT // 3)).alias("rest"))
    right = keys.where(n("key") <= SHORT).select("pdf_filename", "key", F.explode(_shortened(F.col("key"), SHORT // 3)).alias("rest"))
    pairs = left.join(right, ["pdf_filename", "rest"]).select("pdf_filename", "_p", "key")
    lengths = 2 * F.least(n("_p"), n("key")) >= F.lit(fixed.FUZZY_RATIO) * (n("_p") + n("key"))
    long = asked.where(n("_p") > SHORT).join(keys.select("pdf_filename", "key"), "pdf_filename").unionByName(asked.where(n("_p") <= SHORT).join(keys.where(n("key") > SHORT).select("pdf_filename", "key"), "pdf_filename"))
    pairs = pairs.unionByName(long).where(lengths).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], names=["pdf_filename", "_p", "key", "ratio"])

    told = pairs.mapInArrow(run, "pdf_filename string, _p string, key string, ratio double").where(F.col("ratio") >= fixed.FUZZY_RATIO)
    best = told.join(keys, ["pdf_filename", "key"]).groupBy("pdf_filename", "_p").agg(F.max_by(F.struct("title", "ratio"), F.struct("ratio", -F.col("ord"))).alias("b"))
    return missed.join(best, ["pdf_filename", "_p"]).select("pdf_filename", "_n", "b.title", "b.ratio")


def cross_reference(d: DataFrame) -> DataFrame:
    """Index titles override titles found by pattern or place; titles read by a model that differ are flagged.

    Needs index_title, sheet_title, title_method, title_confidence and needs_review.
    """
    weak = F.col("title_method").isin("pattern", "spatial") & F.col("index_title").isNotNull() & ~F.col("sheet_title").eqNullSafe(F.col("index_title"))
    differs = (F.col("title_method") == "vision_api") & (F.upper("sheet_title") != F.upper("index_title"))
    weak, differs = F.coalesce(weak, F.lit(False)), F.coalesce(differs, F.lit(False))
    return d.select(
        *[c for c in d.columns if c not in ("sheet_title", "title_method", "title_confidence", "needs_review")],
        F.when(weak, F.col("index_title")).otherwise(F.col("sheet_title")).alias("sheet_title"),
        F.when(weak, F.lit("drawing_index_xref")).otherwise(F.col("title_method")).alias("title_method"),
        F.when(weak, F.lit(0.95)).otherwise(F.col("title_confidence")).alias("title_confidence"),
        F.when(weak, 0).when(differs, 1).otherwise(F.col("needs_review")).alias("needs_review"),
        weak.alias("xref_override"), differs.alias("xref_conflict"),
    )


def set_entries(index: DataFrame, entries: DataFrame) -> DataFrame:
    """An index with more entries (pdf_filename, sheet_number, title, ord); those given replace those of their number."""
    old = index.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    return last_wins(old, ["pdf_filename", "sheet_number"], ["_new", "ord"]).drop("_new")


def clear_entries(index: DataFrame, pdfs: DataFrame) -> DataFrame:
    """An index without the entries of some PDFs, so that they are parsed anew."""
    return index.join(pdfs.select("pdf_filename").distinct(), "pdf_filename", "left_anti")
