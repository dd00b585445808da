"""Column profiles: geometry of borders from per-column values.

A profile is a relation (id, x, v); windows run within one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_counts(pixels: DataFrame) -> DataFrame:
    """Edge pixels of each column: (id, x, v) from (id, x, y, edge)."""
    return pixels.groupBy("id", "x").agg(F.count_if("edge").alias("v"))


def agreement(pixels: DataFrame, pages: int, ratio: float = 0.6) -> DataFrame:
    """(id, x, y, all, majority, any) of edges over the pages of a set."""
    n = F.count_if("edge")
    return pixels.groupBy("id", "x", "y").agg((n == pages).alias("all"), (n >= F.ceil(F.lit(pages * ratio))).alias("majority"), (n > 0).alias("any"))


def smoothed(p: DataFrame, before: int = 5, after: int = 4) -> DataFrame:
    """Adds s, the moving average; beyond its ends a profile goes on in its own mirror image, the end column first."""
    width = F.max("x").over(Window.partitionBy("id")) + 1
    d = p.withColumn("_n", width)
    at = F.array_compact(F.array(F.col("x"), F.when(F.col("x") < before, -1 - F.col("x")), F.when(F.col("x") >= F.col("_n") - after, 2 * F.col("_n") - 1 - F.col("x"))))
    d = d.withColumn("_at", F.explode(at))
    d = d.withColumn("s", F.avg("v").over(Window.partitionBy("id").orderBy("_at").rowsBetween(-before, after)))
    return d.where(F.col("_at") == F.col("x")).drop("_n", "_at")


def noise_level(p: DataFrame, share: float = 0.95) -> DataFrame:
    """(id, level): a percentile of the left half."""
    width = p.groupBy("id").agg(((F.max("x") + 1) / 2).alias("half"))
    return p.join(width, "id").where(F.col("x") < F.col("half")).groupBy("id").agg(F.percentile("v", share).alias("level"))


def first_sustained(p: DataFrame, threshold: float, run: int) -> DataFrame:
    """(id, x): the first x from which ``run`` columns in a row are above a threshold."""
    w = Window.partitionBy("id").orderBy("x").rowsBetween(0, run - 1)
    d = p.withColumn("low", F.min("v").over(w)).withColumn("n", F.count("*").over(w))
    return d.where((F.col("n") == run) & (F.col("low") > threshold)).groupBy("id").agg(F.min("x").alias("x"))


def longest_run(p: DataFrame, threshold: float) -> DataFrame:
    """(id, longest): the longest run of columns above a threshold, by gaps and islands."""
    d = p.where(F.col("v") > threshold)
    island = F.col("x") - F.row_number().over(Window.partitionBy("id").orderBy("x"))
    return d.withColumn("island", island).groupBy("id", "island").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("longest"))


def peaks(p: DataFrame) -> DataFrame:
    """(id, n, first, last) of columns above mean plus one deviation."""
    m = p.groupBy("id").agg((F.avg("v") + F.stddev_pop("v")).alias("cut"))
    return p.join(m, "id").where(F.col("v") > F.col("cut")).groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))


def gradient(p: DataFrame) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy("id").orderBy("x")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return p.withColumn("g", F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2))


def position_bins(lines: DataFrame, width: float = 0.02, agree: int = 2) -> DataFrame:
    """(id, x): the rightmost bin of positions that ``agree`` lines or more fall in."""
    return lines.groupBy("id", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n"), F.avg("pos").alias("mean")).where(F.col("n") >= agree).groupBy("id").agg(F.max_by("mean", "bin").alias("x"))


def clusters(lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(id, mean, n) of positions clustered in order against the running mean of the open cluster.

    An ordered fold over one id's positions; an id is one page set.
    """
    zero = F.array().cast("array<struct<total:double,n:int>>")

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) > 0) & (F.abs(x - last["total"] / last["n"]) <= tolerance)
        more = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(fits, more).otherwise(F.concat(acc, F.array(F.struct(x.alias("total"), F.lit(1).alias("n")))))

    d = lines.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("all"))
    return d.select("id", F.explode(F.aggregate("all", zero, step)).alias("c")).select("id", (F.col("c.total") / F.col("c.n")).alias("mean"), F.col("c.n").alias("n"))


def cluster_summary(lines: DataFrame) -> DataFrame:
    """(id, cluster, mean, least, most, total_length, max_length, segments) of lines (id, cluster, pos, length)."""
    return lines.groupBy("id", "cluster").agg(
        F.avg("pos").alias("mean"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.sum("length").alias("total_length"), F.max("length").alias("max_length"), F.count("*").alias("segments"))


def rightmost_long_line(lines: DataFrame, least: float = 0.7, near: float = 0.015, agree: int = 2) -> DataFrame:
    """(id, x): the rightmost position, rounded to hundredths, that ``agree`` long lines or more stand within ``near`` of.

    A line is counted at the few hundredths around it, so lines are joined
    to positions by key.
    """
    long = lines.where(F.col("length") > least)
    at = F.round(F.col("pos"), 2)
    places = long.select("id", (at * 100).cast("long").alias("k")).distinct()
    reach = int(near * 100) + 1
    votes = long.select("id", "pos", F.explode(F.sequence((at * 100).cast("long") - reach, (at * 100).cast("long") + reach)).alias("k"))
    votes = votes.where(F.abs(F.col("pos") - F.col("k") / 100) < near).groupBy("id", "k").agg(F.count("*").alias("n"))
    return places.join(votes, ["id", "k"]).where(F.col("n") >= agree).groupBy("id").agg((F.max("k") / 100).alias("x"))


def refined_border(estimates: DataFrame) -> DataFrame:
    """(id, x1, spread, confidence, method, n) of the borders that several pages gave: their median, surer the nearer they lie."""
    d = estimates.where("x1 is not null").groupBy("id").agg(F.median("x1").alias("x1"), (F.max("x1") - F.min("x1")).alias("spread"), F.count("*").alias("n"))
    one = F.col("n") == 1
    confidence = F.when(one, 0.7).when(F.col("spread") < 0.02, 0.95).when(F.col("spread") < 0.05, 0.80).otherwise(0.60)
    return d.select("id", "x1", "spread", confidence.alias("confidence"), F.when(one, "ai_vision_single").otherwise("ai_vision_multi").alias("method"), "n")


def dense_start(p: DataFrame, share: float = 0.3) -> DataFrame:
    """(id, x): the first column of the right half whose value is above a share of the mean of that half's last tenth."""
    w = p.groupBy("id").agg((F.max("x") + 1).alias("w"))
    d = p.join(w, "id").withColumn("start", F.floor(F.col("w") * 0.5)).where(F.col("x") >= F.col("start"))
    last = F.col("x") >= F.col("w") - F.floor((F.col("w") - F.col("start")) * 0.1)
    mean = d.groupBy("id").agg(F.avg(F.when(last, F.col("v"))).alias("mean"))
    return d.join(mean, "id").where(F.col("v") > F.col("mean") * F.lit(share)).groupBy("id").agg(F.min("x").alias("x"))


def strong_columns(p: DataFrame, height: float, share: float, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """(id, n, first, last) of the columns between two fractions of the width whose count is above a share of the height."""
    w = p.groupBy("id").agg((F.max("x") + 1).alias("w"))
    d = p.join(w, "id").where((F.col("x") >= F.floor(F.col("w") * F.lit(start))) & (F.col("x") < F.floor(F.col("w") * F.lit(stop))) & (F.col("v") > F.lit(share * height)))
    return d.groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))


def steady_box(pixels: DataFrame, share: float = 0.10) -> DataFrame:
    """(id, x0, y0, x1, y1): the box of the pixels that vary least over a set's pages, from (id, page, x, y, v)."""
    v = pixels.groupBy("id", "x", "y").agg(F.var_pop("v").alias("var"))
    cut = v.groupBy("id").agg(F.percentile("var", share).alias("cut"))
    return v.join(cut, "id").where(F.col("var") <= F.col("cut")).groupBy("id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def compared_methods(found: DataFrame, methods: list[str], near: float = 0.03) -> DataFrame:
    """One row an id with each method's x1, how far they lie apart and whether they agree; from (id, method, x1)."""
    d = found.groupBy("id").pivot("method", methods).agg(F.first("x1"))
    xs = [F.col(f"`{m}`") for m in methods]
    n = F.size(F.array_compact(F.array(*xs)))
    spread = F.when(n >= 2, F.greatest(*xs) - F.least(*xs))
    return d.withColumn("spread", spread).withColumn("agree", F.when(n >= 2, spread < near))


def page_angles(segments: DataFrame) -> DataFrame:
    """(page, angle, confidence, lines): whether a page is turned, from segments (page, x1, y1, x2, y2).

    Below ten lines nothing is said. A page is turned by 90 degrees if lines
    near the vertical are more than 1.5 times those near the horizontal.
    """
    a = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    folded = F.abs(a) % 90
    d = segments.groupBy("page").agg(
        F.count("*").alias("lines"), F.count_if((F.abs(a - 90) < 10) | (F.abs(a + 90) < 10)).alias("up"), F.count_if(F.abs(a) < 10).alias("flat"), F.count_if((folded < 5) | (folded > 85)).alias("straight"))
    few, turned = F.col("lines") < 10, F.col("up") > F.col("flat") * 1.5
    return d.select("page", F.when(~few & turned, 90).otherwise(0).alias("angle"), F.when(few, 0.0).when(turned, F.col("up") / F.col("lines")).otherwise(F.col("straight") / F.col("lines")).alias("confidence"), "lines")


def best_region(regions: DataFrame, density: float) -> DataFrame:
    """(page, region, keywords, score, confidence): the region of each page with the best score of those with two keywords, the first of equals.

    ``regions``: (page, ord, region, keywords, density) in order of search.
    The score is the number of keywords, and a half for text denser than
    ``density``. Pages without such a region get the default one.
    """
    d = regions.withColumn("score", F.col("keywords") + F.when(F.col("density") > F.lit(density), 0.5).otherwise(0.0))
    best = d.groupBy("page").agg(F.max_by(F.when(F.col("keywords") >= 2, F.struct("region", "keywords", "score")), F.when(F.col("keywords") >= 2, F.struct("score", -F.col("ord")))).alias("b"))
    return best.select("page", F.coalesce("b.region", F.lit("bottom_right_tight")).alias("region"), F.coalesce("b.keywords", F.lit(0)).alias("keywords"), F.coalesce("b.score", F.lit(0.0)).alias("score"),
                       F.when(F.col("b").isNull(), "LOW").when(F.col("b.keywords") >= 3, "HIGH").otherwise("MEDIUM").alias("confidence"))
