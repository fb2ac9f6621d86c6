"""Plans of hierarchical sites: indexes of folders, ranks in levels, flags, scores, order and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered, settled, with_min_max
from .linkage import composite_ranks

#: Scores by weight; those in REVERSED are better when smaller.
WEIGHTS = {"semantic": 0.4, "hotness": 0.1, "depth": 0.1, "chrono": 0.1, "volume": 0.05, "nav": 0.05, "dfs": 0.05, "len": 0.05, "is_index": 0.05, "has_semantic": 0.03, "is_orphan": 0.02}
REVERSED = frozenset(("semantic", "depth", "volume", "nav", "dfs"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def members(pages: DataFrame, links: DataFrame) -> DataFrame:
    """dir, page: the files of each folder, and for each folder below it the first page in there that one of its files links to
    (files in order, links in order), else the first by name."""
    files = pages.select(folder(F.col("page")).alias("dir"), "page")
    subs = files.select("dir").distinct().where("dir != ''").select(F.col("dir").alias("sub"), folder(F.col("dir")).alias("dir"))
    linked = links.withColumns({"dir": folder(F.col("src")), "sub": folder(F.col("dst"))}).groupBy("dir", "sub").agg(F.min_by("dst", F.struct("src", "pos")).alias("linked"))
    first = files.groupBy(F.col("dir").alias("sub")).agg(F.min("page").alias("first"))
    entries = subs.join(linked, ["dir", "sub"], "left").join(first, "sub").select("dir", F.coalesce("linked", "first").alias("page"))
    return files.unionByName(entries).distinct()


def indexes(pages: DataFrame, links: DataFrame, threshold: float = 0.6) -> DataFrame:
    """dir, index, coverage: the member of each folder that links to most of its members (of all but itself), where that share
    reaches the threshold; of equal ones the first by name."""
    inside = members(pages, links)
    size = inside.groupBy("dir").agg(F.count("*").alias("n"))
    out = links.select(F.col("src").alias("page"), F.col("dst")).distinct()
    covered = inside.join(out, "page").join(inside.select("dir", F.col("page").alias("dst")), ["dir", "dst"]).groupBy("dir", "page").agg(F.count("*").alias("hit"))
    ratio = covered.join(size, "dir").withColumn("coverage", F.col("hit") / F.greatest(F.lit(1), F.col("n") - 1))
    best = ratio.where(F.col("coverage") >= threshold).groupBy("dir").agg(F.max("coverage").alias("coverage"))
    return ratio.join(best, ["dir", "coverage"]).groupBy("dir").agg(F.min("page").alias("index"), F.first("coverage").alias("coverage"))


def level_ranks(pages: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """dir, page, rank (from 0), linked: in each folder with an index the index first, then members in the order of its links,
    then the rest by name."""
    pos = links.select(F.col("src").alias("index"), F.col("dst").alias("page"), "pos").groupBy("index", "page").agg(F.min("pos").alias("pos"))
    rows = members(pages, links).join(found.select("dir", "index"), "dir").join(pos, ["index", "page"], "left")
    order = Window.partitionBy("dir").orderBy(F.desc(F.col("page") == F.col("index")), F.col("pos").asc_nulls_last(), "page")
    return rows.select("dir", "page", (F.row_number().over(order) - 1).alias("rank"), (F.col("pos").isNotNull() | (F.col("page") == F.col("index"))).alias("linked"))


def scores(pages: DataFrame, links: DataFrame, threshold: float = 0.6) -> DataFrame:
    """pages (page, date number, volume, nav, dfs, depth, in_degree, text_len) with semantic and flags, each score from 0 to 1."""
    found = settled(indexes(pages, links, threshold))
    ranks = settled(level_ranks(pages, links, found))
    # A folder's rank is that of its entry in the folder above; folders without one count 0.
    entry = ranks.withColumn("sub", folder(F.col("page"))).where("sub != dir and sub != ''").groupBy("sub").agg(F.max("rank").alias("rank"))
    every = pages.select(F.explode(_folders(folder(F.col("page")))).alias("dir")).distinct()
    nodes = every.join(entry, F.col("dir") == F.col("sub"), "left").select(F.col("dir").alias("node"), F.when(F.col("dir") != "", folder(F.col("dir"))).alias("parent"), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.coalesce("rank", F.lit(0))).alias("rank"))
    paths = composite_ranks(nodes).select(F.col("node").alias("dir"), "path_rank")
    rows = pages.withColumn("dir", folder(F.col("page"))).join(paths, "dir", "left").join(ranks, ["dir", "page"], "left").join(found.select(F.col("index").alias("page"), F.lit(1.0).alias("is_index")), "page", "left")
    own = F.col("path_rank") * 1000 + F.coalesce("rank", F.lit(0))
    rows = rows.select(
        "page", own.cast("double").alias("semantic"), F.col("in_degree").cast("double").alias("hotness"), F.col("depth").cast("double").alias("depth"), F.coalesce("date", F.lit(0)).cast("double").alias("chrono"),
        F.coalesce("volume", F.lit(0)).cast("double").alias("volume"), F.coalesce("nav", F.lit(9999)).cast("double").alias("nav"), F.coalesce("dfs", F.lit(0)).cast("double").alias("dfs"), F.col("text_len").cast("double").alias("len"),
        F.coalesce("is_index", F.lit(0.0)).alias("is_index"), F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0).alias("has_semantic"), F.when(F.col("rank").isNotNull() & ~F.col("linked"), 1.0).otherwise(0.0).alias("is_orphan"),
    )
    return with_min_max(rows, {c: c in REVERSED for c in ("semantic", "hotness", "depth", "chrono", "volume", "nav", "dfs", "len")})


def _folders(path: Column) -> Column:
    """A folder and all above it, the root as ''."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def plan(scored: DataFrame, weights: dict[str, float] = WEIGHTS, flipped: frozenset[str] = frozenset(), kept: DataFrame | None = None) -> DataFrame:
    """page, total, rank, reason: best total first, ties by page. flipped scores count 1 - x. A kept order (page, rank) stays for
    the pages that it has; others follow. The reason names the total, the largest score (the first of equals) and the flags."""
    value = {k: 1 - F.col(k) if k in flipped else F.col(k) for k in weights}
    total = F.round(sum((value[k] * w for k, w in weights.items()), F.lit(0.0)), 6)
    top = F.greatest(*value.values())
    name = F.lit(None).cast("string")
    for k in reversed(list(weights)):
        name = F.when(value[k] == top, k).otherwise(name)
    flag = lambda c, said: F.when(F.col(c) > 0, F.lit(said))
    reason = F.concat_ws("; ", F.format_string("total %.3f", total), F.format_string("%s %.2f", name, top), flag("has_semantic", "ordered"), flag("is_index", "index"), flag("is_orphan", "orphan"))
    rows = scored.select("page", total.alias("total"), reason.alias("reason"))
    if kept is None:
        return numbered(rows, [F.desc("total"), F.col("page")], "rank")
    return numbered(rows.join(kept.select("page", F.col("rank").alias("_kept")), "page", "left"), [F.col("_kept").asc_nulls_last(), F.desc("total"), F.col("page")], "rank").drop("_kept")


def enriched_dates(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """page, date of pages (page, date): a null date becomes the first one that the anchors (dst, pos, date) of an index to it say."""
    said = anchors.where("date is not null").groupBy(F.col("dst").alias("page")).agg(F.min_by("date", "pos").alias("said"))
    return pages.join(said, "page", "left").select("page", F.coalesce("date", "said").alias("date"))
