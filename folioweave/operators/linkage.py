"""Predecessors, context packs, log linkage, grouping of logs, clusters and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import settled


def near(value: Column, low: float, high: float) -> Column:
    """1 at low, 0 at high, straight between, never outside; 1 where there is no room between them."""
    if high <= low:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(high) - value) / (high - low)))


def link_predecessors(links: DataFrame, pages: DataFrame, k: int = 3, weights: tuple[float, float] = (3.0, 1.0), hops: tuple[float, float] = (2, 8), distance: tuple[float, float] = (1, 128)) -> DataFrame:
    """page, before, score: of the pages that link to a page (links: src, dst; pages: page, path, rank, is_index), indexes left
    out, the k best by path hops and plan distance. A page without a rank is as far as can be. Every link is looked at once; the
    best are kept in each task before they meet."""
    p = pages.select("page", "path", "rank")
    a = pages.where(~F.coalesce("is_index", F.lit(False))).select(F.col("page").alias("src"), F.col("path").alias("src_path"), F.col("rank").alias("src_rank"))
    met = links.select("src", F.col("dst").alias("page")).distinct().join(a, "src").join(p, "page")
    apart = F.coalesce(F.abs(F.col("rank") - F.col("src_rank")).cast("double"), F.lit(float(distance[1])))
    scored = met.withColumn("score", weights[0] * near(T.path_hops(F.col("src_path"), F.col("path")), *hops) + weights[1] * near(apart, *distance))
    order = Window.partitionBy("page").orderBy(F.desc("score"), F.col("src_rank").asc_nulls_last(), "src")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("page", F.col("src").alias("before"), F.round("score", 6).alias("score"))


def context_pack(sources: list[tuple[str, DataFrame]], summaries: DataFrame) -> DataFrame:
    """page_id, pack: summaries of a page's predecessors, each once under the first source that names it, sources in order."""
    every = None
    for n, (name, df) in enumerate(sources):
        df = df.select("page_id", "before", F.lit(n).alias("prio"), F.lit(name).alias("source"))
        every = df if every is None else every.unionByName(df)
    first = every.groupBy("page_id", "before").agg(F.min_by("source", "prio").alias("source"), F.min("prio").alias("prio"))
    told = first.join(summaries, F.col("before") == summaries["id"]).where(F.length("summary") > 0)
    part = F.sort_array(F.collect_list(F.struct("prio", "before", "source", "summary")))
    return told.groupBy("page_id").agg(F.array_join(F.transform(part, lambda x: F.concat(x.source, F.lit(":"), x.before.cast("string"), F.lit(" "), x.summary)), "\n").alias("pack"))


def note_relevance(notes: DataFrame, texts: DataFrame, k: int = 6) -> DataFrame:
    """id, note, score, rank: summed lengths of a text's blank-separated tokens (repeats count) that a note holds as words."""
    split = lambda c: F.filter(F.split(F.lower(c), f"{T.BLANKS}+"), lambda t: t != "")
    said = texts.select("id", F.explode(split(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    held = notes.select(F.col("id").alias("note"), F.explode(F.array_distinct(split(F.concat_ws(" ", "quote", "summary")))).alias("token"))
    scored = said.join(held, "token").groupBy("id", "note").agg(F.sum(F.col("n") * F.length("token")).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "note")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def link_logs(logs: DataFrame, runs: DataFrame, slack: float = 2.0, width: float = 3600.0) -> DataFrame:
    """log, run, how: by the run's tag, else by time: start <= t <= end + slack. Times meet in slots of ``width`` seconds, so the
    interval join is one on equality; a log inside several runs goes to the one that began last."""
    tagged = logs.join(runs.select(F.col("run").alias("tag"), F.col("run")), "tag").select("log", "run", F.lit("tag").alias("how"))
    rest = logs.join(tagged.select("log"), "log", "left_anti").withColumn("slot", F.floor(F.col("t") / width))
    slots = runs.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") + slack) / width))))
    timed = rest.join(slots, "slot").where((F.col("start") <= F.col("t")) & (F.col("t") <= F.col("end") + slack)).groupBy("log").agg(F.max_by("run", F.struct("start", "run")).alias("run"))
    return tagged.unionByName(timed.select("log", "run", F.lit("time").alias("how")))


def cycles(rows: DataFrame, by: str, order: str, page: str, least: int = 2) -> DataFrame:
    """rows with ``cycle``: a new one starts where the page number falls below the last; shorter ones than ``least`` are dropped."""
    window = Window.partitionBy(by).orderBy(order)
    start = F.when(F.lag(page).over(window).isNull() | (F.col(page) < F.lag(page).over(window)), 1).otherwise(0)
    marked = rows.withColumn("_s", start).withColumn("cycle", F.sum("_s").over(window)).drop("_s")
    return marked.withColumn("_n", F.count("*").over(Window.partitionBy(by, "cycle"))).where(F.col("_n") >= least).drop("_n")


def tasks(rows: DataFrame, by: str, order: str, task: str, messages: str) -> DataFrame:
    """rows with ``task_of``: the row's own task, else a new one where at most two messages stand in the call, else the last one's."""
    window = Window.partitionBy(by).orderBy(order)
    own = F.coalesce(F.col(task), F.when(F.col(messages) <= 2, F.concat(F.lit("new_"), F.col(order).cast("string"))))
    return rows.withColumn("task_of", F.last(own, ignorenulls=True).over(window))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def confidence_rollup(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.min("confidence").alias("confidence"), F.bool_or("needs_human").alias("needs_human"))


def distribution(values: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median (the upper one), least, p10 and the count below 0.4 of each group, by exact ranks."""
    window = Window.partitionBy(by).orderBy(value)
    ranked = values.select(by, F.col(value).alias("v"), (F.row_number().over(window) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("v")))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), at(F.floor(F.col("n") / 2)).alias("median"), F.min("v").alias("least"), at(F.floor(F.col("n") / 10)).alias("p10"), F.count_if(F.col("v") < 0.4).alias("low"))


def costs(runs: DataFrame, tokens: int = 100_000, seconds: float = 300.0) -> DataFrame:
    flag = F.when(F.col("calls") == 0, "FAILED").when((F.col("completion_tokens") > tokens) | (F.col("seconds") > seconds), "long").otherwise("")
    return runs.withColumn("flag", flag)


def coverage(found: DataFrame) -> DataFrame:
    """condition, clusters, share, new: distinct clusters a condition found, their share of all, those no 'whole' run found."""
    distinct = found.select("condition", "cluster").distinct()
    total = found.agg(F.count_distinct("cluster").alias("total"))
    whole = distinct.where("condition = 'whole'").select("cluster")
    new = distinct.join(whole, "cluster", "left_anti").groupBy("condition").agg(F.count("*").alias("new"))
    out = distinct.groupBy("condition").agg(F.count("*").alias("clusters")).join(F.broadcast(total)).join(new, "condition", "left")  # one row
    return out.select("condition", "clusters", F.round(F.col("clusters") / F.col("total"), 6).alias("share"), F.coalesce("new", F.lit(0)).alias("new"))


def clusters(pairs: DataFrame, most: int = 50) -> DataFrame:
    """node, cluster (smallest node reached) over (a, b): labels spread along edges and jump to their label's label, each round
    a checkpoint."""
    both = settled(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.select(F.col("a").alias("node")).distinct().withColumn("cluster", F.col("node")))
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("cluster", "near").alias("cluster"))
        jump = moved.select(F.col("node").alias("cluster"), F.col("cluster").alias("far"))
        new = settled(moved.join(jump, "cluster").select("node", F.least("cluster", "far").alias("cluster")))
        if new.join(labels, ["node", "cluster"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError("clusters did not settle")


def composite_ranks(nodes: DataFrame, levels: int = 64) -> DataFrame:
    """node, path (ranks from the root down) and path_rank = parent's path_rank * 1000 + rank, level by level from the roots
    (parent null). Order by path: it holds for any ranks; path_rank tells only ranks below 1000 apart, and is null where it would
    overflow. More than ``levels`` levels are an error."""
    rank = F.col("rank").cast("bigint")
    done = level = nodes.where("parent is null").select("node", F.array(rank).alias("path"), rank.alias("path_rank"))
    for _ in range(levels):
        up = level.select(F.col("node").alias("parent"), F.col("path").alias("up"), F.col("path_rank").alias("above"))
        level = settled(nodes.join(up, "parent").select("node", F.concat("up", F.array(rank)).alias("path"), F.try_add(F.try_multiply(F.col("above"), F.lit(1000)), rank).alias("path_rank")))
        if level.isEmpty():
            return done
        done = done.unionByName(level)
    raise RuntimeError(f"deeper than {levels} levels")


def depth_first(links: DataFrame, site: str = "site") -> DataFrame:
    """node, place: pre-order from each site's smallest root along ordered links, then the rest in order. The order of a visit
    depends on all before it, so a site is walked in one task."""

    def walk(pdf):
        import pandas as pd

        after: dict = {}
        for src, pos, dst in sorted(zip(pdf.src, pdf.pos, pdf.dst, strict=True)):
            after.setdefault(src, []).append(dst)
        seen: dict = {}
        for root in sorted(after):
            stack = [root]
            while stack:
                node = stack.pop()
                if node not in seen:
                    seen[node] = len(seen) + 1
                    stack.extend(reversed(after.get(node, [])))
        return pd.DataFrame({site: [pdf[site].iloc[0]] * len(seen), "node": list(seen), "place": list(seen.values())})

    return links.groupBy(site).applyInPandas(walk, f"{site} string, node string, place bigint")


def residual_tokens(pairs: DataFrame, pattern: str) -> DataFrame:
    """id, token of each token of the class that stands in both a source and, outside brackets, its translation."""
    every = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
    outside = F.regexp_replace("dst", r"[(（][^)）]*[)）]", " ")
    return pairs.select("id", F.explode(F.array_intersect(every(outside), every(F.col("src")))).alias("token"))


def reassemble(gaps: DataFrame) -> DataFrame:
    """page, text: pieces (page, start, piece, translation) in order, trimmed translations in the place of their source."""
    said = F.when(F.coalesce("translation", F.lit("")) != "", F.trim("translation")).otherwise(F.col("piece"))
    part = F.sort_array(F.collect_list(F.struct("start", said.alias("said"))))
    return gaps.groupBy("page").agg(F.array_join(F.transform(part, lambda x: x.said), "").alias("text"))


def rebuild(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, text: the translation's lines, those whose source line is a dictionary entry replaced by its target; a pair whose
    line counts differ stays as it is."""
    s, t = F.split("src", "\n"), F.split("dst", "\n")
    fit = pairs.withColumn("fits", F.size(s) == F.size(t))
    lines = fit.where("fits").select("id", F.posexplode(F.arrays_zip(s.alias("s"), t.alias("t"))).alias("n", "z")).select("id", "n", F.col("z.s").alias("s"), F.col("z.t").alias("t"))
    done = lines.join(dictionary.select(F.col("src").alias("key"), F.col("dst").alias("known")), T.normalize_ws(F.col("s")) == F.col("key"), "left")
    part = F.sort_array(F.collect_list(F.struct("n", F.coalesce("known", "t").alias("x"))))
    built = done.groupBy("id").agg(F.array_join(F.transform(part, lambda p: p.x), "\n").alias("text"))
    return built.unionByName(fit.where("not fits").select("id", F.col("dst").alias("text")))
