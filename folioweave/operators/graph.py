"""Link graph, hierarchy and page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, html, text

#: Weights of the plan's scores.
WEIGHTS = {"len": 0.4, "hotness": 0.3, "volume": 0.2, "semantic": 0.1}


def edges(pages: DataFrame, page_filter: str = ".") -> DataFrame:
    """page_id, pos (from 1, over distinct links), href."""
    return pages.select("page_id", F.posexplode(html.internal_links(F.col("html"), page_filter)).alias("pos", "href")).withColumn("pos", F.col("pos") + 1)


def in_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("href").agg(F.count("*").alias("in_degree"))


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: a reliable cut of its lineage, set up only where the session has none."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/folioweave-checkpoints")
    return df.checkpoint()


def bfs_depth(links: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """node, depth from roots over (src, dst) until nothing new is reached: frontier by frontier; each is a checkpoint, none is
    collected. More than ``most`` levels are an error, not an end."""
    reached = frontier = roots.select("node").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, most + 1):
        frontier = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = settled(frontier)
        if frontier.isEmpty():
            return reached
        reached = settled(reached.unionByName(frontier))
    raise RuntimeError(f"deeper than {most} levels")


def min_max(value: Column, reverse: bool = False) -> Column:
    """(v - low) / (high - low) over all rows, 1 minus that if reversed, 0.5 where all are equal."""
    every = Window.partitionBy()
    low, high = F.min(value).over(every), F.max(value).over(every)
    share = (value - low) / (high - low)
    return F.when(high == low, F.lit(0.5)).otherwise(1 - share if reverse else share)


def with_min_max(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Columns replaced by their min-max shares (True: reversed). One aggregate row is joined, so no row meets all others."""
    ends = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    out = df.join(F.broadcast(ends))  # one row
    for c, reverse in columns.items():
        share = (F.col(c) - F.col(f"{c}__low")) / (F.col(f"{c}__high") - F.col(f"{c}__low"))
        out = out.withColumn(c, F.when(F.col(f"{c}__high") == F.col(f"{c}__low"), F.lit(0.5)).otherwise(1 - share if reverse else share))
    return out.drop(*ends.columns)


def page_facts(pages: DataFrame, page_filter: str = ".") -> DataFrame:
    """page_id, title, host, section, volume, text_len, hotness, depth of each page in one scan and one join."""
    facts = pages.select(
        "page_id", html.title(F.col("html")).alias("title"), html.host(F.col("url")).alias("host"), F.regexp_extract(html.path(F.col("url")), "^/([^/]+)/", 1).alias("section"),
        F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint"), F.lit(0)).alias("volume"), text.text_length(F.col("html")).cast("bigint").alias("text_len"), F.size(F.split(html.path(F.col("url")), "/")).cast("bigint").alias("depth"),
    )
    links = edges(pages, page_filter)
    heat = links.join(in_degree(links), "href").groupBy("page_id").agg(F.sum("in_degree").alias("hotness"))
    return facts.join(heat, "page_id", "left").withColumn("hotness", F.coalesce("hotness", F.lit(0)))


def plan(pages: DataFrame, weights: dict[str, float] = WEIGHTS, reverse: frozenset[str] = frozenset()) -> DataFrame:
    """page_id, title, total, rank: weighted sum of min-max scores, best first, ties by page_id.

    Ranks are global, so the last step sorts; only ids and totals take part in it."""
    facts = page_facts(pages)
    semantic = facts.withColumns({"len": F.col("text_len").cast("double"), "hotness": F.col("hotness").cast("double"), "volume": F.col("volume").cast("double"), "semantic": (F.lit(9999) - F.col("depth")).cast("double")})
    scored = with_min_max(semantic, {k: k in reverse for k in weights})
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return scored.select("page_id", "title", F.round(total, 6).alias("total"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's place (from 1) in a total order. Rows are dealt by ranges of the order and sorted apart; only the
    sizes of the ranges are summed up, so no task sees all rows."""
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def ranked(scored: DataFrame) -> DataFrame:
    return numbered(scored, [F.desc("total"), F.col("page_id")], "rank")


def directory_index(links: DataFrame, members: DataFrame, threshold: float = 0.6) -> DataFrame:
    """dir, index page, coverage: the page that links most of its directory's members, where that reaches threshold."""
    sizes = members.groupBy("dir").agg(F.count_distinct("href").alias("n"))
    covered = links.join(members, ["dir", "href"]).groupBy("dir", "page_id").agg(F.count_distinct("href").alias("linked"))
    best = covered.join(sizes, "dir").withColumn("coverage", F.col("linked") / F.greatest(F.lit(1), F.col("n") - 1))
    return best.groupBy("dir").agg(F.max_by("page_id", F.struct("coverage", -F.col("page_id"))).alias("page_id"), F.max("coverage").alias("coverage")).where(F.col("coverage") >= threshold)


def predecessors(ordered: DataFrame, n: int = 5, block: int = 100_000) -> DataFrame:
    """page_id, before: the n rows before each in rank order, nearest last. Ranks are cut into blocks, and the last rows of a
    block are looked at in the next one too."""
    own = F.floor((F.col("rank") - 1) / block)
    near = F.floor((F.col("rank") - 1 + n) / block)
    rows = ordered.select("page_id", "rank", own.alias("own"), F.explode(F.array_distinct(F.array(own, near))).alias("block"))
    window = Window.partitionBy("block").orderBy("rank").rowsBetween(-n, -1)
    out = rows.withColumn("before", F.array_join(F.collect_list(F.col("page_id").cast("string")).over(window), "|"))
    return out.where("own = block").select("page_id", "before")


def date_numbers(dated: DataFrame) -> DataFrame:
    found = dates.date_candidate(F.col("text"))
    return dated.select("*", found.alias("date"), F.round(dates.float_year(found), 6).alias("year"), dates.day_number(found).alias("day"))
