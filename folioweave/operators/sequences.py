"""Ordered-sequence operators: sessions, as-of predecessors, budgets, chunks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered


def sessions(rows: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """rows with ``session``: a new one starts where a positive counter isn't above the last positive one before it."""
    window = Window.partitionBy(by).orderBy(order)
    positive = F.when(F.col(counter) > 0, F.col(counter))
    before = F.last(positive, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(positive.isNotNull() & (before.isNull() | (positive <= before)), 1).otherwise(0)
    return rows.withColumn("_start", start).withColumn("session", F.sum("_start").over(window)).drop("_start")


def as_of(rows: DataFrame, by: str, order: str, condition, columns: list[str]) -> DataFrame:
    """rows with before_<column>: the latest strictly earlier row of the key that meets the condition. One sort a key, no
    range join."""
    window = Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    kept = F.when(condition, F.struct(*columns))
    out = rows.withColumn("_before", F.last(kept, ignorenulls=True).over(window))
    return out.select(*rows.columns, *[F.col(f"_before.{c}").alias(f"before_{c}") for c in columns])


def within_budget(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """The first rows of each key while their summed sizes stay within budget; at least one."""
    window = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("total", F.sum(size).over(window)).withColumn("_n", F.row_number().over(window)).where((F.col("total") <= budget) | (F.col("_n") == 1)).drop("_n")


def buckets(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """rows with ``bucket``: n in a row share one."""
    return rows.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / n))


def quantile_picks(rows: DataFrame, size: str, tie: str, count: int) -> DataFrame:
    """Rows at ``count`` even places of the order by size, largest first. Places come from a sort by ranges; those kept are literals."""
    n = rows.count()
    places = sorted({round(k * (n - 1) / max(1, count - 1)) + 1 for k in range(count)}) if n else []
    return numbered(rows, [F.desc(size), F.col(tie)], "place").where(F.col("place").isin(places))


def adjacent(rows: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """rows with ``before`` and ``after``: the texts nearest to each row on either side, in order, one a line, while they stay within
    ``budget`` characters; the one that crosses it is cut on its far side. Rows with no text are passed over. Which rows are in
    reach is told by running sums, so a frame never holds more rows than the budget has characters."""
    window = Window.partitionBy(by).orderBy(order)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    kept = rows.withColumns({"_size": size, "_sum": F.sum(size).over(window), "_at": F.sum((size > 0).cast("int")).over(window)})
    reach = Window.partitionBy(by).orderBy("_at")
    near = F.when(F.col("_size") > 0, F.struct(F.col("_sum"), F.col("_size"), F.col(text).alias("text")))
    lists = kept.withColumns({"_before": F.collect_list(near).over(reach.rangeBetween(-budget, 0)), "_after": F.collect_list(near).over(reach.rangeBetween(0, budget))})
    left = lambda x: budget - (F.col("_sum") - F.col("_size") - x["_sum"])  # noqa: E731  characters left for x before the row
    right = lambda x: budget - (x["_sum"] - x["_size"] - F.col("_sum"))
    before = F.transform(F.filter("_before", lambda x: (x["_sum"] <= F.col("_sum") - F.col("_size")) & (left(x) > 0)), lambda x: F.right(x["text"], left(x).cast("int")))
    after = F.transform(F.filter("_after", lambda x: (x["_sum"] - x["_size"] >= F.col("_sum")) & (right(x) > 0)), lambda x: F.left(x["text"], right(x).cast("int")))
    return lists.withColumns({"before": F.array_join(before, "\n"), "after": F.array_join(after, "\n")}).drop("_size", "_sum", "_at", "_before", "_after")


def chunks(texts: DataFrame, size: int = 600) -> DataFrame:
    """id, chunk, text: units end at a line or sentence end and are packed greedily up to ``size`` characters; a longer unit
    stands alone. The packing is a fold over the units, inside the JVM."""
    units = F.regexp_extract_all("text", F.lit(r"([^\n。！？!?]*[\n。！？!?]|[^\n。！？!?]+$)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda acc, u: F.when((acc.open == "") | (F.length(acc.open) + F.length(u) <= size), F.struct(acc.done.alias("done"), F.concat(acc.open, u).alias("open"))).otherwise(F.struct(F.concat(acc.done, F.array(acc.open)).alias("done"), u.alias("open")))
    packed = F.aggregate(units, start, step, lambda acc: F.when(acc.open != "", F.concat(acc.done, F.array(acc.open))).otherwise(acc.done))
    return texts.select("id", F.posexplode(packed).alias("chunk", "text"))


def char_windows(rows: DataFrame, by: str, order: str, size: str, budget: int, overlap: int) -> DataFrame:
    """by, window, first, last: greedy windows by summed size, the next starting ``overlap`` rows before the last one's end.
    Where a window starts depends on the one before, so each key's rows are walked in turn."""

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        sizes, keys = pdf[size].tolist(), pdf[order].tolist()
        out, i = [], 0
        while i < len(sizes):
            j, total = i, 0
            while j < len(sizes) and (j == i or total + sizes[j] <= budget):
                total += sizes[j]
                j += 1
            out.append((pdf[by].iloc[0], len(out) + 1, keys[i], keys[j - 1]))
            if j == len(sizes):
                break
            i = max(i + 1, j - overlap)
        return pd.DataFrame(out, columns=[by, "window", "first", "last"])

    kinds = dict(rows.dtypes)
    return rows.select(by, order, size).groupBy(by).applyInPandas(walk, f"{by} {kinds[by]}, window bigint, first {kinds[order]}, last {kinds[order]}")
