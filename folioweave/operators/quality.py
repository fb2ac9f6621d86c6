"""Consistency rules, reports and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .containment import occurrences


def placeholder_rule(pairs: DataFrame, token: str = "[[P") -> DataFrame:
    """id, src_n, dst_n of pairs (id, src, dst) whose placeholder counts differ."""
    n = lambda c: T.count_occurrences(F.col(c), F.lit(token))
    return pairs.select("id", n("src").alias("src_n"), n("dst").alias("dst_n")).where("src_n != dst_n")


def token_differences(pairs: DataFrame, pattern: str = T.PLACEHOLDER) -> DataFrame:
    """id, missing, extra, repeated: tokens of src that dst lacks, those it has besides, those it has more often than src."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    counted = lambda c: pairs.select("id", F.explode(tokens(F.col(c))).alias("token")).groupBy("id", "token").agg(F.count("*").alias(f"{c}_n"))
    both = counted("src").join(counted("dst"), ["id", "token"], "full_outer").fillna(0, ["src_n", "dst_n"])
    listed = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("token")))), "|")
    found = both.where("src_n != dst_n").groupBy("id").agg(listed(F.col("dst_n") == 0).alias("missing"), listed(F.col("src_n") == 0).alias("extra"), listed((F.col("src_n") > 0) & (F.col("dst_n") > F.col("src_n"))).alias("repeated"))
    return found


def restore_placeholders(src: Column, dst: Column) -> Column:
    """dst with the leading placeholders of src in front and its other missing ones behind."""
    want = T.placeholders(src)
    lost = F.filter(want, lambda p: ~F.contains(dst, p))
    lead = T.placeholders(F.regexp_extract(src, rf"^(?:{T.PLACEHOLDER}|{T.BLANKS})*", 0))
    return F.concat(F.array_join(F.array_intersect(lost, lead), ""), dst, F.array_join(F.array_except(lost, lead), ""))


def term_rule(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, src, dst of terms (src, dst) that stand in a pair's source while their target isn't in its translation."""
    hits = occurrences(glossary, pairs.select("id", F.col("src").alias("text"))).select("id", F.col("term").alias("src"))
    both = hits.join(glossary.select("src", F.col("dst").alias("term_dst")), "src").join(pairs.select("id", F.col("dst").alias("translation")), "id")
    return both.where(F.expr("instr(coalesce(translation, ''), term_dst) = 0")).select("id", "src", F.col("term_dst").alias("dst")).distinct()


def severity_counts(issues: DataFrame, by: str = "page") -> DataFrame:
    """total, high, mid, low, unresolved for each page; an issue without a flag counts as resolved."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return issues.groupBy(by).agg(F.count("*").alias("total"), count("high"), count("mid"), count("low"), F.count_if(~F.coalesce("resolved", F.lit(True))).alias("unresolved"))


def report_rollup(issues: DataFrame, keys: list[str]) -> DataFrame:
    return issues.rollup(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "high").alias("high"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by the order columns."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")).select(key, "_row.*")


def categories(texts: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first pattern that matches, else '?'."""
    out = None
    for name, pattern in rules:
        out = F.when(texts.rlike(pattern), name) if out is None else out.when(texts.rlike(pattern), name)
    return out.otherwise("?")


def adopted_groups(items: DataFrame) -> DataFrame:
    """page, segment, opinions: adopted items by segment, in item order."""
    spread = items.where("status = 'adopted'").select("page", F.explode("segments").alias("segment"), "id", "suggestion")
    return spread.groupBy("page", "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "suggestion"))), lambda x: x.suggestion), "|").alias("opinions"))


def apply_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with the verdict's status; a replaced suggestion is kept as origin; unknown verdicts skip."""
    v = verdicts.select("id", F.col("verdict"), F.col("suggestion").alias("new"))
    both = items.join(v, "id", "left")
    status = F.when(F.col("verdict") == "adopt", "adopted").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    replaced = (F.col("verdict") == "adopt") & (F.coalesce("new", F.lit("")) != "") & (F.col("new") != F.col("suggestion"))
    return both.select("id", status.alias("status"), F.when(replaced, F.col("new")).otherwise(F.col("suggestion")).alias("suggestion"), F.when(replaced, F.col("suggestion")).alias("origin"))


def jaccard_stability(hits: DataFrame) -> DataFrame:
    """grp, stability: mean Jaccard over the pairs of a group's runs (grp, run, item); fewer than two runs: 1."""
    sets = hits.groupBy("grp", "run").agg(F.count_distinct("item").alias("size"))
    runs = sets.select("grp", F.col("run").alias("a"), F.col("size").alias("na")).join(sets.select("grp", F.col("run").alias("b"), F.col("size").alias("nb")), "grp").where("a < b")
    one = hits.select("grp", F.col("run").alias("a"), "item").distinct()
    both = one.join(one.withColumnRenamed("a", "b"), ["grp", "item"]).where("a < b").groupBy("grp", "a", "b").agg(F.count("*").alias("common"))
    scored = runs.join(both, ["grp", "a", "b"], "left").withColumn("j", F.coalesce("common", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("common", F.lit(0))))
    return hits.select("grp").distinct().join(scored.groupBy("grp").agg(F.avg("j").alias("j")), "grp", "left").select("grp", F.round(F.coalesce("j", F.lit(1.0)), 6).alias("stability"))


def last_rows(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")
