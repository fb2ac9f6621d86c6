"""Dictionaries, memories and queues as declarative upserts, merges and purges; each returns the new state or a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .containment import occurrences


def upsert(state: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """key, dst, page, usage: the last change's dst and page win, each change counts as one use; changes that leave the text
    as it is are skipped."""
    new = changes.where(F.col("src") != F.col("dst")).groupBy(T.normalize_ws(F.col("src")).alias(key)).agg(F.max_by("dst", "seq").alias("dst"), F.max_by("page", "seq").alias("page"), F.count("*").alias("usage"))
    old = state.select(key, F.col("dst").alias("dst0"), F.col("page").alias("page0"), F.col("usage").alias("usage0"))
    return old.join(new, key, "full_outer").select(key, F.coalesce("dst", "dst0").alias("dst"), F.coalesce("page", "page0").alias("page"), (F.coalesce("usage0", F.lit(0)) + F.coalesce("usage", F.lit(0))).alias("usage"))


def append_new(queue: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """The queue with items whose key it hasn't; known items keep their state; of equal new ones the first stays."""
    order = Window.partitionBy(key).orderBy("seq")
    fresh = items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").join(queue.select(key), key, "left_anti")
    return queue.unionByName(fresh)


def merge_glossary(glossary: DataFrame, incoming: DataFrame) -> DataFrame:
    """src, dst, action of a merge: added, updated (same or no dst before), conflict (another dst, the old one stays), kept."""
    new = incoming.where("src != ''").groupBy("src").agg(F.max_by("dst", "seq").alias("new_dst"))
    both = glossary.select("src", F.col("dst").alias("old_dst")).join(new, "src", "full_outer")
    action = F.when(F.col("new_dst").isNull(), "kept").when(F.col("old_dst").isNull(), "added").when(F.col("old_dst") == F.col("new_dst"), "updated").otherwise("conflict")
    return both.select("src", F.coalesce("old_dst", "new_dst").alias("dst"), action.alias("action"))


def purge_term(memory: DataFrame, term: str, canonical: str) -> DataFrame:
    """The memory without entries whose source holds the term and whose target lacks its canonical form."""
    return memory.where(~(F.col("src").contains(term) & ~F.col("dst").contains(canonical)))


def purge_keywords(memory: DataFrame, keywords: list[str], column: str = "dst") -> DataFrame:
    """The memory without entries that hold any keyword; no keywords purge nothing."""
    held = F.lit(False)
    for k in keywords:
        held = held | F.col(column).contains(k)
    return memory.where(~held)


def purge_keys(memory: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The memory without the given keys; entries without a page belong to users and stay."""
    return memory.where(F.col("page").isNull() | (F.col("page") == "")).unionByName(memory.where(F.col("page") != "").join(keys, on, "left_anti"))


def dedup_reviewed(terms: DataFrame) -> DataFrame:
    """One row a white-space-free lower source: the spaced form first, missing fields filled from the others."""
    order = F.struct(F.col("src").contains(" "), -F.col("seq"))
    fill = lambda c: F.max_by(c, F.struct(F.col(c).isNotNull(), order))
    return terms.groupBy(T.norm_key(F.col("src")).alias("key")).agg(F.max_by("src", order).alias("src"), fill("dst").alias("dst"), fill("category").alias("category"))


def learnable(phrases: DataFrame, most: int = 30) -> DataFrame:
    """Pairs fit for the phrase memory: not empty, short, placeholders at the edges only."""
    inner = F.regexp_replace(F.col("src"), rf"^(?:{T.PLACEHOLDER}|{T.BLANKS})*+|(?:{T.PLACEHOLDER}|{T.BLANKS})+$", "")
    return phrases.where((F.length(F.trim("dst")) > 0) & (F.length("src") <= most) & (F.length(inner) > 0) & ~inner.rlike(T.PLACEHOLDER) & ~F.col("dst").contains("|TEXT|"))


def invalidated(phrases: DataFrame, changes: DataFrame) -> DataFrame:
    """Phrases whose key stands in a changed segment's source, whose target stood in its old and isn't in its new text."""
    changes = changes.withColumn("id", F.xxhash64("source", "old", "new"))
    hits = occurrences(phrases.select(F.col("key").alias("src")), changes.select("id", F.col("source").alias("text"))).select("id", F.col("term").alias("key"))
    gone = hits.join(phrases, "key").join(changes.select("id", "old", "new"), "id").where(F.expr("instr(old, dst) > 0 and instr(new, dst) = 0"))
    return phrases.join(gone.select("key").distinct(), "key", "left_semi")
