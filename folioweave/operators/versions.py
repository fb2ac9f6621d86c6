"""Append-only history: versions, operations, restore plans. Plans are queries; nothing is overwritten by asking for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(state: DataFrame, cache: DataFrame) -> DataFrame:
    """key, translation: the state's entry wins even where it is null; the cache serves only keys the state lacks."""
    s = state.select("key", F.col("translation").alias("s"), F.lit(True).alias("known"))
    c = cache.select("key", F.col("translation").alias("c"))
    return s.join(c, "key", "full_outer").select("key", F.when(F.col("known"), F.col("s")).otherwise(F.col("c")).alias("translation"))


def previous_different(versions: DataFrame) -> DataFrame:
    """key, version: the latest version whose value differs from the key's last one."""
    last = versions.groupBy("key").agg(F.max_by("value", "version").alias("now"))
    return versions.join(last, "key").where(~F.col("value").eqNullSafe(F.col("now"))).groupBy("key").agg(F.max("version").alias("version"))


def before_operation(versions: DataFrame, op: str) -> DataFrame:
    """key, version: the latest version of each key the operation touched that another operation wrote."""
    touched = versions.where(F.col("op") == op).select("key").distinct()
    return versions.where(F.col("op") != op).join(touched, "key", "left_semi").groupBy("key").agg(F.max("version").alias("version"))


def keep_last(versions: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("key").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def operations(versions: DataFrame) -> DataFrame:
    """op, first and last version, distinct keys, versions."""
    return versions.groupBy("op").agg(F.min("version").alias("first"), F.max("version").alias("last"), F.count_distinct("key").alias("keys"), F.count("*").alias("versions"))


def restore_plan(versions: DataFrame, at: int) -> DataFrame:
    """key, from_value, to_value, action for a restore to the state as of a version: same, change, or remove."""
    now = versions.groupBy("key").agg(F.max_by("value", "version").alias("from_value"))
    then = versions.where(F.col("version") <= at).groupBy("key").agg(F.max_by("value", "version").alias("to_value"), F.lit(True).alias("known"))
    both = now.join(then, "key", "left")
    action = F.when(F.col("known").isNull(), "remove").when(F.col("from_value").eqNullSafe(F.col("to_value")), "same").otherwise("change")
    return both.select("key", "from_value", "to_value", action.alias("action"))


def reconcile(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    """key, action of memory rows (key, owner): remove what the snapshot lacks, add what is free or one's own, else collision."""
    a, b = now.select("key", F.col("owner").alias("now_owner")), snapshot.select("key", F.col("owner").alias("then_owner"))
    both = a.join(b, "key", "full_outer")
    action = F.when(F.col("then_owner").isNull(), "remove").when(F.col("now_owner").isNull(), "add").when(F.col("now_owner") == F.col("then_owner"), "keep").otherwise("collision")
    return both.select("key", action.alias("action"))


def page_status(segments: DataFrame) -> DataFrame:
    """page, open, status: review while a segment needs a human, pending while one has no translation, else done."""
    out = segments.groupBy("page").agg(F.count_if("needs_human").alias("open"), F.bool_or(F.col("translation").isNull()).alias("gaps"))
    return out.select("page", "open", F.when(F.col("gaps"), "pending").when(F.col("open") > 0, "review").otherwise("done").alias("status"))


def unfinished(done: DataFrame, checked: DataFrame, order: DataFrame) -> DataFrame:
    """page, rank of done pages that aren't checked: in plan order, the rest behind."""
    return done.join(checked.select("page"), "page", "left_anti").join(order, "page", "left").select("page", F.coalesce("rank", F.lit(2**31 - 1)).cast("bigint").alias("rank"))
