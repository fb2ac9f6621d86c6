"""The model as a function of a prompt: a deterministic stand-in, prompts and the steps around a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def prompt(source: Column, terms: Column, context: Column) -> Column:
    """Non-empty sections under their headings, an empty line between."""
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(head + "\n"), body))
    return F.concat_ws("\n\n", section("Terms", terms), section("Context", context), F.concat(F.lit("|TEXT|"), source))


def mock(prompts: Column) -> Column:
    """The stand-in's answer: JSON that echoes what follows the text mark, with full confidence."""
    said = F.regexp_extract(prompts, r"(?s)\|(?:TEXT|DST)\|(.*)$", 1)
    return F.to_json(F.struct(said.alias("translation"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("notes")))


def answer(reply: Column) -> Column:
    """translation and confidence of a reply; text that isn't JSON is taken with confidence 0.1."""
    parsed = F.from_json(reply, "translation string, confidence double")
    return F.struct(F.coalesce(parsed.translation, F.trim(reply)).alias("translation"), F.when(parsed.translation.isNotNull(), F.coalesce(parsed.confidence, F.lit(1.0))).otherwise(0.1).alias("confidence"))


def translate(texts: DataFrame, known: DataFrame) -> DataFrame:
    """id, translation, confidence, origin of (id, text): what the dictionaries (id, answer, origin) know, else the model."""
    both = texts.join(known, "id", "left")
    said = answer(mock(prompt(F.col("text"), F.lit(None), F.lit(None))))
    out = F.when(F.col("answer").isNotNull(), F.struct(F.col("answer").alias("translation"), F.lit(1.0).alias("confidence"))).otherwise(said)
    return both.select("id", out.alias("out"), F.coalesce("origin", F.lit("model")).alias("origin")).select("id", "out.*", "origin")


def settle(replies: DataFrame, known: DataFrame) -> DataFrame:
    """replies (id, reply, ...) with translation, confidence, origin: what the dictionaries (id, answer, origin) know, else the reply."""
    both = replies.join(known, "id", "left").withColumn("said", answer(F.col("reply")))
    return both.withColumns({"translation": F.coalesce("answer", "said.translation"), "confidence": F.when(F.col("answer").isNotNull(), F.lit(1.0)).otherwise(F.col("said.confidence")), "origin": F.coalesce("origin", F.lit("model"))}).drop("said", "reply", "answer")


def wall_cap(tag: Column, caps: dict[str, int], default: int) -> Column:
    """The time limit of a call by its tag's first part."""
    if not caps:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring_index(tag, "_", 1)), F.lit(default))


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tag").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def transcript(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of a conversation as one Markdown text, in order; the sort is inside the conversation."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "role", "text"))), lambda m: F.concat(F.lit("**"), m.role, F.lit("**: "), T.normalize_ws(m.text)))
    return messages.groupBy(by).agg(F.array_join(lines, "\n\n").alias("transcript"))
