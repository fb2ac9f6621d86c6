"""Structured Streaming: windows with watermarks, a file inbox, latest state, and a stateful repetition guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total by event time; works on a stream (late rows beyond the watermark drop) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def stream_parquet(spark: SparkSession, folder: str, schema, files: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def inbox(spark: SparkSession, folder: str, clean: str = "off", archive: str | None = None) -> DataFrame:
    """text, source of new files in a folder; read once each, then deleted or archived as ``clean`` says; empty ones yield
    nothing."""
    reader = spark.readStream.option("wholetext", True).option("cleanSource", clean)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return reader.text(folder).select(F.trim("value").alias("text"), F.input_file_name().alias("source")).where("text != ''")


def latest_state(stream: DataFrame, key: str, order: str, path: str, checkpoint: str):
    """Keep the last row of each key in ``path``: every micro-batch is folded in under its own number, so a replay writes
    the same state again; states before the last two are deleted. ``read_state`` gives the newest."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        every = batch
        if number > 0:
            every = spark.read.parquet(f"{path}/batch={number - 1}").unionByName(batch)
        last = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), order).alias("row")).select("row.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:  # the one before stays: a replay of this batch reads it
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest state in ``path``."""
    every = spark.read.parquet(path)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).drop("batch")


def repetition_guard(stream: DataFrame, window: int = 256, every: int = 64) -> DataFrame:
    """call, seen, period for each batch of (call, seq, chunk): the state is the text's tail and its length, so memory is
    bounded for each call; a positive period says that the tail repeats itself."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..functions.texts_udf import period

    def step(key, batches: Iterator[pd.DataFrame], state):
        tail, seen, due = state.get if state.exists else ("", 0, every)
        found = 0
        for pdf in batches:
            for chunk in pdf.sort_values("seq").chunk:
                tail, seen = (tail + chunk)[-window:], seen + len(chunk)
                if seen >= due:
                    due = seen + every
                    found = found or period(tail, window, window // 2)
        state.update((tail, seen, due))
        yield pd.DataFrame({"call": [key[0]], "seen": [seen], "period": [found]})

    return stream.groupBy("call").applyInPandasWithState(step, "call bigint, seen bigint, period int", "tail string, seen bigint, due bigint", "append", GroupStateTimeout.NoTimeout)
