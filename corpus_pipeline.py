"""A corpus pipeline of five stages over ``documents``; each stage reads what its predecessor wrote.

Language identification drops documents without a language; the n-gram Jaccard join keeps the smallest doc_id of each
group of near copies; suffix-array deduplication removes byte strings that stand in a document with a smaller doc_id;
decontamination drops documents that hold a benchmark passage; BPE adds token counts and digests.

Defined results of every stage: further columns of the input are left out; an empty table gives an empty one; null lang, source
and n_chars pass through; the order of rows says nothing. Each stage states what it does with null texts and ids and with
repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import bpe, common, decontaminate, language_id, near_duplicates, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: As op3 decides: any hit, be it a window of an item or the whole of a shorter one, drops a document; hits aren't summed up.
LEAST_HIT_WORDS = 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter stay, whatever their id; null, empty and letterless texts go; repeated rows stay each."""
    path = common.tokenizer_file("piece_bpe_32k.model")
    model = language_id.train(docs, path, "doc_id", "text", "lang")
    found = language_id.predict(docs.select(F.struct(*COLUMNS).alias("row"), "text"), model, "row", "text")
    return found.where("lang_pred != 'und'").select("doc_id.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near copies stays. Null ids and null, empty and blank texts link with nothing and
    stay; rows that share an id are documents of their own, so equal ones of them leave one row and different ones all stay."""
    docs = docs.select(COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
    if not repeated:
        copies = near_duplicates.near_duplicates(docs).where("component_id != doc_id").select("doc_id")
        return docs.join(copies, "doc_id", "left_anti")
    # An id of several rows says nothing of their texts: rows are numbered in the order of ids and are documents of their own.
    named = common.written(docs.where("doc_id is not null").orderBy(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    copies = near_duplicates.near_duplicates(named, "row").where("component_id != doc_id").select(F.col("doc_id").alias("row"))
    return named.join(copies, "row", "left_anti").select(COLUMNS).unionByName(docs.where("doc_id is null"))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its text less the bytes of repeated strings, n_chars made anew. Null texts become empty; rows with a null
    id lose nothing; rows that share an id don't take from each other."""
    found = suffix_dedup.remove_repeats(docs.select(COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a hit go, whatever their id; null and empty texts have none and stay, repeated rows share their fate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.select(F.struct(*COLUMNS).alias("row"), "text"), benchmark, "row")
    return found.where(F.size("hit_words") < LEAST_HIT_WORDS).select("doc_id.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with n_tokens, ids_sha256 and decoded_sha256 beside it; a null text has no tokens."""
    return bpe.tokenized(docs.select(COLUMNS), common.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_strings", remove_repeated_strings),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: No SQL states hashing tokenizers and trained models; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.moved(stage, spark, docs, sf_dir, name)
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
