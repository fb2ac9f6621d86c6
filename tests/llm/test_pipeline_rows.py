"""Rows that the pipeline's stages must keep or drop whatever else the table holds."""

import corpus_pipeline


def rows(spark, *found):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    given = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[2]), (5, texts[4]), (6, texts[4]), (6, texts[5])]
    got = corpus_pipeline.drop_near_copies(spark, rows(spark, *given).repartition(3), "").collect()
    want = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (5, texts[4]), (6, texts[5])]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_contamination_is_decided_by_item(spark, tmp_path):
    spark.createDataFrame([(1, "seven short words of one whole item"), (2, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = [(1, "x seven short words of one whole item y"), (2, "seven short words of one " * 9), (3, " ".join(f"q{i}" for i in range(5, 14))), (4, " ".join(f"q{i}" for i in range(5, 15)))]
    got = corpus_pipeline.drop_contaminated(spark, rows(spark, *given), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 3]


def test_every_stage_on_nulls_repeats_nothing_and_more_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    body = " ".join(f"word{chr(97 + i % 26)}" for i in range(40))
    given = spark.createDataFrame([(1, body, None, None, None), (1, body, None, None, None), (None, body, "en", "s", 1), (2, None, "en", "s", None), (3, "", None, "s", 0), (None, None, None, None, None), (4, "x" * 300_000, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    given = given.withColumn("n_tokens", F.lit(9)).withColumn("row", F.lit("r"))
    want = {"language_id": 4, "near_copies": 6, "repeated_strings": 7, "decontamination": 7, "bpe": 7}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given, str(tmp_path)).count() == want[name], name
        assert stage(spark, given.where("false"), str(tmp_path)).count() == 0, name
        extra = ["n_tokens", "ids_sha256", "decoded_sha256"] if name == "bpe" else []
        assert stage(spark, given, str(tmp_path)).columns == corpus_pipeline.COLUMNS + extra
