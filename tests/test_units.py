"""Facts about single operators that the tables can't show: other scripts, states, files, streams."""

import json

from pyspark.sql import functions as F

from folioweave.functions import dates, html, texts_udf
from folioweave.functions import text as T
from folioweave.operators import graph, memory, quality, sequences, similarity, versions
from folioweave.plans import model
from folioweave.sources import files
from folioweave.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_dates(spark):
    got = {t: one(spark, dates.date_candidate(F.col("t")), t=t) for t in ("on 1997/6/17", "97.6.17", "69.1.2", "2001年3月", "none", "1.2")}
    assert got == {"on 1997/6/17": "1997-06-17", "97.6.17": "1997-06-17", "69.1.2": "2069-01-02", "2001年3月": "2001-03-01", "none": None, "1.2": None}
    assert one(spark, dates.comment_date(F.col("h")), h="<!-- a --><!-- 1999-01-02 --><!-- 2000-01-01 -->") == "1999-01-02"
    assert one(spark, dates.float_year(F.lit("bad"))) == 0.0


def test_html(spark):
    assert one(spark, html.resolve(F.lit("a/b/c.html"), F.lit("../d/./e.html#x"))) == "a/d/e.html"
    assert one(spark, html.ensure_charset(F.lit("<head><meta charset=shift_jis></head>"))) == '<head><meta charset="utf-8"></head>'
    assert one(spark, html.ensure_charset(F.lit("<p>x"))) == "<p>x"


def test_text(spark):
    assert one(spark, T.script_class(F.lit("カナ"))) == "kana" and one(spark, T.script_class(F.lit("漢字"))) == "han"
    assert one(spark, T.path_hops(F.lit("a/b/c"), F.lit("a/x"))) == 3
    assert one(spark, T.dice(T.ngrams(F.lit("night")), T.ngrams(F.lit("nacht")))) == 0.25
    assert one(spark, T.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, F.array_join(T.ngrams(F.lit("a")), "|")) == "a" and one(spark, F.size(T.ngrams(F.lit(" ")))) == 0


def test_sequence_functions():
    assert texts_udf.canonical("Ａ[[P1]] ー--- b") == "Aー-b"
    assert texts_udf.period("abcde" * 4000) == 5 and texts_udf.period("abcde" * 1000) == 0 and texts_udf.period("-" * 20000) == 0
    assert texts_udf.marked_diff("abc", "axc") == "a[-b-]{+x+}c" and texts_udf.change_count("abc", "axc") == 2
    assert texts_udf.html_diff("a<b", "a<c") == "a&lt;<del>b</del><ins>c</ins>" and texts_udf.html_diff("x", "x") == ""
    assert texts_udf.sequence_ratio("A b", "ab") == 1.0 and texts_udf.longest_common("xabcy", "zabcw") == 3


def test_tolerant_json():
    assert json.loads(texts_udf.tolerant_json('```json\n{"translation": "a"}\n```')) == {"translation": "a"}
    assert json.loads(texts_udf.tolerant_json('so: {"translation": "a {b}"} ok'))["translation"] == "a {b}"
    assert json.loads(texts_udf.tolerant_json('{"translation": "a "b" c"}'))["translation"] == 'a "b" c'
    assert json.loads(texts_udf.tolerant_json('{"translation": "a\nb"}'))["repaired"] is True
    assert json.loads(texts_udf.tolerant_json('{"translation": "a\n", "x": ["y", "confidence": 1}'))["repair_methods"] == ["strings", "arrays"]
    assert texts_udf.tolerant_json("nothing") == "" and texts_udf.tolerant_json('{"other": "a\nb"}') == ""


def test_locate_tiers(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "over the lazy dog"), (3, "pack my box with five dozen jugs")], "id int, text string")
    quotes = spark.createDataFrame([(1, "quick  brown fox"), (2, "nothing here\nthe lazy dog"), (3, "pack my box with five dozen jug"), (4, ""), (5, "brown [[P0]]fox")], "id int, text string")
    got = sorted((r.q_id, r.id, r.method) for r in similarity.locate(quotes, texts).collect())
    assert got == [(1, 1, "exact"), (2, 2, "line_split"), (3, 3, "exact"), (5, 1, "strip_ph")]
    close = spark.createDataFrame([(6, "pack our box with six dozen jugs")], "id int, text string")
    assert [(r.q_id, r.id, r.method) for r in similarity.locate(close, texts).collect()] == [(6, 3, "fuzzy")]
    han = spark.createDataFrame([(1, "今日はいい天気です。")], "id int, text string")
    assert [r.method for r in similarity.locate(spark.createDataFrame([(1, "いい天気")], "id int, text string"), han).collect()] == ["exact"]
    assert [tuple(r)[:3] for r in similarity.relevance(spark.createDataFrame([("天気",)], "src string"), han).collect()] == [(1, "天気", 2)]
    both = spark.createDataFrame([(1, "quelle", "the target text"), (2, "andere", None)], "id int, text string, translation string")
    quote = spark.createDataFrame([(1, "", "target text"), (2, "andere", "")], "id int, text string, dst string")
    assert sorted((r.q_id, r.id, r.method) for r in similarity.locate(quote, both).collect()) == [(1, 1, "exact"), (2, 2, "exact")]
    assert [(r.q_id, r.id) for r in similarity.locate(quote, both, untranslated=False).collect()] == [(1, 1)]


def test_quality_and_versions(spark):
    assert one(spark, quality.restore_placeholders(F.lit("[[P0]]a[[P1]]"), F.lit("b"))) == "[[P0]]b[[P1]]"
    items = spark.createDataFrame([(1, "open", "s"), (2, "open", "s"), (3, "open", "s")], "id int, status string, suggestion string")
    verdicts = spark.createDataFrame([(1, "adopt", "t"), (2, "reject", ""), (3, "what", "")], "id int, verdict string, suggestion string")
    assert sorted(tuple(r) for r in quality.apply_verdicts(items, verdicts).collect()) == [(1, "adopted", "t", "s"), (2, "rejected", "s", None), (3, "open", "s", None)]
    state = spark.createDataFrame([("a", None)], "key string, translation string")
    cache = spark.createDataFrame([("a", "old"), ("b", "kept")], "key string, translation string")
    assert sorted(tuple(r) for r in versions.current(state, cache).collect()) == [("a", None), ("b", "kept")]
    phrases = spark.createDataFrame([("[[P0]]hi", "x"), ("a [[P1]] b", "x"), ("long" * 20, "x"), ("ok", " ")], "src string, dst string")
    assert [r.src for r in memory.learnable(phrases).collect()] == ["[[P0]]hi"]
    known = spark.createDataFrame([("Home", "Start")], "key string, dst string")
    changes = spark.createDataFrame([("go Home", "zum Start", "nach Hause")], "source string, old string, new string")
    assert memory.invalidated(known, changes).count() == 1


def test_sequences(spark):
    rows = spark.createDataFrame([(1, i, 100) for i in range(10)], "page int, line int, n int")
    got = [(r.window, r.first, r.last) for r in sequences.char_windows(rows, "page", "line", "n", 250, 1).orderBy("window").collect()]
    assert got[0] == (1, 0, 1) and got[1] == (2, 1, 2) and got[-1] == (9, 8, 9)
    chunks = sequences.chunks(spark.createDataFrame([(1, "a。b!c\nd")], "id int, text string"), 4)
    assert [r.text for r in chunks.orderBy("chunk").collect()] == ["a。b!", "c\nd"]


def test_graph_and_model(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.bfs_depth(links, roots).collect()} == {"a": 0, "b": 1, "c": 2}
    assert json.loads(one(spark, model.mock(F.lit("Terms\n\n|TEXT|hello"))))["translation"] == "hello"
    assert one(spark, model.answer(F.lit("plain")).confidence) == 0.1


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes("<title>日本</title>".encode("cp932"))
    (tmp_path / "sub/b.png").write_bytes(b"\x89")
    site = files.site(spark, str(tmp_path))
    assert {r.rel: r.is_page for r in site.collect()} == {"a.html": True, "sub/b.png": False}
    page = site.where("is_page").select(files.decode(F.col("content"), files.candidates(F.lit(None).cast("string"), F.lit("ja"))).alias("d")).first().d
    assert page.encoding == "cp932" and page.text == "<title>日本</title>"
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "rows.jsonl"), "a int").where("a is not null").collect()) == [1, 2]
    assert one(spark, files.reference_text(F.lit("﻿a\r\n\r\n\r\n\r\nb "))) == "a\n\nb"


def test_streams(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.stream_parquet(spark, str(tmp_path / "in"), table.schema, 1)
    events.latest_state(stream, "user_id", "event_id", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]) <= 2
    want = {r.user_id: r.m for r in spark.read.parquet(str(tmp_path / "in")).groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.user_id: r.event_id for r in events.read_state(spark, str(tmp_path / "state")).collect()} == want
    counts = events.windowed_counts(events.stream_parquet(spark, str(tmp_path / "in"), table.schema), "1 hour", "365 days")
    counts.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == table.count()
    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.txt").write_text(" note ")
    (tmp_path / "box/b.txt").write_text("")
    events.inbox(spark, str(tmp_path / "box")).writeStream.format("memory").queryName("box").trigger(availableNow=True).start().awaitTermination()
    assert [r.text for r in spark.table("box").collect()] == ["note"]


def test_repetition_guard(spark, tmp_path):
    rows = [(1, i, "abcde" * 20) for i in range(6)] + [(2, i, f"text {i} that differs {i * 7919} each time " * 2) for i in range(6)]
    spark.createDataFrame(rows, "call bigint, seq int, chunk string").coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = events.stream_parquet(spark, str(tmp_path / "c"), "call bigint, seq int, chunk string")
    events.repetition_guard(stream).writeStream.format("memory").queryName("guard").trigger(availableNow=True).start().awaitTermination()
    assert {r.call: r.period for r in spark.table("guard").collect()}[1] == 5
