"""Pages, references, loops, files and the queries without SQL, by hand-made cases and brute force."""

import difflib
import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioweave import __main__ as command
from folioweave.functions import page, references, texts_udf
from folioweave.operators import containment, graph, linkage, mining, pages, review, sequences, site, stats
from folioweave.plans import catalogue, loop
from folioweave.sources import files

DIR = "/root/testdata/sf0.001"
HTML = '<html><head><title>T &amp; x</title></head><body><p>Hello <b>bold</b> world&nbsp;</p>\n<pre>a\nb\n\nc d</pre><!-- c --><img alt="日本" title="plain"><script>x</script>end <i>of</i> it</body></html>'


def table(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


def test_segments_of_a_page():
    found = page.segments(HTML)
    assert [(s["id"], s["kind"], s["text"]) for s in found] == [(1, "head_title", "T &amp; x"), (2, "text", "Hello[[P0]]bold[[P1]]world"), (3, "text", "a[[P2]]b"), (4, "text", "c d"), (5, "text", "end[[P3]]of[[P4]]it"), (6, "attr_alt", "日本")]
    assert found[1]["placeholders"] == [{"token": "[[P0]]", "raw": " <b>"}, {"token": "[[P1]]", "raw": "</b> "}]
    assert all(HTML[s["start"] : s["end"]] == s["source_text"] for s in found if s["kind"] != "head_title")
    told = [dict(s, translation={2: " Hallo[[P0]]fett[[P1]]Welt　", 6: "x"}.get(s["id"])) for s in found]
    assert page.reassemble(HTML, told) == HTML.replace("Hello <b>bold</b> world", "Hallo <b>fett</b> Welt").replace("日本", "x")
    assert page.segments(None) == [] and page.segments("<p> &nbsp; </p>") == []


def test_segments_put_every_page_together_again():
    for row in table("pages"):
        found = page.segments(row["html"])
        texts = [s for s in found if s["kind"] == "text"]
        assert all(row["html"][s["start"] : s["end"]] == s["source_text"] == s["source_text"].strip() for s in texts)
        assert page.reassemble(row["html"], [dict(s, translation=s["text"]) for s in texts]) == row["html"]
        assert [s["id"] for s in found] == list(range(1, len(found) + 1))


def test_reassembled_in_catalyst_is_the_same(spark):
    source = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>日本🙂 x</p>")], "page_id long, html string")
    found = pages.segmented(source).withColumn("translation", F.when(F.col("kind") == "text", F.concat(F.lit("«"), "text", F.lit("» "))))
    got = {r.page_id: r.html for r in pages.reassembled(source, found).collect()}
    want = lambda h: page.reassemble(h, [dict(s, translation=f"«{s['text']}»" if s["kind"] == "text" else None) for s in page.segments(h)])
    assert got == {1: want(HTML), 2: None, 3: want("<p>日本🙂 x</p>")}


def test_quotes_and_annotations():
    assert page.quote_end(HTML, 0, len(HTML), "bold</b> wor") == HTML.index("bold</b> wor") + 12
    assert page.quote_end("<p>a b<b>C d</b></p>", 0, 20, "abc") == 10 and page.quote_end("abc", 0, 3, "x") == -1 and page.quote_end("abc", 0, 3, "") == -1
    made = page.annotate("<HEAD></HEAD><body>ab cd</BODY>", [(21, "x"), (24, "y"), (21, "z"), (-1, "lost")], "s{}", "go()")
    assert '<style>s{}</style></HEAD><body>ab<sup class="note">[1,2]</sup> cd<sup class="note">[3]</sup><script' in made and made.endswith("<script>go()</script></BODY>")
    assert page.annotate("ab", [(1, "n")]).startswith('a<sup class="note">[1]</sup>b<script') and page.annotate("ab", []) == "ab"


def test_references():
    assert references.canonical("（Ａ……B）—— [[P1]]x＝＝=") == "(A...B)-x=" and references.blank_like("  ") and references.blank_like("＝＝＝=") and not references.blank_like("a")
    assert references.locate("今日はいい天気です。明日も晴れ。", "いい天気で") == ("いい天気で", 1.0) and references.locate("abc", "") == ("", 0.0)
    fragment, score = references.locate("前の文。今日はとても良い天気でした。次の文。", "今日はとても悪い天気でした")
    assert fragment == "今日はとても良い天気でした。" and 0.8 < score < 1
    found = references.check("今日はとても良い天気でした。", "今日はとても悪い天気でした。", "abcdef")
    assert found["diff"] == "今日はとても[-良-][+悪+]い天気でした。" and found["covered"] and found["corrections_applied"] == 0
    fix = [{"ref_err": "良い", "corrected": "悪い", "status": "active"}]
    assert references.check("今日はとても良い天気でした。", "今日はとても悪い天気でした。", "abcdef", fix) is None
    assert references.check("今日は", "違う", "abc") is None and references.check(None, "x", "abcdef") is None and references.check("x", " ", "abcdef") is None
    assert references.uncovered_tail("第一行文字内容\n第二行\n------\n彩蛋在这里\n\n", ["第一行文字内容"]) == "第二行\n------\n彩蛋在这里"
    assert references.uncovered_tail("全部都在这里", ["全部都在这里"]) == "" and references.uncovered_tail("", []) == ""


def test_residuals():
    assert references.depths("a\"b\"(c)「d") == [0, 1, 1, 0, 1, 1, 1, 1, 1]
    find = lambda s, t: [(r["token"], r["start"]) for r in references.residual(s, t)]
    assert find("これはペン", "这是これは。") == [("これは", 2)] and find("これは", "「これは」") == [] and find("これは", "これは題（注）") == [] and find("あれ", "これは") == []
    assert find("これは", "これは。（注）") == [("これは", 0)] and find(None, "これは") == [] and find("これは", "これは[[P1]]（注）") == [("これは", 0)]


def test_containment_without_blanks_and_in_blocks(spark):
    terms = ["天気", "いい天気", "aa", "work", "art work", "", None]
    texts = [(1, "今日はいい天気です。天気"), (2, "aaaaa smart work"), (3, ""), (4, None)]
    df = spark.createDataFrame([(t,) for t in terms], "src string"), spark.createDataFrame(texts, "id int, text string")
    want = sorted((i, t, x.count(t), x.index(t) + 1) for i, x in texts if x for t in terms if t and t in x)
    for size in (1, 8, 1 << 20):
        assert sorted(tuple(r)[:4] for r in containment.occurrences(*df, block_bytes=size).collect()) == want
    assert containment.occurrences(df[0].where("false"), df[1]).count() == 0
    assert {r.around for r in containment.occurrences(spark.createDataFrame([("work",)], "src string"), df[1], pad=3).collect()} == {"rt work"}


def test_retries_have_budgets_of_their_own():
    waits, seen = [], []

    def model(errors):
        left = list(errors)

        def call(prompt, temperature, tokens):
            seen.append((round(temperature, 2), tokens))
            step = left.pop(0) if left else loop.Reply("ok")
            if isinstance(step, Exception):
                raise step
            return step

        return call

    n, p, w, e = loop.NetworkError(), loop.Loop(), loop.WallTime(), loop.Reply(" ")
    assert loop.called(model([n, p, n, w, e, n, p]), "x", loop.Settings(), waits.append).text == "ok"
    assert waits == [1.0, 2.0, 4.0] and seen[-1][0] == 0.5
    for errors, kind in (([n] * 4, loop.NetworkError), ([p] * 3, loop.Loop), ([w] * 2, loop.WallTime), ([e] * 2, ValueError)):
        with pytest.raises(kind):
            loop.called(model(errors), "x", loop.Settings(), waits.append)
    seen.clear()
    cut = loop.Reply("", finish="length")
    assert loop.called(model([cut]), "x", loop.Settings(max_tokens=100, ceiling=150), waits.append).text == "ok" and [t for _, t in seen] == [100, 150]


def test_settings_streams_and_repair():
    s = loop.Settings(walls={"qa": 9.0}).with_own({"model": "m", "key": "", "temperature": None})
    assert (s.model, s.key, s.temperature, s.wall_for("qa_p1"), s.wall_for("x")) == ("m", "", 0.3, 9.0, 300.0)
    assert loop.streamed(["ab", "c"], 5, iter([0, 1, 2]).__next__) == "abc"
    with pytest.raises(loop.WallTime):
        loop.streamed(["ab", "c"], 5, iter([0, 1, 9]).__next__)
    with pytest.raises(loop.Loop):
        loop.streamed(["again and "] * 5000, 1e9)
    replies = iter(["no", "still no", '{"translation": "a"}'])
    prompts = []
    assert loop.asked(lambda p, t, n: (prompts.append(p), loop.Reply(next(replies)))[1], "q", loop.Settings()) == {"translation": "a"} and "still no" in prompts[2]
    assert loop.asked(lambda p, t, n: loop.Reply("|TEXT|plain"), "q", loop.Settings()) == {"translation": "plain", "confidence": 0.1}
    assert json.loads(loop.echo("a |TEXT| b |DST|c", 0, 0).text)["translation"] == "c"
    assert loop.algorithms() == ["runs", "repeat_lines"] and loop.algorithms("all") == list(loop.ALGORITHMS) and loop.algorithms("pmi") == ["pmi"]
    with pytest.raises(ValueError):
        loop.algorithms("what")


def test_calls_are_limited_and_resumed(spark, tmp_path):
    import time

    prompts = spark.createDataFrame([(i, "t", "|TEXT|x") for i in range(4)], "id int, tag string, prompt string").coalesce(1)
    began = time.time()
    assert loop.chat(prompts, loop.echo, loop.Settings(), rate=120).count() == 4 and time.time() - began > 1.4
    todo, path = spark.range(10).withColumnRenamed("id", "page"), f"{tmp_path}/done"
    assert loop.resumed(todo, path, lambda df: df.withColumn("x", F.lit(1)), size=4) == 3 and loop.resumed(todo, path, lambda df: df, size=4) == 0
    assert spark.read.parquet(path).count() == 10
    terms = loop.page_terms(spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), lambda p, t, n: loop.Reply('{"terms": [{"src": "X", "dst": "' + p[-1] + '", "category": "c", "confidence": 0.5}]}'), loop.Settings()).collect()
    assert [(r.src, r.dst) for r in terms] == [("X", "a")]
    bad = loop.reviewed_terms(spark.createDataFrame([("a",), ("b",)], "src string"), spark.createDataFrame([("k", True)], "src string, keep boolean"), lambda names: 1 / 0)
    assert [r.src for r in bad.collect()] == ["k"]


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = files.write_page_files(spark.createDataFrame([("a/b.html", "é"), ("c.html", None)], "rel string, html string"), f"{root}/out").collect()
    assert sorted((r.rel, r["size"]) for r in made) == [("a/b.html", 2), ("c.html", 0)] and (tmp_path / "out/a/b.html").read_text() == "é"
    assert files.copy_files(spark.createDataFrame([("a/b.html",)], "rel string"), f"{root}/out", f"{root}/two").count() == 1 and (tmp_path / "two/a/b.html").read_text() == "é"
    name = files.backup(spark, f"{root}/out", "2020", "x")
    assert name.endswith("out.2020.x.bak") and (tmp_path / "out.2020.x.bak/a/b.html").exists() and files.backup(spark, f"{root}/none", "1") == ""
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    files.write_json_lines(rows, f"{root}/log")
    files.write_json_lines(rows, f"{root}/log", append=True)
    assert files.json_lines(spark, f"{root}/log", "a int, b string").count() == 4
    (tmp_path / "doc.json").write_text('{\n"a": 1\n}')
    assert files.json_document(spark, f"{root}/doc.json", "a int").first().a == 1
    caches = spark.createDataFrame([('{"encoding": "x", "segments": [{"id": 1, "text": "t"}]}',), ('[{"id": 2}]',), ("broken",)], "raw string")
    assert [[s.id for s in r.s or []] for r in caches.select(files.segment_cache(F.col("raw")).alias("s")).collect()] == [[1], [2], []]
    raw = spark.createDataFrame([(bytearray("日本".encode("euc_jp")), "euc_jp"), (bytearray(b"\x81"), None)], "c binary, k string")
    tried = files.candidates(F.lit(None).cast("string"), F.lit("ja"))
    assert [r.d.text for r in raw.select(files.decode_again(F.col("c"), F.col("k"), tried).alias("d")).collect()] == ["日本", None]
    assert raw.where("k is null").select(files.decode(F.col("c"), tried, strict=False).alias("d")).first().d.text == "�"


def test_clusters_by_brute_force(spark):
    rows = [(r["event_id"], r["event_id"] + 1 + r["user_id"] % 3) for r in table("events") if r["event_type"] in ("click", "view")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, c in rows:
        x, y = sorted((root(a), root(c)))
        up[y] = x
    assert {r.node: r.cluster for r in catalogue.queries()["clusters"](spark, DIR).collect()} == {x: root(x) for x in list(up)}


def test_depth_first_by_recursion(spark):
    links = [("s", f"n{i}", k, f"n{(i * 7 + k * 3) % 40}") for i in range(30) for k in range(3)] + [("t", "a", 1, "b")]
    got = linkage.depth_first(spark.createDataFrame(links, "site string, src string, pos int, dst string")).collect()
    for name in "st":
        after = {}
        for s, src, pos, dst in sorted(links):
            if s == name:
                after.setdefault(src, []).append((pos, dst))
        seen = []

        def visit(node, after=after, seen=seen):
            if node not in seen:
                seen.append(node)
                for _, dst in after.get(node, []):
                    visit(dst)

        for start in sorted(after):
            visit(start)
        assert [r.node for r in sorted((r for r in got if r.site == name), key=lambda r: r.place)] == seen


def test_windows_and_chunks_by_brute_force(spark):
    import re

    rows = {}
    for r in table("documents"):
        for i, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            rows.setdefault(r["doc_id"], []).append((i, len(line)))
    want = []
    for doc, found in rows.items():
        i, n = 0, 0
        while i < len(found):
            j, total = i, 0
            while j < len(found) and (j == i or total + found[j][1] <= 500):
                total, j = total + found[j][1], j + 1
            n += 1
            want.append((doc, n, found[i][0], found[j - 1][0]))
            if j == len(found):
                break
            i = max(i + 1, j - 1)
    assert sorted(tuple(r) for r in catalogue.queries()["char_windows"](spark, DIR).collect()) == sorted(want)
    for r in catalogue.queries()["chunks"](spark, DIR).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "n"))).alias("c")).collect():
        text = next(x["text"] for x in table("documents") if x["doc_id"] == r.id)
        units, sizes, held = re.findall(r"[^\n。！？!?]*[\n。！？!?]|[^\n。！？!?]+$", text), [], ""
        for u in units:
            if held and len(held) + len(u) > 600:
                sizes.append(len(held))
                held = ""
            held += u
        sizes += [len(held)] if held else []
        assert [c.n for c in r.c] == sizes
    cut = sequences.adjacent(spark.createDataFrame([(1, i, t) for i, t in enumerate(["abc", "", None, "defg", "hi"])], "k int, n int, t string"), "k", "n", "t", 5).orderBy("n").collect()
    assert [(r.before, r.after) for r in cut] == [("", "defg\nh"), ("abc", "defg\nh"), ("abc", "defg\nh"), ("abc", "hi"), ("c\ndefg", "")]


def test_ratios_by_difflib(spark):
    bare = lambda x: "".join((x or "").split()).lower()
    turns = {}
    for r in table("conversations"):
        turns.setdefault(r["conv_id"], {})[r["turn"]] = r
    want = {}
    for conv, by in turns.items():
        two = [(a, b) for a in by for b in by if a < b < 4]
        if two:
            want[conv] = np.mean([round(difflib.SequenceMatcher(None, bare(by[a]["text"]), bare(by[b]["text"]), autojunk=False).ratio(), 6) for a, b in two])
    assert {r.conv_id: pytest.approx(r["mean"], abs=1e-5) for r in catalogue.queries()["self_similarity"](spark, DIR).collect()} == want
    got = {r.id: (r.ratio, r.common, r.changes) for r in catalogue.queries()["sequence_ratio"](spark, DIR).collect()}
    for conv, by in turns.items():
        for turn, r in by.items():
            if r["role"] == "user" and turn + 1 in by and by[turn + 1]["role"] == "assistant":
                a, b = r["text"] or "", by[turn + 1]["text"] or ""
                assert got[conv * 1000 + turn] == (texts_udf.sequence_ratio(a, b), difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size, texts_udf.change_count(a, b))


def test_byte_pairs_by_brute_force(spark):
    import re
    from collections import Counter

    from test_whole import byte_pairs

    words = Counter(w for r in table("documents") for w in re.findall("[a-z]+", r["text"] or ""))
    assert {r.token: r["count"] for r in mining.byte_pairs(spark.read.parquet(f"{DIR}/documents.parquet"), 8).collect()} == byte_pairs(words, 8, 4)


def test_permuted_statistic(spark):
    rows = [(g, float(v)) for g, n in (("a", 9), ("b", 12)) for v in range(n)] + [("b", 30.5), ("b", 31.5)]
    got = stats.permuted_kruskal(spark.createDataFrame(rows, "g string, v double"), "g", "v", 50).first()
    values = np.array([v for _, v in rows])
    ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    pairs = sorted(zip([g for g, _ in rows], ranks, strict=True))
    of, ranks = np.array([g == "b" for g, _ in pairs]).astype(int), np.array([r for _, r in pairs])
    h = lambda of: 12 / (len(of) * (len(of) + 1)) * sum(ranks[of == k].sum() ** 2 / (of == k).sum() for k in (0, 1)) - 3 * (len(of) + 1)
    hits = sum(h(np.random.default_rng(42 + i).permutation(of)) >= h(of) for i in range(50))
    assert got.h == pytest.approx(h(of)) and got.p == pytest.approx((hits + 1) / 51)
    assert stats.permuted_kruskal(spark.createDataFrame([], "g string, v double"), "g", "v", 5).count() == 0


def test_site_plan_by_hand(spark):
    names = ["index.html", "a/index.html", "a/p1.html", "a/p2.html", "a/lost.html", "b/only.html"]
    rows = spark.createDataFrame([(p, n, 0 if n else None, n * 10, p.count("/"), None, None, 0) for n, p in enumerate(names)], "page string, in_degree long, volume long, text_len long, depth int, date long, nav int, dfs int")
    links = spark.createDataFrame([("index.html", 1, "a/index.html"), ("index.html", 2, "b/only.html"), ("a/index.html", 1, "a/p2.html"), ("a/index.html", 2, "a/p1.html")], "src string, pos int, dst string")
    assert sorted((r.dir, r.page) for r in site.members(rows, links).collect()) == sorted([("", "index.html"), ("", "a/index.html"), ("", "b/only.html"), ("a", "a/index.html"), ("a", "a/p1.html"), ("a", "a/p2.html"), ("a", "a/lost.html"), ("b", "b/only.html")])
    found = site.indexes(rows, links)
    assert sorted((r.dir, r["index"], round(r.coverage, 3)) for r in found.collect()) == [("", "index.html", 1.0), ("a", "a/index.html", 0.667)]
    got = {r.page: r for r in site.scores(rows, links).collect()}
    own = {"index.html": 0, "a/index.html": 1000, "a/p2.html": 1001, "a/p1.html": 1002, "a/lost.html": 1003, "b/only.html": 2000}
    assert {p: round(r.semantic, 6) for p, r in got.items()} == {p: round(1 - v / 2000, 6) for p, v in own.items()}
    assert {p for p, r in got.items() if r.is_index} == {"index.html", "a/index.html"} and {p for p, r in got.items() if r.is_orphan} == {"a/lost.html"} and not got["b/only.html"].has_semantic
    plan = site.plan(site.scores(rows, links)).orderBy("rank").collect()
    assert [r.total for r in plan] == sorted((r.total for r in plan), reverse=True) and [r["rank"] for r in plan] == [1, 2, 3, 4, 5, 6]
    first = next(r for r in plan if r.page == "a/lost.html")
    assert "orphan" in first.reason and "ordered" in first.reason and first.reason.startswith(f"total {first.total:.3f}")
    kept = site.plan(site.scores(rows, links), kept=spark.createDataFrame([("b/only.html", 1)], "page string, rank int")).orderBy("rank").first()
    assert kept.page == "b/only.html"


def test_numbered_and_levels(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5003 as v", "id").repartition(7)
    got = [r.n for r in graph.numbered(rows, [F.desc("v"), F.col("id")], "n").orderBy(F.desc("v"), "id").collect()]
    assert got == list(range(1, 5001))
    chain = spark.createDataFrame([("n0", None, 1)] + [(f"n{i}", f"n{i - 1}", 1001) for i in range(1, 9)], "node string, parent string, rank int")
    assert max(len(r.path) for r in linkage.composite_ranks(chain).collect()) == 9
    with pytest.raises(RuntimeError):
        linkage.composite_ranks(chain, levels=3)


def test_verdicts_and_terms(spark):
    assert review.read_verdict('{"verdict": "ADOPT ", "index": "3"}') == {"verdict": "adopt", "reason": "", "suggestion": "", "index": 3}
    assert review.read_verdict(None)["verdict"] == "skip" and review.read_verdict('{"verdict": "reject", "suggestion": "a "b" c"}')["suggestion"] == 'a "b" c'
    one = lambda s, *rows: spark.createDataFrame(list(rows), s)
    out = review.add_term("Rat", "council", one("src string, dst string, status string", ("Rat", "advice", "auto"), ("x", "y", "auto")), one("key string, dst string", ("Rat", "a"), ("b", "c")), one("src string, dst string", ("der Rat", "the council"), ("Rat", "advice"), ("z", "bad word")), one("quote string, summary string", ("Rat", "council"), ("Rat", "no"), ("q", "bad")), ["bad"])
    assert sorted(map(tuple, out["glossary"].collect())) == [("Rat", "council", "confirmed"), ("x", "y", "auto")] and [r.key for r in out["phrases"].collect()] == ["b"]
    assert [r.src for r in out["memory"].collect()] == ["der Rat"] and [r.summary for r in out["notes"].collect()] == ["council"]


def test_command_line(capsys, spark, tmp_path):
    assert command.main(["list"]) == 0 and "page_plan" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        command.main(["show", "none", DIR])
