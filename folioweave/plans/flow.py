"""Named queries over pages, references, queues, histories, site plans and model loops, with their SQL.

Where an operator's SQL would be the operator again, the rows are made so that its answer is known by construction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import references
from ..functions import text as T
from ..functions import texts_udf
from ..operators import mining, pages, quality, review, similarity, site, stats
from ..sources import files
from . import loop
from .catalogue import PAIRS, WS, b, pairs, query, read

# ---- pages and references ------------------------------------------------------------------------------------------


@query()
def q_page_segments(spark, d):
    return pages.segmented(read(spark, d, "pages").select("page_id", "html")).select("page_id", "id", "kind", "start", "end", F.md5("text").alias("digest"), F.size("placeholders").alias("placeholders"))


def _segments(spark, d):
    return pages.segmented(read(spark, d, "pages").select("page_id", "html"))


@query("select page_id, md5(html) as digest from pages")
def q_reassemble_pages(spark, d):
    # Every segment is translated by itself, blanks around it; placeholders go in and out again.
    found = _segments(spark, d).where("kind = 'text'").withColumn("translation", F.concat(F.lit(" "), "text", F.lit("　")))
    return pages.reassembled(read(spark, d, "pages").select("page_id", "html"), found).select("page_id", F.md5("html").alias("digest"))


@query("select page_id, md5(html) as digest from pages where page_id % 2 = 0 and page_id % 3 <> 0")
def q_rebuild_outputs(spark, d):
    all_pages = read(spark, d, "pages").select("page_id", "html")
    found = _segments(spark, d).where("kind = 'text'").withColumn("translation", F.when(F.col("id") % 2 == 0, F.col("text")))
    return pages.rebuilt(all_pages.where("page_id % 2 = 0"), all_pages.where("page_id % 3 = 0"), all_pages, found).select("page_id", F.md5("html").alias("digest"))


@query("select page_id, case when page_id % 3 = 0 then 0 else 1 end + case when page_id % 5 = 0 then 1 else 0 end as found, case when page_id % 3 = 0 then 1 else 0 end as missed from pages where page_id % 3 > 0 or page_id % 3 = 0 or page_id % 5 = 0")
def q_page_annotations(spark, d):
    rows = read(spark, d, "pages").select("page_id", "html")
    quote = F.when(F.col("page_id") % 3 == 0, F.lit("∅ nowhere ∅")).otherwise(F.substring("html", 200, 12))
    notes = rows.select("page_id", quote.alias("quote"), F.lit("a note").alias("text"))
    fixes = rows.where("page_id % 5 = 0").select("page_id", F.lit("wrong").alias("ref_err"), F.substring("html", 150, 30).alias("corrected"), F.lit("active").alias("status"))
    return pages.annotated(rows, notes, fixes).select("page_id", b("found"), b("missed"))


_REL = "'d/p' || page_id || '.html'"


@query(f"select {_REL} as page, case page_id % 5 when 0 then 'a/d/p' || page_id || '.html' when 1 then 'b/d/p' || page_id || '.txt' when 2 then 'a/d__p' || page_id || '.txt' when 4 then 'b/d__p' || page_id || '.html' end as text from pages where page_id % 5 <> 3")
def q_reference_texts(spark, d):
    ids = read(spark, d, "pages").select("page_id")
    name = lambda head, tail: F.concat(F.lit(head), "page_id", F.lit(tail))
    part = F.col("page_id") % 5
    paths = F.when(part == 0, F.array(name("a/d/p", ".html"))).when(part == 1, F.array(name("b/d/p", ".txt"))).when(part == 2, F.array(name("b/d/p", ".html"), name("a/d__p", ".txt"))).when(part == 4, F.array(name("b/d__p", ".html"))).otherwise(F.array(name("c/d/p", ".html")))
    listing = ids.select(F.explode(paths).alias("path")).withColumn("text", F.concat(F.lit("﻿ \r\n"), "path", F.lit("\r\n\r\n")))
    return pages.reference_texts(ids.select(name("d/p", ".html").alias("page")), listing, ["a", "b"])


@query(f"""with p as (select {_REL} as page, case when page_id % 2 = 0 then strftime(date '1990-01-01' + cast(page_id % 3000 as integer), '%Y-%m-%d') end as date, page_id from pages), d as (select date, min(page) as page from p where date is not null group by date)
select f.file, coalesce(case when kind = 0 then 'd/p' || id || '.html' end, d.page) as page, case when kind = 0 then 'name' when d.page is not null then 'date' else 'unmapped' end as how from (
  select page_id as id, page_id % 3 as kind, case page_id % 3 when 0 then 'arc/p' || page_id || '.txt' when 1 then 'arc/photo' || strftime(date '1990-01-01' + cast(page_id % 3000 as integer), '%y%m%d') || '.txt' else 'arc/other' || page_id || '.txt' end as file, case when page_id % 3 = 1 then strftime(date '1990-01-01' + cast(page_id % 3000 as integer), '%Y-%m-%d') end as date from pages) f left join d on f.date = d.date""")
def q_reference_import(spark, d):
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("page_id") % 3000).cast("int"))
    rows = read(spark, d, "pages").select("page_id", day.alias("day"))
    kind = F.col("page_id") % 3
    name = F.when(kind == 0, F.concat(F.lit("arc/p"), "page_id", F.lit(".txt"))).when(kind == 1, F.concat(F.lit("arc/photo"), F.date_format("day", "yyMMdd"), F.lit(".txt"))).otherwise(F.concat(F.lit("arc/other"), "page_id", F.lit(".txt")))
    known = rows.select(F.concat(F.lit("d/p"), "page_id", F.lit(".html")).alias("page"), F.when(F.col("page_id") % 2 == 0, F.date_format("day", "yyyy-MM-dd")).alias("date"))
    return pages.import_references(rows.select(name.alias("file")), known)


@query("select conv_id, turn, case turn % 4 when 0 then '译文' || conv_id || chr(10) || '行' when 1 then '译文 with kana か' else '' end as kept from conversations")
def q_draft_lines(spark, d):
    part = F.col("turn") % 4
    body = F.when(part == 0, F.concat(F.lit("● 头\n  译文"), "conv_id", F.lit("\r\n-=—\n\nlatin only\n行"))).when(part == 1, F.lit("译文 with kana か\nかなだけ\nか漢")).when(part == 2, F.lit("12 34\n___"))
    return read(spark, d, "conversations").select("conv_id", "turn", pages.draft_lines(F.coalesce(body, F.lit(""))).alias("kept"))


def _said(spark, d):
    """page, id, kind, start, text, translation: a turn's text, each third one reversed, each third one with a word too many."""
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.reverse("text")).otherwise(F.concat("text", F.lit(" right")))
    return read(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("id"), F.when(F.col("turn") == 9, "head_title").otherwise("text").alias("kind"), F.col("turn").alias("start"), "text", said.alias("translation"))


@query(f"select conv_id as page, turn as id from conversations where turn % 3 = 1 and turn <> 9 and length(regexp_replace(text, '{WS}+', '', 'g')) >= 10")
def q_reference_check(spark, d):
    # A page's reference is all its texts and the words that corrections took out; reversed texts alone differ from it.
    rows = _said(spark, d)
    refs = rows.groupBy("page").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat("text", F.when(F.col("id") % 3 == 2, F.lit(" wrong")).otherwise(""))))).alias("text"))
    fixes = rows.where("id % 3 = 2").select("page", "id", F.lit(" wrong").alias("ref_err"), F.lit(" right").alias("corrected"), F.lit("active").alias("status"))
    return pages.checked(rows.where("length(regexp_replace(text, '\\\\s', '')) >= 10"), refs, fixes).select("page", "id")


@query("select conv_id as page, '------' || chr(10) || 'ＴＡＩＬ※' || conv_id || chr(10) || '◎end' as tail from conversations group by conv_id")
def q_reference_tails(spark, d):
    rows = _said(spark, d).withColumn("kind", F.lit("text")).withColumn("translation", F.col("text"))
    refs = rows.groupBy("page").agg(F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("text"))
    return pages.tails(rows, refs.select("page", F.concat("text", F.lit("\n------\nＴＡＩＬ※"), "page", F.lit("\n◎end")).alias("text")))


@query("select conv_id as page, turn as id, md5(text || case when turn = max(case when turn % 4 < 3 then turn end) over (partition by conv_id) and conv_id % 2 = 0 then chr(10) || 'tail' || conv_id else '' end) as digest from conversations where turn % 4 < 3")
def q_tails_kept(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("id"), F.lit("text").alias("kind"), F.col("turn").alias("start"), F.when(F.col("turn") % 4 < 3, F.col("text")).alias("translation"))
    tails = rows.where("page % 2 = 0").select("page", F.concat(F.lit("tail"), "page").alias("tail")).distinct()
    return pages.with_tail(rows, tails).where("translation is not null").select("page", "id", F.md5("translation").alias("digest"))


@query("with m as (select user_id as page, max(event_id) as marked from events where event_type = 'error' group by user_id) select event_id as at, case when marked >= event_id then 'superseded' else 'active' end as status from events left join m on page = user_id where event_id % 4 > 0")
def q_corrections_current(spark, d):
    ev = read(spark, d, "events").withColumns({"page": F.col("user_id"), "id": F.lit(1), "at": F.col("event_id")})
    records = ev.select("page", "id", "at", F.when(F.col("event_id") % 4 > 0, F.lit("wrong")).otherwise(" ").alias("ref_err"), F.lit("right").alias("corrected"))
    return pages.current_corrections(records, ev.where("event_type = 'error'").select("page", "id", "at")).select("at", "status")


_KANA = "(select id, page, case id % 5 when 0 then 'そのまま' when 4 then 'そのまま' end as token from " + PAIRS + ")"


def _kana(spark, d):
    """Pairs with hiragana in the translation: bare, in brackets, before a note, not in the source, and behind a closed bracket."""
    part = F.col("id") % 5
    tail = F.when(part == 0, "。そのまま！").when(part == 1, "（そのまま）").when(part == 2, "。そのまま題（注）").when(part == 3, "。よそもの").otherwise("「引用」そのまま")
    return pairs(spark, d).select("id", "page", F.concat("src", F.lit("そのまま")).alias("src"), F.concat(F.regexp_replace("dst", "[\"'()]", ""), tail).alias("dst"))


@query(f"select id, token from {_KANA} where token is not null")
def q_residual_script(spark, d):
    return pages.residuals(_kana(spark, d)).select("id", "token")


@query(f"select page, string_agg(id::varchar, ' ' order by length(id::varchar), id::varchar) as segments, count(*) as tokens, 'reset ' || page || ' --segments ' || string_agg(id::varchar, ' ' order by length(id::varchar), id::varchar) as reset from {_KANA} where token is not null group by page")
def q_residual_report(spark, d):
    return pages.residual_report(pages.residuals(_kana(spark, d)))


# ---- queues and verdicts -------------------------------------------------------------------------------------------

ITEMS = """(select 'q' || doc_id as id, source as page, ['open', 'adopted', 'rejected', 'applied'][doc_id % 4 + 1] as status, case when toxic = 1 then 'high' when quality = 0 then 'mid' else 'low' end as severity, lang as reason, doc_id % 5 > 0 as resolved, doc_id,
  case when doc_id % 7 > 0 then [doc_id % 3, doc_id % 5 + 10] else [] end as segments from labels join documents using (doc_id))"""


def _items(spark, d):
    both = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    status = F.element_at(F.array(*map(F.lit, ("open", "adopted", "rejected", "applied"))), (F.col("doc_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "mid").otherwise("low")
    segments = F.when(F.col("doc_id") % 7 > 0, F.array(F.col("doc_id") % 3, F.col("doc_id") % 5 + 10)).otherwise(F.array().cast("array<bigint>"))
    return both.select(F.concat(F.lit("q"), "doc_id").alias("id"), F.col("source").alias("page"), status.alias("status"), severity.alias("severity"), F.col("lang").alias("reason"), (F.col("doc_id") % 5 > 0).alias("resolved"), "doc_id", segments.alias("segments"))


@query(f"select count(*) as total, count(*) filter (status = 'open') as open, count(*) filter (status = 'adopted') as adopted, count(*) filter (status = 'open' and severity = 'high') as open_high, count(*) filter (status = 'open' and severity = 'mid') as open_mid, count(*) filter (status = 'open' and severity = 'low') as open_low from {ITEMS}")
def q_queue_stats(spark, d):
    return review.queue_stats(_items(spark, d))


@query(f"select reason, count(*) as open from {ITEMS} where status = 'open' group by reason")
def q_review_stats(spark, d):
    return review.review_stats(_items(spark, d))


@query(f"select id, status from {ITEMS} where status <> 'rejected'")
def q_queue_removal(spark, d):
    return review.remove(_items(spark, d), "rejected").select("id", "status")


@query(f"select count(*) filter (page = 'web') as deleted, count(*) filter (page is distinct from 'web') as kept from {ITEMS}")
def q_removal_counts(spark, d):
    return review.removal_counts(_items(spark, d), "all", "web")


@query(f"select id from {ITEMS} where doc_id % 3 < 2")
def q_id_whitelist(spark, d):
    # Each row's list names its own item: as a text, as an object, or not at all.
    rows = _items(spark, d)
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["x", "'), "id", F.lit('"]'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('[{"id": "'), "id", F.lit('"}]'))).otherwise(F.lit("[]"))
    listed = rows.select(F.explode(review.listed_ids(raw)).alias("id"))
    return rows.join(listed, "id", "left_semi").select("id")


@query(f"select id from {ITEMS} where status = 'open' and coalesce(resolved, true) and len(segments) > 0")
def q_adjudicable(spark, d):
    return review.adjudicable(_items(spark, d)).select("id")


@query("select doc_id as page, doc_id * 7 % 1000 as rank from documents where doc_id % 3 > 0 order by doc_id * 7 % 1000, doc_id limit 20")
def q_next_pending(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("page"))
    plan = docs.select("page", F.struct((F.col("page") * 7 % 1000).alias("r"), "page").alias("rank"))
    status = docs.where("page % 3 < 2").select("page", F.when(F.col("page") % 3 == 0, "done").otherwise("pending").alias("status"))
    return review.next_pending(plan, status, 20).select("page", F.col("rank.r").alias("rank"))


@query(f"""with c as (select source as page, arg_max(n_chars % 9, doc_id) as issues from documents where doc_id % 2 = 0 and source is not null group by source), o as (select page, count(*) as open from {ITEMS} where status = 'open' group by page), p as (select distinct source as page from documents where source is not null)
select page, issues is not null as checked, cast(coalesce(issues, 0) as bigint) as issues, coalesce(open, 0) as open from p left join c using (page) left join o using (page)""")
def q_qa_status(spark, d):
    docs = read(spark, d, "documents").where("source is not null")
    plan = docs.select(F.col("source").alias("page")).distinct().withColumn("rank", F.col("page"))
    checks = docs.where("doc_id % 2 = 0").select(F.col("source").alias("page"), F.col("doc_id").alias("at"), (F.col("n_chars") % 9).cast("bigint").alias("issues"))
    return review.qa_status(plan, checks, _items(spark, d)).select("page", "checked", "issues", "open")


@query(f"""with p as (select * from {PAIRS}), g as (select distinct unnest(regexp_extract_all(src, '[A-Z][a-z]+')) as src from p), n as (select id, (length(src) - length(replace(src, 'a', ''))) as x, (length(dst) - length(replace(dst, 'a', ''))) as y from p)
select id, 'placeholder' as rule, 'high' as severity, x || ' ' || y as detail from n where x <> y union all select id, 'term', 'mid', g.src || ' → ' || g.src[1:2] from p, g where contains(p.src, g.src) and not contains(p.dst, g.src[1:2])""")
def q_qa_rules(spark, d):
    two = pairs(spark, d)
    terms = two.select(F.explode(F.regexp_extract_all("src", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("src")).distinct().withColumn("dst", F.left("src", F.lit(2)))
    return review.run_rules(two, terms, "a")


VERSIONS = "(select user_id % 10 as page, user_id as segment, event_type as op, event_type || event_id % 3 as op_id, event_id as version, 'v' || cast(floor(value) as bigint) % 4 as translation from events)"


def _versions(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 10).alias("page"), F.col("user_id").alias("segment"), F.col("event_type").alias("op"), F.concat("event_type", F.col("event_id") % 3).alias("op_id"), F.col("event_id").alias("version"), F.concat(F.lit("v"), F.floor("value") % 4).alias("translation"))


@query(f"""with v as (select segment, max(version) as last, arg_max(translation, version) as new from {VERSIONS} where op = 'click' group by segment), o as (select v.segment, arg_max(x.translation, x.version) as old from v join {VERSIONS} x on x.segment = v.segment and x.version < v.last and x.op <> 'click' group by v.segment)
select 'i' || s.segment as id, case when s.segment % 2 = 0 then 'applied' else 'rejected' end as status, case when s.segment % 2 = 0 then coalesce(old, '') else '' end as old, case when s.segment % 2 = 0 then coalesce(new, '') else '' end as new from (select distinct segment from {VERSIONS}) s left join v using (segment) left join o using (segment)""")
def q_qa_decisions(spark, d):
    v = _versions(spark, d)
    items = v.select("page", "segment").distinct().select(F.concat(F.lit("i"), "segment").alias("id"), "page", F.array(F.lit(-1).cast("bigint"), F.col("segment")).alias("segments"), F.when(F.col("segment") % 2 == 0, "applied").otherwise("rejected").alias("status"))
    return review.decisions(items, v, "click")


def _issues(spark, d):
    said = read(spark, d, "conversations").select(F.col("conv_id").alias("page"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.array("turn", F.col("turn") + 1).alias("segments"), F.col("text").alias("reason"), F.lit("").alias("suggestion"), F.col("role").alias("dst_quote"))
    return said.withColumn("dst_quote", F.lit("")), said.select("page", (F.col("id") + 1_000_000).alias("id"), "segments", F.when(F.col("id") % 2 == 0, F.concat(F.lit("  "), "reason", F.lit("\n"))).otherwise("").alias("reason"), "suggestion", F.lit("").alias("dst_quote"))


@query(f"select conv_id * 100 + turn as id, conv_id * 100 + turn + 1000000 as best, 1.0::double as score from conversations where (conv_id * 100 + turn) % 2 = 0 and regexp_replace(text, '{WS}+', '', 'g') <> ''")
def q_recurrences(spark, d):
    # Old issues repeat the even ones with other white space; those match themselves best. Odd ones may be like a neighbour, or nothing.
    new, old = _issues(spark, d)
    return review.recurrences(new, old).where("id % 2 = 0 and best is not null").select("id", "best", "score")


@query("select kind, count(*) as n from (select case when event_id % 4 = 0 then 'recurred' when user_id % 3 = 0 then 'touched' else 'elsewhere' end as kind from events) group by kind")
def q_composition(spark, d):
    new = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("page"), F.array(F.lit(1), F.lit(2)).alias("segments"))
    matched = new.where("id % 4 = 0").select("id", F.lit(1).alias("best"))
    touched = new.where("page % 3 = 0").select("page", F.lit(2).alias("segment")).distinct()
    return review.composition(new, matched, touched)


@query("with s as (select event_type as source, value / 100 as score, t from events, (values (0.5), (0.6), (0.7)) as x(t)) select source, cast(t as double) as threshold, count(*) as n, round(avg(case when score >= t then 1.0 else 0.0 end), 6) as rate from s group by grouping sets ((t), (source, t))")
def q_recurrence_rates(spark, d):
    return review.recurrence_rates(read(spark, d, "events").select(F.col("event_type").alias("source"), (F.col("value") / 100).alias("score")), [0.5, 0.6, 0.7])


@query("select event_id, case event_id % 6 when 0 then 'adopt' when 1 then 'reject' when 2 then 'adopt' else 'skip' end as verdict, case when event_id % 6 in (0, 2) then event_id end as index from events")
def q_verdicts(spark, d):
    part = F.col("event_id") % 6
    reply = F.when(part == 0, F.format_string('so: {"verdict": "Adopt", "reason": "a {b}", "index": %d} ok', "event_id")).when(part == 1, F.lit('```json\n{"verdict": " reject "}\n```')).when(part == 2, F.format_string('{"verdict": "adopt", "suggestion": "say "x" now", "index": "%d"}', "event_id")).when(part == 3, F.lit('{"verdict": "maybe"}')).when(part == 4, F.lit("no object"))
    return review.verdicts(read(spark, d, "events").select("event_id", reply.alias("reply"))).select("event_id", "verdict", F.col("index").cast("bigint").alias("index"))


@query("select conv_id as page, turn as asked, turn % 2 = 1 and n > 1 as drift from (select *, count(*) over (partition by conv_id) as n from conversations)")
def q_relevance_guard(spark, d):
    # Each item has a mark of its own; odd replies carry the next item's.
    mark = lambda n: F.repeat(F.md5(F.concat_ws("-", "conv_id", n)), 1)
    rows = read(spark, d, "conversations").withColumns({"n": F.count("*").over(Window.partitionBy("conv_id")), "low": F.min("turn").over(Window.partitionBy("conv_id"))})
    other = F.when(F.col("n") > 1, F.when(F.col("turn") == F.col("low"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).otherwise(F.col("low"))).otherwise(F.col("turn"))
    rows = rows.withColumn("other", other)
    return review.drifted(rows.select(F.col("conv_id").alias("page"), F.col("turn").alias("asked"), F.when(F.col("turn") % 2 == 1, mark("other")).otherwise(mark("turn")).alias("reply")), rows.select(F.col("conv_id").alias("page"), F.col("turn").alias("id"), mark("turn").alias("profile")))


@query("select user_id as grp, count(*) as calls, count(*) filter (n > 1 and event_id % 3 = 0) as resets, count(*) filter (event_id % 4 = 1) as mismatches from (select *, row_number() over (partition by user_id order by event_id) as n from events) group by user_id")
def q_drift_audit(spark, d):
    return review.drift_audit(read(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("call"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(4).alias("messages"), F.col("event_id").alias("asked"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") + (F.col("event_id") % 4 == 1).cast("int")).alias("echoed")))


@query("select 'qa_' || left(md5(source || '|' || doc_id || ',' || doc_id + 1 || '|' || coalesce(lang, '') || '|s|rule'), 12) as id, 'open' as status, true as resolved from documents where source is not null")
def q_queue_items(spark, d):
    found = read(spark, d, "documents").where("source is not null").select(F.col("source").alias("page"), F.array("doc_id", F.col("doc_id") + 1).alias("segments"), F.col("lang").alias("reason"), F.lit("s").alias("suggestion"), F.lit("mid").alias("severity"), F.lit("rule").alias("source"))
    return review.make_items(found).select("id", "status", "resolved")


# ---- histories -----------------------------------------------------------------------------------------------------


@query(f"with t as (select distinct segment from {VERSIONS} where op_id = 'click1') select segment, (select max(version) from {VERSIONS} v where v.segment = t.segment and op_id <> 'click1') as to_version from t")
def q_targets_of_operation(spark, d):
    return review.targets(_versions(spark, d), op_id="click1").select("segment", "to_version")


@query(f"with n as (select segment, arg_max(translation, version) as now from {VERSIONS} group by segment) select n.segment, (select max(version) from {VERSIONS} v where v.segment = n.segment and v.translation <> now) as to_version from n where n.segment % 2 = 0")
def q_targets_of_segments(spark, d):
    v = _versions(spark, d)
    return review.targets(v, v.where("segment % 2 = 0")).select("segment", "to_version")


@query(f"with n as (select segment, arg_max(translation, version) as now from {VERSIONS} group by segment), t as (select segment, max(version) as to_version from {VERSIONS} where op_id <> 'click1' group by segment) select n.segment, case when n.segment in (select segment from {VERSIONS} where op_id = 'click1') and t.to_version is not null then v.translation else now end as translation from n left join t using (segment) left join {VERSIONS} v on v.segment = t.segment and v.version = t.to_version")
def q_restored(spark, d):
    v = _versions(spark, d)
    state = quality.latest(v, "segment", ["version"]).select("page", "segment", "translation")
    return review.restored(state, v, review.targets(v, op_id="click1")).select("segment", "translation")


@query(f"with r as (select *, row_number() over (partition by segment order by version) as i, row_number() over (partition by segment order by version desc) as j from {VERSIONS}) select segment, max(version) as version from r where case segment % 3 when 0 then i = 2 when 1 then j = 1 else i = 1 end group by segment")
def q_version_picks(spark, d):
    v = _versions(spark, d)
    first = v.groupBy("page", "segment").agg(F.min("version").alias("low"))
    wanted = first.select("page", "segment", F.when(F.col("segment") % 3 == 0, F.lit(2)).when(F.col("segment") % 3 == 1, F.lit(-1)).otherwise(F.col("low")).alias("pick"))
    return review.picked(v.withColumn("version", F.col("version") + 1_000_000), wanted.withColumn("pick", F.when(F.col("segment") % 3 == 2, F.col("pick") + 1_000_000).otherwise(F.col("pick")))).select("segment", (F.col("version") - 1_000_000).alias("version"))


@query(f"with r as (select *, lag(translation) over (partition by segment order by version) as old from {VERSIONS}) select segment, arg_max(translation, version) as new, (select x.old from r x where x.segment = r.segment and x.op = 'view' order by version desc limit 1) as old from r where op = 'view' group by segment")
def q_applied_before(spark, d):
    return review.applied_before(_versions(spark, d), "view").select("segment", "new", "old")


@query("select doc_id as segment from documents where coalesce(text, '') <> '' and doc_id not in (select doc_id from labels)")
def q_backfill(spark, d):
    state = read(spark, d, "documents").select(F.lit(1).alias("page"), F.col("doc_id").alias("segment"), F.col("text").alias("translation"))
    return review.backfill(state, read(spark, d, "labels").select(F.lit(1).alias("page"), F.col("doc_id").alias("segment"))).select("segment")


@query("select doc_id as segment, case when doc_id % 5 > 0 then md5(text) end as digest from documents where doc_id % 7 > 0")
def q_reset_state(spark, d):
    state = read(spark, d, "documents").select((F.col("doc_id") % 7).alias("page"), F.col("doc_id").alias("segment"), F.col("text").alias("translation"))
    out = review.reset(state, state.where("page = 0"), state.where("segment % 5 = 0"))
    return out.select("segment", F.md5("translation").alias("digest"))


@query("with e as (select user_id as id, arg_max(event_type, event_id) as action, arg_max(event_id, event_id) as value from events group by user_id) select id, case action when 'click' then 'w' || value when 'view' then null else 't' || id end as translation, case action when 'click' then 'done' when 'view' then 'deleted' else 'open' end as status from e")
def q_review_folded(spark, d):
    ev = read(spark, d, "events")
    events = ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "delete").otherwise("skip").alias("action"), F.concat(F.lit("w"), "event_id").alias("value"))
    return review.folded(ev.select(F.col("user_id").alias("id")).distinct().withColumn("translation", F.concat(F.lit("t"), "id")), events)


@query("""with r as (select user_id % 10 as page, user_id as s, case when user_id % 3 = 0 then 'same' else 'change' end as a from (select distinct user_id from events))
select page, concat_ws(chr(10), coalesce(string_agg('- ' || s || ' change: a → ∅', chr(10) order by length(s::varchar), s::varchar) filter (a <> 'same'), ''), count(*) filter (a <> 'same') || ' changed, ' || count(*) filter (a = 'same') || ' same') as text from r group by page""")
def q_plan_text(spark, d):
    plan = read(spark, d, "events").select((F.col("user_id") % 10).alias("page"), F.col("user_id").alias("segment")).distinct()
    return review.plan_text(plan.select("page", "segment", F.when(F.col("segment") % 3 == 0, "same").otherwise("change").alias("action"), F.lit("a").alias("from_value"), F.lit(None).cast("string").alias("to_value")))


@query("with g as (select user_id, event_type, max(event_id) as last from events group by all) select event_id from events join (select user_id, event_type from (select *, row_number() over (partition by user_id order by last desc, event_type) as n from g) where n <= 2) using (user_id, event_type)")
def q_last_groups(spark, d):
    return review.last_groups(read(spark, d, "events"), "user_id", "event_type", "event_id", 2).select("event_id")


# ---- dictionaries --------------------------------------------------------------------------------------------------


@query(f"""with p as (select id, src, id % 4 as k from {PAIRS}), n as (select src, arg_max('n' || id, id) as dst from p where k < 3 and trim(src, ' ') <> '' group by src), g as (select src, case when min(id) % 3 = 0 then '' else 'o' || min(id) end as old from p where id % 2 = 0 group by src)
select md5(src) as src, case when g.old is not null and g.old <> '' and g.old <> dst then g.old else dst end as dst, case when g.old is null then 'added' when g.old = '' or g.old = dst then 'updated' else 'conflict' end as action from n left join g using (src) union all select md5(src), 'n' || id, 'skipped' from p where k = 3 or trim(src, ' ') = ''""")
def q_import_confirmed(spark, d):
    two = pairs(spark, d)
    glossary = two.where("id % 2 = 0").groupBy("src").agg(F.when(F.min("id") % 3 == 0, "").otherwise(F.concat(F.lit("o"), F.min("id"))).alias("dst"))
    new = two.select("src", F.concat(F.lit("n"), "id").alias("dst"), F.element_at(F.array(*map(F.lit, ("term", "name", "place", "odd"))), (F.col("id") % 4 + 1).cast("int")).alias("category"), F.col("id").alias("seq"))
    return review.import_confirmed(glossary, new, ["term", "name", "place"]).withColumn("src", F.md5("src"))


@query(f"""with p as (select id, dst, trim(regexp_replace(src, '{WS}+', ' ', 'g'), ' ') as key from {PAIRS}), n as (select key, arg_max(dst, id) as n, count(*) as u from p where length(key) between 1 and 60 and key not in (select key from p where id % 5 = 0) group by key), o as (select key, min('o' || id) as dst, 1 as usage from p where id % 3 = 0 group by key)
select md5(key) as key, md5(coalesce(n, dst)) as dst, coalesce(usage, 0) + coalesce(u, 0) as usage from o full join n using (key)""")
def q_learn_phrases(spark, d):
    two = pairs(spark, d)
    key = T.normalize_ws(F.col("src"))
    known = two.where("id % 3 = 0").groupBy(key.alias("key")).agg(F.min(F.concat(F.lit("o"), "id")).alias("dst"), F.lit(1).cast("bigint").alias("usage"))
    glossary = two.where("id % 5 = 0").select(key.alias("src"), F.lit(True).alias("read_only"))
    return review.learn_phrases(known, two.select("src", "dst", F.col("id").alias("seq")), glossary, 60).select(F.md5("key").alias("key"), F.md5("dst").alias("dst"), "usage")


@query("select c_name as src, case when c_custkey % 6 = 0 then 'new' else c_mktsegment end as dst, case when c_custkey % 3 = 0 then 'confirmed' else 'auto' end as status from customer")
def q_confirm_terms(spark, d):
    glossary = read(spark, d, "customer").select(F.col("c_name").alias("src"), F.col("c_mktsegment").alias("dst"), F.lit("auto").alias("status"), "c_custkey")
    terms = glossary.where("c_custkey % 3 = 0").select("src", F.when(F.col("c_custkey") % 6 == 0, "new").alias("dst"))
    return review.confirm(glossary, terms).select("src", "dst", "status")


@query(f"select id from {PAIRS} where not (contains(src, 'the') and not contains(dst, 'le')) and not contains(dst, 'que')")
def q_add_term(spark, d):
    two = pairs(spark, d)
    out = review.add_term("the", "le", two.select("src", "dst", F.lit("auto").alias("status")), two.select(F.col("src").alias("key"), "dst"), two, two.select(F.col("src").alias("quote"), F.col("dst").alias("summary")), ["que"])
    return out["memory"].select("id")


@query(f"""with l as (select id, src, i, trim(regexp_replace(s[i], '{WS}+', ' ', 'g'), ' ') as key, s[i] as t from (select id, src, string_split(src, chr(10)) as s from {PAIRS}) z, unnest(range(1, len(s) + 1)) as r(i)),
x as (select id, any_value(src) as before, string_agg(case when length(key) % 2 = 0 and key <> '' then '<' || key || '>' else t end, chr(10) order by i) as after from l group by id) select id, md5(before) as before, md5(after) as after from x where before <> after""")
def q_audit_terms(spark, d):
    two = pairs(spark, d).select("id", "src", F.col("src").alias("dst"))
    keys = two.select(F.explode(F.split("src", "\n")).alias("s")).select(T.normalize_ws(F.col("s")).alias("src")).distinct().where("length(src) % 2 = 0 and src != ''").withColumn("dst", F.concat(F.lit("<"), "src", F.lit(">")))
    return review.audit_terms(two, keys.where("length(src) % 4 = 0").withColumn("read_only", F.lit(True)), keys.withColumnRenamed("src", "key")).select("id", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query("select p.page_id as page, concat_ws(',', a.page_id, b.page_id) as related from pages p left join pages a on a.page_id = p.page_id + 1 left join pages b on b.page_id = p.page_id - 1")
def q_related_pages(spark, d):
    rows = read(spark, d, "pages").select(F.col("page_id").alias("page"))
    return review.related(rows.withColumn("related", F.array(F.col("page") + 1, F.col("page") + 1_000_000, F.col("page") - 1)), rows).select("page", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


@query("with g as (select distinct unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as src from benchmark) select src, count(*) as texts, cast(sum((length(text) - length(replace(text, src, ''))) // length(src)) as bigint) as places from g, documents where contains(text, src) group by src")
def q_term_hits(spark, d):
    terms = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("src"))
    return review.hit_texts(terms, read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("with g as (select src, count(*) as usage from (select unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as src from documents) group by src having count(*) >= 30), h as (select conv_id * 100 + turn as id, src, usage from g, conversations where contains(lower(text), lower(src))) select id, src, rank from (select *, row_number() over (partition by id order by usage desc, src) as rank from h) where rank <= 10")
def q_phrase_relevance(spark, d):
    phrases = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("src")).groupBy("src").agg(F.count("*").alias("usage")).where("usage >= 30")
    return similarity.phrase_relevance(phrases, read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"))


_G2 = "list_distinct(list_transform(range(1, greatest(2, length(x))), lambda i: x[i : i + 1]))"


@query(f"""with a as (select id, {_G2} as g from (select id, regexp_replace(lower(src), '[\\s[:punct:]]+', '', 'g') as x from {PAIRS}) where length(x) > 1), t as (select item_id as id, {_G2} as g from (select item_id, regexp_replace(lower(text), '[\\s[:punct:]]+', '', 'g') as x from benchmark) where length(x) > 1),
s as (select a.id as q_id, t.id, round(2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)), 6) as score from a, t where len(list_intersect(a.g, t.g)) > 0) select * from (select q_id, id, score, row_number() over (partition by q_id order by score desc, id) as rank from s) where rank <= 3""")
def q_exemplars(spark, d):
    bare = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Punct}　]+", "")) > 1
    return similarity.exemplars(pairs(spark, d).where(bare("src")).select("id", F.col("src").alias("text")), read(spark, d, "benchmark").where(bare("text")).select(F.col("item_id").alias("id"), "text"))


# ---- a hierarchical site -------------------------------------------------------------------------------------------

_DIR = "'r' || n_regionkey || '/n' || n_nationkey"
SITE = f"""pages(page, text_len, volume, nation) as (select 'index.html', 0, 0, null union all select 'r' || r_regionkey || '/index.html', 10 * r_regionkey, 0, null from region union all select {_DIR} || '/index.html', 100 + n_nationkey, 0, null from nation
  union all select {_DIR} || '/s' || s_suppkey || '.html', cast(floor(s_acctbal) as bigint), s_suppkey % 100, n_nationkey from supplier join nation on n_nationkey = s_nationkey),
ranked as (select {_DIR} || '/index.html' as src, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as pos, {_DIR} || '/s' || s_suppkey || '.html' as dst from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 10 > 0),
links as (select 'index.html' as src, row_number() over (order by r_name) as pos, 'r' || r_regionkey || '/index.html' as dst from region union all select 'r' || n_regionkey || '/index.html', row_number() over (partition by n_regionkey order by n_name), {_DIR} || '/index.html' from nation union all select * from ranked)"""


def _site(spark, d):
    region, nation, supplier = (read(spark, d, t) for t in ("region", "nation", "supplier"))
    nation = nation.withColumns({"up": F.concat(F.lit("r"), "n_regionkey"), "dir": F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey")})
    leaf = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("page", F.concat("dir", F.lit("/s"), "s_suppkey", F.lit(".html")))
    index = lambda c: F.concat(c, F.lit("/index.html"))
    root = region.agg(F.lit("index.html").alias("page"), F.lit(0).cast("bigint").alias("text_len"), F.lit(0).cast("bigint").alias("volume"))
    rows = root.unionByName(region.select(index(F.concat(F.lit("r"), "r_regionkey")).alias("page"), (10 * F.col("r_regionkey")).cast("bigint").alias("text_len"), F.lit(0).cast("bigint").alias("volume")))
    rows = rows.unionByName(nation.select(index(F.col("dir")).alias("page"), (100 + F.col("n_nationkey")).cast("bigint").alias("text_len"), F.lit(0).cast("bigint").alias("volume")))
    rows = rows.unionByName(leaf.select("page", F.floor("s_acctbal").cast("bigint").alias("text_len"), (F.col("s_suppkey") % 100).cast("bigint").alias("volume")))
    links = region.select(F.lit("index.html").alias("src"), F.row_number().over(Window.orderBy("r_name")).alias("pos"), index(F.concat(F.lit("r"), "r_regionkey")).alias("dst"))  # a row a region
    links = links.unionByName(nation.select(index(F.col("up")).alias("src"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("pos"), index(F.col("dir")).alias("dst")))
    links = links.unionByName(leaf.where("s_suppkey % 10 > 0").select(index(F.col("dir")).alias("src"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("pos"), F.col("page").alias("dst")))
    degree = links.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("in_degree"))
    rows = rows.join(degree, "page", "left").select("page", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "volume", "text_len", (F.size(F.split("page", "/")) - 1).alias("depth"), F.lit(None).cast("bigint").alias("date"), F.lit(None).cast("int").alias("nav"), F.lit(0).alias("dfs"))
    return rows, links


_COVERED = "(select regexp_replace(src, '/?[^/]*$', '') as dir, src as index, count(*) as hit from links group by src), sizes as (select regexp_replace(page, '/?[^/]*$', '') as dir, count(*) as n from pages group by 1), subs as (select regexp_replace(regexp_replace(page, '/?[^/]*$', ''), '/?[^/]*$', '') as dir, count(distinct regexp_replace(page, '/?[^/]*$', '')) as k from pages where page like '%/index.html' group by 1)"


@query(f"with {SITE}, c as {_COVERED} select c.dir, index, round(hit / greatest(1, n + coalesce(case when c.dir = '' then k - 0 else k end, 0) - 1), 6) as coverage from c join sizes using (dir) left join subs on subs.dir = c.dir where hit / greatest(1, n + coalesce(k, 0) - 1) >= 0.6")
def q_site_indexes(spark, d):
    return site.indexes(*_site(spark, d)).select("dir", "index", F.round("coverage", 6).alias("coverage"))


@query(f"""with {SITE}, o as (select src, pos, dst from links), r as (select n_nationkey as nation, rr * 1000 + nn as up from (select n_nationkey, row_number() over (partition by n_regionkey order by n_name) as nn, rr from nation join (select r_regionkey, row_number() over (order by r_name) as rr from region) on r_regionkey = n_regionkey)),
orphan as (select page, row_number() over (partition by nation order by page) as k, nation from pages where nation is not null and page not in (select dst from links)), last as (select regexp_replace(src, '/?[^/]*$', '') as dir, max(pos) as top from links group by src), inside as (select regexp_replace(page, '/?[^/]*$', '') as dir, count(*) - 1 as n from pages group by 1)
select p.page, cast(case when p.page in (select dst from links where src like '%/n%') or p.page in (select page from orphan) then 1 else 0 end as double) as leaf, (r.up * 1000 + coalesce(o.pos, last.top + orphan.k)) as own, orphan.page is not null as is_orphan from pages p join r on r.nation = p.nation left join o on o.dst = p.page left join orphan on orphan.page = p.page join last on last.dir = regexp_replace(p.page, '/?[^/]*$', '') join inside on inside.dir = last.dir where last.top / inside.n >= 0.6""")
def q_site_levels(spark, d):
    # Ranks in folders: linked members in link order behind the index, then the rest by name; paths as the folders' ranks.
    rows, links = _site(spark, d)
    found = site.indexes(rows, links)
    ranks = site.level_ranks(rows, links, found).where("page like '%/s%'")
    scored = site.scores(rows, links)
    # The semantic score is 1 minus a share of the whole span: the span is undone by the largest and the least.
    entry = site.level_ranks(rows, links, found).where("page like '%/index.html'").withColumn("sub", site.folder(F.col("page")))
    up = entry.where("sub != dir").select(F.col("sub").alias("dir"), F.col("rank").alias("up"), F.col("dir").alias("parent"))
    path = up.join(up.select(F.col("dir").alias("parent"), F.col("up").alias("top")), "parent").select("dir", (F.col("top") * 1000 + F.col("up")).alias("up"))
    out = ranks.join(path, "dir").join(scored.select("page", F.col("is_orphan")), "page")
    return out.select("page", F.lit(1.0).alias("leaf"), (F.col("up") * 1000 + F.col("rank")).cast("bigint").alias("own"), (F.col("is_orphan") > 0).alias("is_orphan"))


@query()
def q_site_plan(spark, d):
    return site.plan(site.scores(*_site(spark, d))).select("page", "total", "rank", "reason")


@query("select o_orderkey as page, coalesce(case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end, case when o_orderkey % 3 > 0 then '1999-01-0' || (o_orderkey % 3) end) as date from orders")
def q_enriched_dates(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    anchors = rows.select(F.col("page").alias("dst"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit(None).cast("string").alias("date")), F.struct(F.lit(2).alias("pos"), F.when(F.col("page") % 3 > 0, F.concat(F.lit("1999-01-0"), F.col("page") % 3)).alias("date")), F.struct(F.lit(3).alias("pos"), F.when(F.col("page") % 3 > 0, F.lit("2000-01-01")).alias("date")))).alias("a")).select("dst", "a.*")
    return site.enriched_dates(rows, anchors)


# ---- prompts, loops, logs ------------------------------------------------------------------------------------------


@query("select conv_id, turn, '## Facts' || chr(10) || 'x' || turn || chr(10) || chr(10) || '## End' || chr(10) || 'e' || case when conv_id % 2 = 0 then chr(10) || chr(10) || '## Style' || chr(10) || 'plain' else '' end as text from conversations")
def q_style_sections(spark, d):
    text = F.concat(F.lit("## Style\nold\nlines\n\n## Facts\nx"), "turn", F.lit("\n## Style guide\nz\n## End\ne\n"))
    return read(spark, d, "conversations").select("conv_id", "turn", loop.styled(text, F.when(F.col("conv_id") % 2 == 0, "plain")).alias("text"))


@query("select n_nationkey, '- ' || n_name || ' → ' || n_nationkey || case when n_regionkey > 2 then ' (far)' else '' end || chr(10) || '- x → y' as text from nation")
def q_term_lines(spark, d):
    terms = F.array(F.struct(F.col("n_name").alias("src"), F.col("n_nationkey").cast("string").alias("dst"), F.when(F.col("n_regionkey") > 2, "far").alias("note")), F.struct(F.lit("x").alias("src"), F.lit("y").alias("dst"), F.lit("").alias("note")))
    return read(spark, d, "nation").select("n_nationkey", loop.term_lines(terms).alias("text"))


@query(f"select id, md5(case when id % 2 = 0 then '## Style' || chr(10) || 'plain' || chr(10) || chr(10) || '## Terms' || chr(10) || 'a' || chr(10) || chr(10) else '## Terms' || chr(10) || 'a' || chr(10) || chr(10) end || '|TEXT|' || src) as prompt, id % 1000 as index from {PAIRS}")
def q_prompts(spark, d):
    ask = lambda first: loop.translate_prompt(F.col("src"), F.lit("a"), F.lit(""), F.lit("plain"), first)
    item = loop.item_text(F.col("id") % 1000, F.lit("r"), F.lit(""), F.col("src"), F.col("dst"))
    return pairs(spark, d).select("id", F.md5(F.when(F.col("id") % 2 == 0, ask(True)).otherwise(ask(False))).alias("prompt"), loop.item_index(item).cast("bigint").alias("index"))


_CAPS = "(select src, count(*) as count, count(distinct doc_id) as pages from (select doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)*')) as src from documents) where length(src) >= 2 group by src)"


@query(f"with t as (select distinct src from {_CAPS} where count >= 7), k as (select src from t where length(src) % 5 = 0) select src, length(src) % 5 = 0 or length(src) % 3 > 0 as keep from t")
def q_term_review(spark, d):
    terms = mining.runs(read(spark, d, "documents")).where("count >= 7").select("src")
    known = terms.where("length(src) % 5 = 0").select("src", F.lit(True).alias("keep"))
    return loop.reviewed_terms(terms, known, lambda names: {n: False for n in names if len(n) % 3 == 0})


@query(f"""with f as (select src, count, pages from {_CAPS} where count >= 7 and pages >= 2 and length(src) % 3 > 0), s as (select src, count, pages from {_CAPS} where count >= 3 and count < 7 and pages >= 2),
m as (select * from s where not exists (select 1 from (select src from f union all select src from s) o where o.src <> s.src and contains(' ' || o.src || ' ', ' ' || s.src || ' '))), e as (select * from f union all select * from m where length(src) % 3 > 0)
select arg_max(src, (contains(src, ' '), count, src)) as src, arg_max(count, (contains(src, ' '), count, src)) as count, arg_max(pages, (contains(src, ' '), count, src)) as pages from e group by lower(regexp_replace(src, '{WS}+', '', 'g'))""")
def q_two_pass_terms(spark, d):
    return loop.two_passes(mining.runs(read(spark, d, "documents")), lambda terms: terms.where("length(src) % 3 > 0"))


@query("select c_custkey % 4 < 2 as ok, count(*) as n, count(case when c_custkey % 4 < 2 then c_name end) as named from customer where c_custkey % 4 < 3 group by 1")
def q_review_by_hand(spark, d):
    part = F.col("c_custkey") % 4
    made = loop.review_lines(read(spark, d, "customer").select(F.col("c_name").alias("src"), F.lit("x").alias("dst"), F.lit("name").alias("category"), "c_custkey", F.lit(1).alias("count")).select("src", "dst", "category", "count"))
    named = read(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("src"), F.lit("x").alias("dst"), F.lit("name").alias("category"))).alias("line"))
    line = F.when(part == 0, F.col("line")).when(part == 1, F.concat("line", F.lit(" , "))).when(part == 2, F.lit("{broken")).otherwise(F.lit("  "))
    read_back = loop.read_review(named.select(line.alias("line")))
    good = loop.read_review(made).agg(F.bool_and("ok").alias("all")).select("all")
    return read_back.join(F.broadcast(good), F.col("all")).groupBy("ok").agg(F.count("*").alias("n"), F.count("src").alias("named"))  # one row


@query("select conv_id as grp, md5(string_agg('## ' || turn || chr(10) || chr(10) || '### ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '### reply' || chr(10) || chr(10) || 'r', chr(10) || chr(10) order by turn)) as digest from conversations group by conv_id")
def q_log_text(spark, d):
    calls = read(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("call"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.lit("r").alias("reply"))
    return loop.log_text(calls).select("grp", F.md5("text").alias("digest"))


@query("""with r as (select 'r' || event_id as run, event_id as start from events where event_id % 10 = 5), l as (select event_id as log, event_id + 0.5 as t from events), k as (select log, case when log % 4 = 0 and 'r' || (log // 10 * 10 + 5) in (select run from r) then 'r' || (log // 10 * 10 + 5) when log % 4 = 1 and 'r' || 5 in (select run from r) then 'r5' end as run, t from l)
select log, coalesce(run, (select run from r where start <= t order by start desc limit 1)) as run, case when run is not null and log % 4 = 0 then 'tag' when run is not null then 'before' else 'time' end as how from k where coalesce(run, (select run from r where start <= t order by start desc limit 1)) is not null""")
def q_log_rebind(spark, d):
    ids = read(spark, d, "events").select("event_id")
    runs = ids.where("event_id % 10 = 5").select(F.concat(F.lit("r"), "event_id").alias("run"), F.col("event_id").cast("double").alias("start"))
    logs = ids.select(F.col("event_id").alias("log"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("r"), F.floor(F.col("event_id") / 10) * 10 + 5)).otherwise("none").alias("tag"), (F.col("event_id") + 0.5).alias("t"))
    return loop.rebound(logs, runs, logs.where("log % 4 = 1").select("log", F.lit("r5").alias("run")))


@query(f"""with h as (select left(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), 80) as x, conv_id, turn from conversations), p as (select distinct x from h where turn % 2 = 0), t as (select conv_id * 100 + turn as id, x from h where turn % 2 = 1 and x <> '')
select id, max(k) as size from t, p, unnest(range(1, 81)) as r(k) where k <= length(t.x) and k <= length(p.x) and left(t.x, cast(k as bigint)) = left(p.x, cast(k as bigint)) group by id""")
def q_prefix_match(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    return loop.longest_prefixes(turns.where("turn % 2 = 1"), turns.where("turn % 2 = 0").select(F.col("id").alias("page"), "text"))


@query(f"select id, md5(src) as digest, length(src) as completion_tokens, id % 7 = 0 as failed from {PAIRS}".replace("md5(src) as digest, length(src)", "case when id % 7 > 0 then md5(src) end as digest, case when id % 7 > 0 then length(src) else 0 end"))
def q_model_calls(spark, d):
    def model(prompt, temperature, tokens):
        if "|FAIL|" in prompt:
            raise KeyError("refused")
        return loop.echo(prompt, temperature, tokens)

    prompts = pairs(spark, d).select("id", F.lit("translate_x").alias("tag"), F.concat(F.when(F.col("id") % 7 == 0, "|FAIL|").otherwise(""), F.lit("|TEXT|"), "src").alias("prompt"))
    out = loop.chat(prompts, model, loop.Settings(walls={"translate": 5.0}))
    return out.select("id", F.md5(F.get_json_object("reply", "$.translation")).alias("digest"), "completion_tokens", F.col("error").isNotNull().alias("failed"))


@query("select source as page, doc_id as id, case when doc_id % 4 = 1 then 'skip' when doc_id % 2 = 0 then 'adopt' else 'reject' end as verdict, doc_id % 4 = 1 as drift from labels join documents using (doc_id) where source is not null")
def q_adjudicated(spark, d):
    def judge(said, i, item):
        verdict = "adopt" if item["id"] % 2 == 0 else "reject"
        return f'{{"verdict": "{verdict}", "index": {i + (2 if item["id"] % 4 == 1 else 1)}}}'

    items = read(spark, d, "labels").join(read(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id").select(F.col("source").alias("page"), F.col("doc_id").alias("id"), F.lit("p").alias("profile"))
    return loop.adjudicated(items, judge).select("page", "id", "verdict", "drift")


@query("select conv_id * 100 + turn as id, md5(text) as digest from conversations where turn % 3 > 0")
def q_page_summaries(spark, d):
    import json

    def model(prompt, temperature, tokens):
        return loop.Reply(json.dumps({"summary": prompt.partition("\n")[2]}))

    turns = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    return loop.summaries(turns.select("id", "text"), model, loop.Settings(), turns.where("turn % 3 = 0")).select("id", F.md5("text").alias("digest"))


@query(f"""with t as (select id, src, case when id % 3 = 0 then 'g' || id when id % 3 = 1 then '[[P0]]' || src else src || '[[P1]]' end as want from {PAIRS}) select id, md5(want) as digest, case when id % 3 = 0 then 'glossary' else 'model' end as origin, 1.0::double as confidence, false as needs_human from t""")
def q_translated_segments(spark, d):
    import json

    def model(prompt, temperature, tokens):  # loses every placeholder
        return loop.Reply(json.dumps({"translation": prompt.partition("|TEXT|")[2].replace("[[P0]]", "").replace("[[P1]]", ""), "confidence": 1.0}))

    two = pairs(spark, d)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("known "), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("[[P0]]"), "src")).otherwise(F.concat("src", F.lit("[[P1]]")))
    segments = two.select("page", "id", text.alias("text"))
    glossary = two.where("id % 3 = 0").select(F.concat(F.lit("known "), "id").alias("src"), F.concat(F.lit("g"), "id").alias("dst"), F.col("id").alias("seq"), F.lit(True).alias("read_only"))
    phrases = spark.createDataFrame([], "key string, dst string")
    terms = two.select("page", F.lit("- a → b").alias("lines")).distinct()
    out = loop.translated(segments, glossary, phrases, terms, model, loop.Settings())
    return out.select("id", F.md5("translation").alias("digest"), "origin", "confidence", "needs_human")


# ---- files, counts, statistics -------------------------------------------------------------------------------------


@query("select c_custkey, case when c_custkey % 3 = 2 then '{not json' else c_name || '|' || c_mktsegment || '|x' end as strings from customer")
def q_json_strings(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 2, F.lit("{not json")).otherwise(F.to_json(F.struct(F.col("c_name").alias("a"), F.lit(1).alias("n"), F.struct(F.array("c_mktsegment", F.lit("x")).alias("l")).alias("b"))))
    return read(spark, d, "customer").select("c_custkey", F.array_join(files.json_strings(raw), "|").alias("strings"))


@query("select event_id, case event_id % 3 when 0 then 'C:\\data\\' || event_id || '.txt,instance/data-' || event_id when 1 then 'd:/x' || event_id else '' end as paths from events")
def q_path_audit(spark, d):
    part = F.col("event_id") % 3
    text = F.when(part == 0, F.concat(F.lit("see C:\\data\\"), "event_id", F.lit(".txt and instance/data-"), "event_id", F.lit(" end"))).when(part == 1, F.concat(F.lit("(d:/x"), "event_id", F.lit(")"))).otherwise("none: here")
    return read(spark, d, "events").select("event_id", F.array_join(files.paths_in(text), ",").alias("paths"))


@query("select event_id, 'page' || user_id as page from events")
def q_log_pages(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("translate_", "qa_", "fix_", "note_", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    tag = F.concat(head, F.lit("page"), "user_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("_seg"), "event_id")).otherwise(""))
    return read(spark, d, "events").select("event_id", files.log_page(tag).alias("page"))


@query("select 'glossary' as key, count(*) as n from customer where c_custkey % 4 = 0 union all select 'style', count(*) from customer where c_custkey % 4 = 1")
def q_preferences(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("glossary", "style", "api_key", "model"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return files.preferences(read(spark, d, "customer").select(key.alias("key"), F.col("c_name").alias("value"))).groupBy("key").agg(F.count("*").alias("n"))


@query(f"select id from {PAIRS} where id % 3 > 0 and trim(src, ' ') <> '' and trim(dst, ' ') <> ''")
def q_style_refs(spark, d):
    return files.style_refs(pairs(spark, d).withColumn("dst", F.when(F.col("id") % 3 > 0, F.col("dst")).otherwise(" "))).select("id")


@query(f"select 'done' as what, count(*) as n from documents union all select 'queue ' || status, count(*) from {ITEMS} group by status union all select 'plan', count(*) from pages")
def q_status_overview(spark, d):
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    queue = _items(spark, d).groupBy(F.concat(F.lit("queue "), "status").alias("what")).agg(F.count("*").alias("n"))
    return count(read(spark, d, "documents").select("doc_id"), "done").unionByName(queue).unionByName(count(read(spark, d, "pages").select("page_id"), "plan"))


@query("select event_type as run, cast(sum(event_id % 7) as bigint) as issues, cast(sum(user_id) as bigint) as tokens, count(*) filter (event_id % 9 = 0) as repaired from events group by event_type")
def q_runs_summary(spark, d):
    reply = F.when(F.col("event_id") % 9 == 0, F.lit('{"translation": "x", "repaired": true}')).otherwise(F.lit('{"translation": "x"}'))
    return read(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.sum(F.col("event_id") % 7).alias("issues"), F.sum("user_id").alias("tokens"), F.count_if(F.coalesce(F.get_json_object(reply, "$.repaired") == "true", F.lit(False))).alias("repaired"))


@query("select user_id as grp, avg(case when p then 1.0 end) as parsed, avg(case when p and event_id % 3 > 0 then n end) as notes, count(distinct case when p then n end) / nullif(count(case when p then 1 end), 0) as unique_rate from (select *, event_id % 5 > 0 as p, cast(floor(value) as bigint) % 6 as n from events) group by user_id")
def q_annotation_metrics(spark, d):
    ok, n = F.col("event_id") % 5 > 0, F.floor("value") % 6
    return read(spark, d, "events").groupBy(F.col("user_id").alias("grp")).agg(F.avg(F.when(ok, 1.0)).alias("parsed"), F.avg(F.when(ok & (F.col("event_id") % 3 > 0), n)).alias("notes"), F.try_divide(F.count_distinct(F.when(ok, n)), F.count_if(ok)).alias("unique_rate"))


@query()
def q_self_similarity(spark, d):
    turns = read(spark, d, "conversations").where("turn < 4").select("conv_id", "turn", "text")
    two = turns.join(turns.select("conv_id", F.col("turn").alias("other"), F.col("text").alias("second")), "conv_id").where("turn < other")
    return two.groupBy("conv_id").agg(F.round(F.avg(texts_udf.ratio_udf(F.col("text"), F.col("second"))), 6).alias("mean"))


@query()
def q_permuted_kruskal(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    return stats.permuted_kruskal(rows, "g", "v", 200).select(F.round("h", 6).alias("h"), F.round("p", 6).alias("p"))


@query("select user_id % 3 as variant, event_type as severity, count(*) as n, round(count(*) / (select count(distinct event_id % 4) from events), 6) as per_run, round(avg(case when event_id % 5 = 0 then 1.0 else 0.0 end), 6) as on_applied from events group by all")
def q_variant_totals(spark, d):
    runs = read(spark, d, "events").agg(F.count_distinct(F.col("event_id") % 4).alias("runs"))
    by = read(spark, d, "events").groupBy((F.col("user_id") % 3).alias("variant"), F.col("event_type").alias("severity")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_id") % 5 == 0).cast("double")), 6).alias("on_applied"))
    return by.join(F.broadcast(runs)).select("variant", "severity", "n", F.round(F.col("n") / F.col("runs"), 6).alias("per_run"), "on_applied")  # one row


@query("select conv_id % 3 as variant, count(*) as n, median(length(text)) as median from conversations where conv_id % 5 > 0 and text <> '' group by 1")
def q_variant_stats(spark, d):
    # Runs that end in a loop drop out; every fifth one is made to.
    said = F.when(F.col("conv_id") % 5 == 0, F.repeat(F.lit("round and round "), 2000)).otherwise(F.col("text"))
    kept = read(spark, d, "conversations").withColumn("said", said).where(texts_udf.period_udf(F.col("said")) == 0).where("said != ''")
    return kept.groupBy((F.col("conv_id") % 3).alias("variant")).agg(F.count("*").alias("n"), F.median(F.length("said")).alias("median"))


@query("select conv_id, turn, case when turn % 2 = 0 then 'a;bb' else '' end as inside, 'x_y_' || turn as name, 2 * 3 + 2 as width, case when turn % 2 = 0 then '右（原译文有误：左）' else '右' end as note from conversations")
def q_small_texts(spark, d):
    even = F.col("turn") % 2 == 0
    inside = T.bracketed(F.when(even, F.lit("x (a) （bb）()")).otherwise("none (" + "c" * 61 + ")"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(inside, ";").alias("inside"), T.safe_filename(F.concat(F.lit("x/y:"), "turn")).alias("name"), texts_udf.width_udf(F.lit("日本語ab")).cast("bigint").alias("width"), F.when(even, pages.inline_note(F.lit("右"), F.lit("左"))).otherwise("右").alias("note"))


@query("select conv_id, turn, case turn % 5 when 0 then '译' when 1 then '译' when 2 then '译' when 3 then '译文' else '' end || turn as text from conversations")
def q_cleaned_replies(spark, d):
    part = F.col("turn") % 5
    reply = F.when(part == 0, F.concat(F.lit("```json\n{\"translation\": \"译"), "turn", F.lit("\"}\n```"))).when(part == 1, F.concat(F.lit("|TEXT|译"), "turn")).when(part == 2, F.concat(F.lit('{"translation": "译'), "turn", F.lit('", "confidence": 0.9, "notes": []}'))).when(part == 3, F.concat(F.lit("译文"), "turn")).otherwise(F.concat(F.lit(" "), "turn", F.lit(" ")))
    return read(spark, d, "conversations").select("conv_id", "turn", pages._over(references.cleaned, "string")(reply).alias("text"))


@query("select conv_id, turn, turn % 3 = 0 as blank, turn % 3 < 2 as note, case turn % 3 when 0 then '第二句。' when 1 then '第二句。' else '第二' end as widened from conversations")
def q_line_kinds(spark, d):
    part = F.col("turn") % 3
    line = F.when(part == 0, "——==＊＊").when(part == 1, "a-b").otherwise("…x")
    after = F.when(part == 0, "題名、かな（注）").when(part == 1, "かな 《訳》").otherwise("かな。（注）")
    whole = F.when(part == 2, "第一句" + "长" * 20 + "第二" + "句" * 30).otherwise("第一句。第二句。第三句。")
    start = F.when(part == 2, 23).otherwise(4)
    blank = pages._over(references.blank_like, "boolean")
    note = pages._over(lambda text: references.note_follows(text, 0), "boolean")
    wide = pages._over(lambda text, at: references.to_sentence(text, int(at), int(at) + 2), "string")
    return read(spark, d, "conversations").select("conv_id", "turn", blank(line).alias("blank"), note(after).alias("note"), wide(whole, start).alias("widened"))


@query("select conv_id, turn, regexp_matches(text, '[ぁ-ヿ一-鿿]') as cjk, turn % 4 as japanese, case when turn % 2 = 0 then 5.0 else 300.0 end as wall from conversations")
def q_language_predicates(spark, d):
    from . import model

    planted = F.concat(F.lit("ab漢"), F.repeat(F.lit("か"), (F.col("turn") % 4).cast("int")))
    tag = F.when(F.col("turn") % 2 == 0, F.lit("qa_x_1")).otherwise("term")
    return read(spark, d, "conversations").select("conv_id", "turn", F.col("text").rlike("[ぁ-ヿ一-鿿]").alias("cjk"), F.regexp_count(planted, F.lit("[ぁ-ヿ]")).cast("bigint").alias("japanese"), model.wall_cap(tag, {"qa": 5}, 300).cast("double").alias("wall"))


@query(f"select id, md5('[[P0]]' || src || '[[P2]]') as digest from {PAIRS}")
def q_placeholder_restore(spark, d):
    source = F.concat(F.lit("[[P0]] x [[P1]] y[[P2]]"))
    said = quality.restore_placeholders(source, F.concat("src", F.lit("[[P1]]")))
    return pairs(spark, d).select("id", F.md5(F.replace(said, F.lit("[[P1]]"), F.lit(""))).alias("digest"))


@query(f"select id, case id % 4 when 0 then src when 1 then src when 2 then 'a \"b\" c' end as translation from {PAIRS}")
def q_tolerant_json(spark, d):
    body = F.to_json(F.struct(F.col("src").alias("translation")))
    part = F.col("id") % 4
    reply = F.when(part == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(part == 1, F.concat(F.lit("so: "), body, F.lit(" done"))).when(part == 2, F.lit('{"translation": "a "b" c", "notes": ["x", "confidence": 1}')).otherwise("nothing")
    return pairs(spark, d).select("id", F.get_json_object(texts_udf.json_udf(reply), "$.translation").alias("translation"))


@query(f"select src, count, pages from {_CAPS} order by count desc, pages desc, src limit 50")
def q_top_terms(spark, d):
    return mining.runs(read(spark, d, "documents")).select("src", "count", "pages").orderBy(F.desc("count"), F.desc("pages"), "src").limit(50)


@query("select user_id, string_agg(event_id::varchar, ',' order by event_id) as notes from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 10 group by user_id")
def q_last_notes(spark, d):
    rows = quality.last_rows(read(spark, d, "events"), "user_id", [F.desc("event_id")], 10)
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("notes"))


@query(f"select md5(left(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), 200)) as digest, doc_id * 1000003 % 97 as k, doc_id from documents where (doc_id % 2 = 0) <> (doc_id % 3 = 0)")
def q_trial_sets(spark, d):
    # In one of two sets, not in both: union less intersection.
    docs = read(spark, d, "documents")
    a, c = docs.where("doc_id % 2 = 0").select("doc_id"), docs.where("doc_id % 3 = 0").select("doc_id")
    one = a.union(c).distinct().exceptAll(a.intersect(c))
    return docs.join(one, "doc_id", "left_semi").select(F.md5(F.left(T.normalize_ws(F.col("text")), F.lit(200))).alias("digest"), (F.col("doc_id") * 1000003 % 97).alias("k"), "doc_id")
