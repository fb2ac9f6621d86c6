"""The named queries over the tables and, beside each, the same query in plain SQL.

Tables stand in for the data model: a page is a row of ``pages`` or a document, a segment a line of it, a version an event,
a source and its translation two turns of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, html, texts_udf
from ..functions import text as T
from ..operators import containment, graph, memory, mining, quality, sequences, similarity, stats, versions
from ..sources import files
from ..streaming import events as stream
from . import model

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import flow, linked  # noqa: F401  they add their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import flow, linked  # noqa: F401

    return dict(_ORACLE)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def b(column: str, name: str | None = None):
    return F.col(column).cast("bigint").alias(name or column)


# ---- SQL fragments used by several oracles -------------------------------------------------------------------------

WS = r"[ \t\n\r\f\x0B\x{00a0}\x{3000}]"
HREFS = """(select page_id, list_filter(list_distinct_ordered, lambda h: h <> '') as hrefs from (
  select page_id, list_transform(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), lambda h: not regexp_matches(h, '(?i)^([a-z][a-z0-9+.-]*:|#|//)')), lambda h: regexp_replace(h, '[#?].*$', '')) as list_distinct_ordered from pages))"""
LINKS = f"(select distinct page_id, href from {HREFS}, unnest(hrefs) as u(href))"
LEN = f"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '{WS}+', '', 'g'))"
TITLE = f"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g'), '{WS}+', ' ', 'g'), ' ')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
VOLUME = "coalesce(try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint), 0)"
PAIRS = "(select u.conv_id * 1000 + u.turn as id, u.text as src, a.text as dst, u.conv_id as page from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (document * 100000 + line), page, line, text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select((F.col("page") * 100000 + F.col("line")).alias("id"), "page", F.col("line").cast("bigint").alias("line"), "text")


SQL_LINES = "(select doc_id * 100000 + i - 1 as id, doc_id as page, i - 1 as line, l[i] as text from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as r(i))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, dst, page: a user's turn and the answer to it. One window a conversation, no self-join."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    nxt = lambda c: F.lead(c).over(turns)
    found = read(spark, sf_dir, "conversations").withColumns({"n_turn": nxt("turn"), "n_role": nxt("role"), "n_text": nxt("text")})
    found = found.where("role = 'user' and n_role = 'assistant' and n_turn = turn + 1")
    return found.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("src"), F.col("n_text").alias("dst"), F.col("conv_id").alias("page"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("op"), "value")


SQL_HISTORY = "(select user_id as key, event_id as version, event_type as op, value from events)"


# ---- pages ---------------------------------------------------------------------------------------------------------


@query(f"select page_id, {TITLE} as title from pages")
def q_page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"select page_id, {LEN} as text_len from pages")
def q_page_text_len(spark, d):
    return read(spark, d, "pages").select("page_id", T.text_length(F.col("html")).cast("bigint").alias("text_len"))


@query("select page_id, length(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' ')) as n, md5(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' ')) as digest from pages")
def q_page_detag(spark, d):
    bare = T.detag(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.length(bare).cast("bigint").alias("n"), F.md5(bare).alias("digest"))


@query(f"select page_id, href from {LINKS}")
def q_page_links(spark, d):
    return graph.edges(read(spark, d, "pages")).select("page_id", "href")


@query("select page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1), lambda h: regexp_matches(h, '(?i)^https?://')))), '|') as links from pages")
def q_page_links_external(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(html.external_links(F.col("html")), "|").alias("links"))


@query(f"select page_id, {HOST} as host, regexp_extract({PATH}, '^/([^/]+)/', 1) as section, {VOLUME} as volume, case when regexp_matches({PATH}, '(?i)\\.html?$') then 'static' when regexp_matches({PATH}, '/$') then 'index' else 'other' end as kind from pages")
def q_page_class(spark, d):
    path = html.path(F.col("url"))
    kind = F.when(path.rlike(r"(?i)\.html?$"), "static").when(path.rlike("/$"), "index").otherwise("other")
    return read(spark, d, "pages").select("page_id", html.host(F.col("url")).alias("host"), F.regexp_extract(path, "^/([^/]+)/", 1).alias("section"), F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint"), F.lit(0)).alias("volume"), kind.alias("kind"))


@query("select page_id, nullif(lower(regexp_extract(html, '(?i)<meta[^>]*charset=[\"'']?([A-Za-z0-9_-]+)', 1)), '') as charset from pages")
def q_charset_declared(spark, d):
    return read(spark, d, "pages").select("page_id", html.declared_charset(F.col("html")).alias("charset"))


@query("select page_id, md5(case when page_id % 2 = 0 then html else regexp_replace(regexp_replace(html, '(?i)<meta[^>]*>', ''), '(?is)^(.*?<head[^>]*>)', '\\1<meta charset=\"utf-8\">') end) as digest from pages")
def q_charset_fixup(spark, d):
    source = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "(?i)^(.*?)<meta[^>]*>", "$1"))
    return read(spark, d, "pages").select("page_id", F.md5(html.ensure_charset(source)).alias("digest"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0 + (day(o_orderdate) - 1) / 365.0, 6) as year, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as day from orders")
def q_date_candidates(spark, d):
    # The same day in three written forms, one a row.
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "'on 'yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy/M/d' x'")).otherwise(F.date_format(day, "'d 'yy.M.d"))
    return graph.date_numbers(read(spark, d, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey", "date", "year", "day")


@query("select page_id, case page_id % 4 when 0 then null when 3 then '2001-03-01' else strftime(date '1999-01-05' + cast(page_id % 20000 as integer), '%Y-%m-%d') end as date from pages")
def q_comment_dates(spark, d):
    # Dates in four written forms behind a page's own comment, and one in the text that must not count.
    day = F.date_add(F.lit("1999-01-05").cast("date"), (F.col("page_id") % 20000).cast("int"))
    said = F.when(F.col("page_id") % 4 == 0, "none").when(F.col("page_id") % 4 == 1, F.date_format(day, "'on 'yyyy年M月d日")).when(F.col("page_id") % 4 == 2, F.date_format(day, "yyyy/MM/dd")).otherwise("2001.3月")
    source = F.concat(F.lit("1990-01-01<!--first-->"), F.regexp_replace("html", "(?s)<!--.*?-->", ""), F.lit("<!-- up "), said, F.lit(" --><!--1980-02-02-->"))
    return read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, dates.comment_date(source)).alias("date"))


@query(f"select href, count(*) as in_degree from {LINKS} group by href")
def q_in_degree(spark, d):
    return graph.in_degree(graph.edges(read(spark, d, "pages")))


@query(f"select page_id, href, min(i) as pos from (select page_id, hrefs[i] as href, i from {HREFS}, unnest(range(1, len(hrefs) + 1)) as r(i)) group by 1, 2")
def q_nav_position(spark, d):
    found = F.filter(html.hrefs(F.col("html")), lambda h: ~h.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|#|//)"))
    bare = F.transform(found, lambda h: F.regexp_replace(h, r"[#?].*$", ""))
    each = read(spark, d, "pages").select("page_id", F.posexplode(bare).alias("i", "href")).where("href != ''")
    return each.groupBy("page_id", "href").agg((F.min("i") + 1).cast("bigint").alias("pos"))


@query(f"""with recursive e as (select 'p' || page_id as src, href as dst from {LINKS} union all select href, 'p' || page_id from {LINKS}),
w(node, depth) as (select 'p' || min(page_id), 0 from pages union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 60)
select node, cast(min(depth) as bigint) as depth from w group by node""")
def q_bfs_depth(spark, d):
    links = graph.edges(read(spark, d, "pages")).select(F.concat(F.lit("p"), "page_id").alias("p"), "href")
    both = links.select(F.col("p").alias("src"), F.col("href").alias("dst")).unionByName(links.select(F.col("href").alias("src"), F.col("p").alias("dst")))
    root = read(spark, d, "pages").agg(F.concat(F.lit("p"), F.min("page_id")).alias("node"))
    return graph.bfs_depth(both, root).select("node", b("depth"))


@query(f"""with l as (select distinct {HOST} as dir, page_id, href from pages join {LINKS} using (page_id)), n as (select dir, count(distinct href) as n from l group by dir),
c as (select dir, page_id, count(distinct href) as linked from l group by all), s as (select dir, page_id, linked / greatest(1, n - 1) as coverage from c join n using (dir))
select dir, page_id, round(coverage, 6) as coverage from (select *, row_number() over (partition by dir order by coverage desc, page_id) as k from s) where k = 1 and coverage >= 0.3""")
def q_directory_index(spark, d):
    pages = read(spark, d, "pages")
    links = graph.edges(pages).join(pages.select("page_id", html.host(F.col("url")).alias("dir")), "page_id").select("dir", "page_id", "href")
    return graph.directory_index(links, links.select("dir", "href").distinct(), 0.3).select("dir", "page_id", F.round("coverage", 6).alias("coverage"))


_PLAN = f"""with l as (select * from {LINKS}), deg as (select href, count(*) as n from l group by href), heat as (select page_id, sum(n) as hot from l join deg using (href) group by page_id),
f as (select page_id, {TITLE} as title, cast({LEN} as double) as len, cast(coalesce(hot, 0) as double) as hotness, cast({VOLUME} as double) as volume, cast(9999 - len(string_split({PATH}, '/')) as double) as semantic from pages left join heat using (page_id)),
s as (select page_id, title, %s from f),
t as (select page_id, title, round(0.0 + len * 0.4 + hotness * 0.3 + volume * 0.2 + semantic * 0.1, 6) as total from s)
select page_id, title, total, row_number() over (order by total desc, page_id) as rank from t"""
_SHARE = "case when max({0}) over () = min({0}) over () then 0.5 else {1}({0} - min({0}) over ()) / (max({0}) over () - min({0}) over ()) end as {0}"


@query(_PLAN % ", ".join(_SHARE.format(c, "") for c in ("len", "hotness", "volume", "semantic")))
def q_page_plan(spark, d):
    return graph.ranked(graph.plan(read(spark, d, "pages")))


@query(_PLAN % ", ".join(_SHARE.format(c, "1 - " if c in ("len", "volume") else "") for c in ("len", "hotness", "volume", "semantic")))
def q_page_plan_reverse(spark, d):
    return graph.ranked(graph.plan(read(spark, d, "pages"), reverse=frozenset(("len", "volume"))))


@query(f"with p as ({_PLAN % ', '.join(_SHARE.format(c, '') for c in ('len', 'hotness', 'volume', 'semantic'))}) select page_id, coalesce(array_to_string(list(cast(page_id as varchar)) over (order by rank rows between 5 preceding and 1 preceding), '|'), '') as before from p")
def q_plan_predecessors(spark, d):
    return graph.predecessors(graph.ranked(graph.plan(read(spark, d, "pages"))))


@query(f"with p as ({_PLAN % ', '.join(_SHARE.format(c, '') for c in ('len', 'hotness', 'volume', 'semantic'))}) select page_id, rank from p where page_id % 3 > 0 and rank between 10 and 40")
def q_page_scope(spark, d):
    done = read(spark, d, "pages").where("page_id % 3 > 0").select("page_id")
    return graph.ranked(graph.plan(read(spark, d, "pages"))).where("rank between 10 and 40").join(done, "page_id", "left_semi").select("page_id", "rank")


@query("select lang, source, count(*) as n from documents group by all")
def q_section_counts(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(f"""with s as (select page_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style).*?</(script|style)>', '', 'g'), '(?is)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|footer|table|tr|td|body|head|title|html|section)(?:\\s[^>]*)?>|<![^>]*>|<meta[^>]*>'), lambda p: trim(regexp_replace(p, '{WS}+', ' ', 'g'), ' ')), lambda p: length(regexp_replace(p, '(?s)<[^>]*>', '', 'g')) > 0)) as segment from pages)
select page_id, segment, count(*) as n from s group by all""")
def q_html_segments(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(html.block_segments(F.col("html"))).alias("segment")).groupBy("page_id", "segment").agg(F.count("*").alias("n"))


# ---- terms ---------------------------------------------------------------------------------------------------------

_RUNS = "(select src, count(*) as count, count(distinct doc_id) as pages from (select doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)*')) as src from documents) where length(src) >= 2 group by src)"
_REPEATS = f"(select src, count(*) as count, count(distinct doc_id) as pages from (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '{WS}+', '', 'g') as src from documents) where length(src) between 2 and 60 and regexp_matches(src, '[A-Za-z]') group by src)"
_MERGED = f"(select arg_max(src, (contains(src, ' '), count, pages, src)) as src, max(count) as count, max(pages) as pages from (select src, max(count) as count, max(pages) as pages from (select * from {_RUNS} union all select * from {_REPEATS}) where length(src) <= 60 group by src) group by lower(regexp_replace(src, '{WS}+', '', 'g')))"


@query(f"select src, count, pages from {_RUNS} where count >= 7 and pages >= 2")
def q_terms_runs(spark, d):
    return mining.band(mining.runs(read(spark, d, "documents")), 7)


@query(f"select src, count, pages from {_REPEATS} where count >= 2")
def q_terms_repeat_lines(spark, d):
    return mining.repeat_lines(read(spark, d, "documents")).where("count >= 2")


@query(f"select * from {_MERGED} where count >= 7 and pages >= 2")
def q_terms_merge(spark, d):
    docs = read(spark, d, "documents")
    return mining.band(mining.merge_terms(mining.runs(docs), mining.repeat_lines(docs)), 7)


@query(f"select src, count, pages from {_RUNS} where count >= 3 and count < 7 and pages >= 2")
def q_terms_band(spark, d):
    return mining.band(mining.runs(read(spark, d, "documents")), 3, 7)


@query(f"with t as (select src, count, pages from {_RUNS} where count >= 5 and pages >= 2) select * from t where not exists (select 1 from t o where o.src <> t.src and contains(' ' || o.src || ' ', ' ' || t.src || ' '))")
def q_terms_maximal(spark, d):
    return mining.maximal(mining.band(mining.runs(read(spark, d, "documents")), 5))


@query("""with r as (select unnest(regexp_extract_all(text, '[a-z]+')) as run from documents), u as (select run, count(*) as times from r where length(run) > 1 group by run),
p as (select run[i] as a, run[i + 1] as b, times from u, unnest(range(1, length(run))) as x(i)), c as (select a, b, cast(sum(times) as bigint) as count from p group by all)
select a, b, count, round(log2(count::double * (select sum(count) from c) / ((select sum(count) from c x where x.a = c.a)::double * (select sum(count) from c x where x.b = c.b))), 6) as pmi from c where count >= 4""")
def q_terms_pmi(spark, d):
    return mining.pmi(read(spark, d, "documents"))


@query("""with u as (select run, count(*) as times from (select unnest(regexp_extract_all(text, '[a-z]+')) as run from documents) group by run),
g as (select run[i : i + n - 1] as src, case when i > 1 then run[i - 1] else '^' end as l, case when i + n <= length(run) then run[i + n] else '^' end as r, times from u, (values (2), (3)) as s(n), unnest(range(1, length(run) - n + 2)) as x(i) where length(run) >= n),
l as (select src, sum(n) as count, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select src, l, sum(times)::double as n from g group by all) group by src),
r as (select src, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select src, r, sum(times)::double as n from g group by all) group by src)
select src, cast(count as bigint) as count, round(least(l.h, r.h), 6) as entropy from l join r using (src) where count >= 5""")
def q_terms_entropy(spark, d):
    return mining.boundary_entropy(read(spark, d, "documents"))


_WORDS = ", ".join(f"lead(word, {i}) over w as w{i}" for i in range(1, 6))
_GRAMS = " union all ".join("select concat_ws(' ', word{}) as src, {} as n from w where w{} is not null".format("".join(f", w{i}" for i in range(1, n)), n, n - 1) for n in range(1, 7))


@query(f"""with u as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) as i from documents),
w as (select word, word as w0, {_WORDS} from u window w as (partition by doc_id order by i)), g as (select src, n, count(*) as count from ({_GRAMS}) group by all having count(*) >= 3),
c as (select distinct o.src as holder, o.count as f, array_to_string(t[i : i + n - 1], ' ') as src from (select src, count, n as big, string_split(src, ' ') as t from g where n > 1) o, (values (1), (2), (3), (4), (5)) as s(n), unnest(range(1, big - n + 2)) as r(i) where n < big),
m as (select src, avg(f) as mean from c group by src)
select g.src, count, round(log2(n + 1) * (count - coalesce(mean, 0)), 6) as value from g left join m on m.src = g.src""")
def q_terms_cvalue(spark, d):
    return mining.c_value(read(spark, d, "documents"))


@query()
def q_terms_bpe(spark, d):
    return mining.byte_pairs(read(spark, d, "documents"), 20)


@query(f"""with t as (select src from {_RUNS} where count >= 40 and pages >= 2)
select src, doc_id, context from (select src, doc_id, translate(substring(text, greatest(1, instr(text, src) - 20), length(src) + least(20, instr(text, src) - 1) + 20), chr(10), ' ') as context, row_number() over (partition by src order by doc_id) as n from t, documents where contains(text, src)) where n <= 3""")
def q_term_contexts(spark, d):
    docs = read(spark, d, "documents")
    return mining.contexts(docs, mining.band(mining.runs(docs), 40))


# ---- similarity ----------------------------------------------------------------------------------------------------


def _items(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


_GRAM = "list_distinct(case when length(x) >= 2 then list_transform(range(1, length(x)), lambda i: x[i : i + 1]) when length(x) > 0 then [x] else [] end)"
_BARE = "regexp_replace(lower(text), '[\\s[:punct:]\\x{3000}]+', '', 'g')"


@query(f"""with a as (select item_id as id, {_GRAM} as g from (select item_id, {_BARE} as x from benchmark)), t as (select id, {_GRAM} as g from (select id, {_BARE} as x from {SQL_LINES}))
select a.id as l_id, t.id as r_id, round(2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)), 3) as score from a, t where len(a.g) > 0 and len(t.g) > 0 and 2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) >= 0.8""")
def q_dice_pairs(spark, d):
    return similarity.dice_pairs(_items(spark, d), lines(spark, d).select("id", "text"), 0.8)


@query(f"""with a as (select item_id as id, {_GRAM} as g from (select item_id, {_BARE} as x from benchmark)), t as (select id, {_GRAM} as g from (select id, {_BARE} as x from {SQL_LINES})),
s as (select a.id as l_id, t.id as r_id, round(2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)), 3) as score from a, t where len(a.g) > 0 and len(t.g) > 0 and 2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) >= 0.9)
select * from (select l_id, r_id, score, row_number() over (partition by l_id order by score desc, r_id) as rank from s) where rank <= 5""")
def q_memory_lookup(spark, d):
    return similarity.top_k(similarity.dice_pairs(_items(spark, d), lines(spark, d).select("id", "text"), 0.9, k=5), 5, "l_id", "score", "r_id")


@query(f"with t as (select id, regexp_replace(src, '[^ -~]', '', 'g') as x, regexp_replace(dst, '[^ -~]', '', 'g') as y from {PAIRS}) select id, case when greatest(length(x), length(y)) = 0 then 1.0 else round(1.0 - levenshtein(x, y) / greatest(length(x), length(y))::double, 6) end as score from t")
def q_edit_similarity(spark, d):
    bare = lambda c: F.regexp_replace(c, "[^ -~]", "")  # noqa: E731  SQL's levenshtein counts bytes
    return pairs(spark, d).select("id", F.round(T.edit_similarity(bare("src"), bare("dst")), 6).alias("score"))


@query("select i.item_id, d.doc_id from benchmark i, documents d where instr(lower(d.text), lower(i.text)) > 0")
def q_locate_exact(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    items = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("src"))
    found = containment.occurrences(items, docs).select(F.col("id").alias("doc_id"), F.col("term").alias("src"))
    return found.join(items, "src").select("item_id", "doc_id").distinct()


_LOCATE = f"""with q as (select conv_id * 100 + turn as id, case turn % 4 when 0 then text when 1 then '[[P1]]' || text when 2 then 'no such line' || chr(10) || text else substring(text, 3, length(text) - 5) || 'q' end as text from conversations),
t as (select conv_id * 100 + turn as id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') as text from conversations),
n as (select id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') as src, trim(regexp_replace(regexp_replace(text, '\\[\\[P[0-9]+\\]\\]', '', 'g'), '{WS}+', ' ', 'g'), ' ') as bare, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda l: trim(regexp_replace(l, '{WS}+', ' ', 'g'), ' ')), lambda l: l <> '') as lines from q),
h as (select n.id as q_id, t.id, 1 as tier from n, t where src <> '' and contains(t.text, src) union all select n.id, t.id, 2 from n, t where bare <> '' and contains(t.text, bare) union all select distinct n.id, t.id, 3 from n, unnest(n.lines) as u(l), t where len(n.lines) > 1 and contains(t.text, l)),
r as (select id as q_id, list_distinct(list_transform(range(1, greatest(2, length(b))), lambda i: b[i : i + 1])) as g from (select id, regexp_replace(lower(bare), '[\\s[:punct:]]+', '', 'g') as b from n where id not in (select q_id from h))),
g as (select id, list_distinct(list_transform(range(1, greatest(2, length(b))), lambda i: b[i : i + 1])) as g from (select id, regexp_replace(lower(text), '[\\s[:punct:]]+', '', 'g') as b from t)),
f as (select q_id, id, 2.0 * len(list_intersect(r.g, g.g)) / (len(r.g) + len(g.g)) as s from r, g),
e as (select q_id, id, tier, 1.0 as score from h union all select q_id, id, 4, round(s, 3) from (select *, row_number() over (partition by q_id order by round(s, 3) desc, id) as k from f where s >= 0.6) where k <= 5)
select distinct q_id, id, ['exact', 'strip_ph', 'line_split', 'fuzzy'][tier] as method, cast(score as double) as score from e where tier = (select min(tier) from e x where x.q_id = e.q_id)"""


@query(_LOCATE)
def q_locate_tiered(spark, d):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    part = F.col("turn") % 4
    quote = F.when(part == 0, F.col("text")).when(part == 1, F.concat(F.lit("[[P1]]"), "text")).when(part == 2, F.concat(F.lit("no such line\n"), "text")).otherwise(F.concat(F.expr("substring(text, 3, length(text) - 5)"), F.lit("q")))
    return similarity.locate(turns.select("id", quote.alias("text")), turns.select("id", "text"))


@query(f"""with g as (select src from {_RUNS} where count >= 30 and pages >= 2), t as (select doc_id as id, lower(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) as text from documents), h as (select t.id, g.src, (length(t.text) - length(replace(t.text, lower(g.src), ''))) // length(g.src) * length(g.src) as score from g, t where contains(t.text, lower(g.src)))
select id, src, cast(score as bigint) as score, rank from (select *, row_number() over (partition by id order by score desc, src) as rank from h) where rank <= 30""")
def q_glossary_relevance(spark, d):
    docs = read(spark, d, "documents")
    terms = mining.band(mining.runs(docs), 30)
    return similarity.relevance(terms, docs.select(F.col("doc_id").alias("id"), "text"))


@query(f"""with t as (select id, trim(regexp_replace(src, '{WS}+', ' ', 'g'), ' ') as norm from {PAIRS}), g as (select norm as src, 'g' || min(id) as dst from t where id % 3 = 0 group by norm), p as (select norm as key, 'p' || min(id) as dst from t where length(norm) <= 60 group by norm)
select t.id, coalesce(g.dst, p.dst) as answer, case when g.dst is not null then 'glossary' when p.dst is not null then 'phrase' else 'model' end as origin from t left join g on g.src = t.norm left join p on p.key = t.norm""")
def q_dictionary_cascade(spark, d):
    texts = pairs(spark, d).select("id", F.col("src").alias("text"))
    norm = texts.select("id", T.normalize_ws(F.col("text")).alias("norm"))
    glossary = norm.where("id % 3 = 0").groupBy("norm").agg(F.min("id").alias("seq")).select(F.col("norm").alias("src"), F.concat(F.lit("g"), "seq").alias("dst"), "seq", F.lit(True).alias("read_only"))
    phrases = norm.where("length(norm) <= 60").groupBy("norm").agg(F.min("id").alias("m")).select(F.col("norm").alias("key"), F.concat(F.lit("p"), "m").alias("dst"))
    return similarity.cascade(texts, glossary, phrases, 60)


# ---- memories and queues -------------------------------------------------------------------------------------------


def _keyed_lines(spark, d):
    return lines(spark, d).select(F.col("id").alias("seq"), F.col("text").alias("src"), F.concat(F.lit("»"), "text").alias("dst"), "page")


@query(f"""with c as (select id as seq, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') as key, text as src, '»' || text as dst, page from {SQL_LINES}), n as (select key, arg_max(dst, seq) as dst, arg_max(page, seq) as page, count(*) as usage from c where page % 5 <> 0 group by key),
o as (select key, arg_max(dst, seq) as dst, arg_max(page, seq) as page, count(*) as usage from c where page % 5 = 0 group by key)
select md5(key) as key, md5(coalesce(n.dst, o.dst)) as dst, coalesce(n.page, o.page) as page, coalesce(o.usage, 0) + coalesce(n.usage, 0) as usage from o full join n using (key)""")
def q_memory_upsert(spark, d):
    every = _keyed_lines(spark, d)
    old = memory.upsert(spark.createDataFrame([], "key string, dst string, page bigint, usage bigint"), every.where("page % 5 = 0"))
    return memory.upsert(old, every.where("page % 5 != 0")).select(F.md5("key").alias("key"), F.md5("dst").alias("dst"), "page", "usage")


@query(f"with q as (select 'qa_' || left(md5(text), 12) as id, id as seq, page from {SQL_LINES}), o as (select id, min(seq) as seq from q where page % 4 = 0 group by id), n as (select id, min(seq) as seq from q where page % 4 <> 0 and id not in (select id from o) group by id) select id, seq, 'open' as status from o union all select id, seq, 'new' from n")
def q_queue_append(spark, d):
    every = lines(spark, d).select(T.hash_id(F.col("text")).alias("id"), F.col("id").alias("seq"), "page")
    old = every.where("page % 4 = 0").groupBy("id").agg(F.min("seq").alias("seq")).withColumn("status", F.lit("open"))
    return memory.append_new(old, every.where("page % 4 != 0").select("id", "seq", F.lit("new").alias("status")))


@query(f"""with l as (select id as seq, lower(trim(text, ' ')) as src, text as dst, page from {SQL_LINES} where length(text) between 1 and 60), g as (select src, arg_max(dst, seq) as dst from l where page % 2 = 0 group by src), n as (select src, arg_max(dst, seq) as dst from l where page % 2 = 1 and src <> '' group by src)
select src, coalesce(g.dst, n.dst) as dst, case when n.dst is null then 'kept' when g.dst is null then 'added' when g.dst = n.dst then 'updated' else 'conflict' end as action from g full join n using (src)""")
def q_glossary_merge(spark, d):
    every = lines(spark, d).where("length(text) between 1 and 60").select(F.lower(F.trim("text")).alias("src"), F.col("text").alias("dst"), F.col("id").alias("seq"), "page")
    return memory.merge_glossary(every.where("page % 2 = 0").groupBy("src").agg(F.max_by("dst", "seq").alias("dst")), every.where("page % 2 = 1"))


@query(f"select id from {PAIRS} where not (contains(src, 'the') and not contains(dst, 'that'))")
def q_purge_term(spark, d):
    return memory.purge_term(pairs(spark, d), "the", "that").select("id")


@query(f"select id from {PAIRS} where not contains(dst, 'thing') and not contains(dst, 'mente')")
def q_purge_keywords(spark, d):
    return memory.purge_keywords(pairs(spark, d), ["thing", "mente"]).select("id")


@query(f"select id, page from {PAIRS} where page % 7 <> 0")
def q_purge_segments(spark, d):
    every = pairs(spark, d).select("id", F.col("page").cast("string").alias("page"))
    gone = every.where("cast(page as bigint) % 7 = 0").select("id", "page")
    return memory.purge_keys(every, gone, ["id", "page"]).select("id", F.col("page").cast("bigint").alias("page"))


@query(f"""with t as (select src, row_number() over (order by src) as seq from {_RUNS} where count >= 4) select arg_max(src, (contains(src, ' '), -seq)) as src, arg_max(case when seq % 2 = 0 then upper(src) end, (case when seq % 2 = 0 then 1 else 0 end, contains(src, ' '), -seq)) as dst from t group by lower(regexp_replace(src, '{WS}+', '', 'g'))""")
def q_reviewed_dedup(spark, d):
    terms = graph.numbered(mining.runs(read(spark, d, "documents")).where("count >= 4"), [F.col("src")], "seq")
    return memory.dedup_reviewed(terms.select("src", "seq", F.when(F.col("seq") % 2 == 0, F.upper("src")).alias("dst"), F.lit("x").alias("category"))).select("src", "dst")


# ---- quality -------------------------------------------------------------------------------------------------------


@query(f"select id, (length(src) - length(replace(src, 'the', ''))) // 3 as src_n, (length(dst) - length(replace(dst, 'the', ''))) // 3 as dst_n from {PAIRS} where (length(src) - length(replace(src, 'the', ''))) // 3 <> (length(dst) - length(replace(dst, 'the', ''))) // 3")
def q_placeholder_rule(spark, d):
    return quality.placeholder_rule(pairs(spark, d), "the")


@query(f"""with s as (select id, token, count(*) as n from (select id, unnest(regexp_extract_all(src, '[A-Z][a-z]')) as token from {PAIRS}) group by all), t as (select id, token, count(*) as n from (select id, unnest(regexp_extract_all(dst, '[A-Z][a-z]')) as token from {PAIRS}) group by all),
b as (select id, token, coalesce(s.n, 0) as a, coalesce(t.n, 0) as b from s full join t using (id, token))
select id, coalesce(string_agg(token, '|' order by token) filter (b = 0), '') as missing, coalesce(string_agg(token, '|' order by token) filter (a = 0), '') as extra, coalesce(string_agg(token, '|' order by token) filter (a > 0 and b > a), '') as repeated from b where a <> b group by id""")
def q_placeholder_multiset(spark, d):
    return quality.token_differences(pairs(spark, d), "[A-Z][a-z]")


@query("""with p as (select * from """ + PAIRS + """), g as (select distinct unnest(regexp_extract_all(src, '[A-Z][a-z]+')) as src from p)
select p.id, g.src, g.src[1:2] as dst from p, g where contains(p.src, g.src) and not contains(p.dst, g.src[1:2])""")
def q_term_rule(spark, d):
    two = pairs(spark, d)
    terms = two.select(F.explode(F.regexp_extract_all("src", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("src")).distinct().withColumn("dst", F.left("src", F.lit(2)))
    return quality.term_rule(two, terms)


def _issues(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select(F.col("source").alias("page"), "lang", F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "mid").otherwise("low").alias("severity"), F.when(F.col("doc_id") % 3 > 0, F.col("quality") == 1).alias("resolved"))


_ISSUES = "(select source as page, lang, case when toxic = 1 then 'high' when quality = 0 then 'mid' else 'low' end as severity, case when doc_id % 3 > 0 then quality = 1 end as resolved from labels join documents using (doc_id))"


@query(f"select page, count(*) as total, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'mid') as mid, count(*) filter (severity = 'low') as low, count(*) filter (not coalesce(resolved, true)) as unresolved from {_ISSUES} group by page")
def q_severity_counts(spark, d):
    return quality.severity_counts(_issues(spark, d))


@query(f"select page, lang, count(*) as total, count(*) filter (severity = 'high') as high from {_ISSUES} group by rollup(page, lang)")
def q_report_rollup(spark, d):
    return quality.report_rollup(_issues(spark, d), ["page", "lang"])


@query(f"select id, case when regexp_matches(src, 'thing') then 'A' when regexp_matches(src, '[áéíóú]') then 'B' when regexp_matches(src, '[0-9]') then 'C' else '?' end as category from {PAIRS}")
def q_categories(spark, d):
    return pairs(spark, d).select("id", quality.categories(F.col("src"), [("A", "thing"), ("B", "[áéíóú]"), ("C", "[0-9]")]).alias("category"))


@query("select user_id as page, cast(segment as bigint) as segment, string_agg(event_type, '|' order by event_id) as opinions from (select *, unnest([event_id % 3, event_id % 5 + 10]) as segment from events) where event_type in ('click', 'view') group by all")
def q_adopted_groups(spark, d):
    items = read(spark, d, "events").select(F.col("user_id").alias("page"), F.array(F.col("event_id") % 3, F.col("event_id") % 5 + 10).alias("segments"), F.col("event_id").alias("id"), F.col("event_type").alias("suggestion"), F.when(F.col("event_type").isin("click", "view"), "adopted").otherwise("open").alias("status"))
    return quality.adopted_groups(items)


@query("""with s as (select event_type as grp, user_id % 4 as run, event_id % 50 as item from events), z as (select grp, run, count(distinct item) as n from s group by all), p as (select a.grp, a.run as a, b.run as b, a.n + b.n as t from z a join z b on a.grp = b.grp and a.run < b.run),
c as (select x.grp, x.run as a, y.run as b, count(*) as c from (select distinct * from s) x join (select distinct * from s) y on x.grp = y.grp and x.item = y.item and x.run < y.run group by all)
select g.grp, round(coalesce(avg(coalesce(c.c, 0) / (t - coalesce(c.c, 0))), 1.0), 6) as stability from (select distinct grp from s) g left join p on p.grp = g.grp left join c on c.grp = p.grp and c.a = p.a and c.b = p.b group by g.grp""")
def q_run_stability(spark, d):
    return quality.jaccard_stability(read(spark, d, "events").select(F.col("event_type").alias("grp"), (F.col("user_id") % 4).alias("run"), (F.col("event_id") % 50).alias("item")))


@query("select user_id as key, arg_max(event_type, event_id) as op, max(event_id) as version from events group by user_id")
def q_latest_status(spark, d):
    return quality.latest(history(spark, d), "key", ["version"]).select("key", "op", "version")


# ---- versions ------------------------------------------------------------------------------------------------------


@query(f"with l as (select key, arg_max(value, version) as now from {SQL_HISTORY} group by key) select key, max(version) as version from {SQL_HISTORY} join l using (key) where value is distinct from now group by key")
def q_previous_version(spark, d):
    return versions.previous_different(history(spark, d))


@query(f"select key, max(version) as version from {SQL_HISTORY} where op <> 'click' and key in (select key from {SQL_HISTORY} where op = 'click') group by key")
def q_before_operation(spark, d):
    return versions.before_operation(history(spark, d), "click")


@query(f"select key, version from (select *, row_number() over (partition by key order by version desc) as n from {SQL_HISTORY}) where n <= 3")
def q_keep_last(spark, d):
    return versions.keep_last(history(spark, d), 3).select("key", "version")


@query(f"select op, min(version) as first, max(version) as last, count(distinct key) as keys, count(*) as versions from {SQL_HISTORY} group by op")
def q_operations(spark, d):
    return versions.operations(history(spark, d))


@query(f"""with n as (select key, arg_max(value, version) as from_value from {SQL_HISTORY} group by key), t as (select key, arg_max(value, version) as to_value from {SQL_HISTORY} where version <= 300 group by key)
select n.key, from_value, to_value, case when t.key is null then 'remove' when from_value is not distinct from to_value then 'same' else 'change' end as action from n left join t using (key)""")
def q_restore_plan(spark, d):
    return versions.restore_plan(history(spark, d), 300)


@query("with a as (select user_id as key, max(event_id) % 3 as owner from events where event_type <> 'error' group by user_id), b as (select user_id as key, max(event_id) % 3 as owner from events where event_type <> 'click' and event_id % 10 < 9 group by user_id) select key, case when b.owner is null then 'remove' when a.owner is null then 'add' when a.owner = b.owner then 'keep' else 'collision' end as action from a full join b using (key)")
def q_reconcile(spark, d):
    rows = lambda cond: read(spark, d, "events").where(cond).groupBy(F.col("user_id").alias("key")).agg((F.max("event_id") % 3).alias("owner"))
    return versions.reconcile(rows("event_type != 'error'"), rows("event_type != 'click' and event_id % 10 < 9"))


@query("select user_id as page, count(*) filter (value > 40) as open, case when bool_or(event_id % 50 = 0) then 'pending' when count(*) filter (value > 40) > 0 then 'review' else 'done' end as status from events group by user_id")
def q_page_status(spark, d):
    return versions.page_status(read(spark, d, "events").select(F.col("user_id").alias("page"), (F.col("value") > 40).alias("needs_human"), F.when(F.col("event_id") % 50 != 0, "x").alias("translation")))


@query("select d.doc_id as page, cast(case when d.doc_id % 2 = 0 then d.doc_id // 2 else 2147483647 end as bigint) as rank from documents d where d.doc_id not in (select doc_id from labels)")
def q_unfinished(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("page"))
    return versions.unfinished(docs, read(spark, d, "labels").select(F.col("doc_id").alias("page")), docs.where("page % 2 = 0").select("page", F.floor(F.col("page") / 2).alias("rank")))


@query("with s as (select user_id as key, arg_max(case when event_type <> 'error' then event_type end, event_id) as x, bool_or(true) as k from events where user_id % 2 = 0 group by user_id), l as (select user_id as key, max(event_id)::varchar as c from events group by user_id) select key, case when k then arg else c end as translation from (select l.key, s.k, (select case when event_type <> 'error' then event_type end from events e where e.user_id = l.key order by event_id desc limit 1) as arg, c from l left join s using (key))")
def q_current_translation(spark, d):
    ev = read(spark, d, "events")
    last = F.max_by(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("t")), "event_id")
    state = ev.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(last.alias("r")).select("key", F.col("r.t").alias("translation"))
    cache = ev.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").cast("string").alias("translation"))
    return versions.current(state, cache)


# ---- sequences -----------------------------------------------------------------------------------------------------


@query("""with p as (select *, cast(floor(value) as bigint) % 7 as mc from events), q as (select *, last_value(case when mc > 0 then mc end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from p)
select event_id, cast(sum(case when mc > 0 and (before is null or mc <= before) then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as session from q""")
def q_sessions(spark, d):
    rows = read(spark, d, "events").withColumn("mc", F.expr("cast(floor(value) as bigint) % 7"))
    return sequences.sessions(rows, "user_id", "event_id", "mc").select("event_id", b("session"))


@query("select e.event_id, (select max(x.event_id) from events x where x.user_id = e.user_id and x.event_type = 'view' and x.event_id < e.event_id) as before_event_id from events e")
def q_as_of_predecessor(spark, d):
    return sequences.as_of(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view", ["event_id"]).select("event_id", "before_event_id")


@query("select event_id, total from (select event_id, round(sum(value) over w, 4) as total, sum(value) over w as t, row_number() over w as n from events window w as (partition by user_id order by event_id)) where t <= 300 or n = 1")
def q_within_budget(spark, d):
    return sequences.within_budget(read(spark, d, "events"), "user_id", "event_id", "value", 300).select("event_id", F.round("total", 4).alias("total"))


@query("select event_id, (row_number() over (partition by user_id order by event_id) - 1) // 5 as bucket from events")
def q_history_buckets(spark, d):
    return sequences.buckets(read(spark, d, "events"), "user_id", "event_id", 5).select("event_id", b("bucket"))


@query("with r as (select doc_id, row_number() over (order by n_chars desc, doc_id) as place, count(*) over () as n from documents) select doc_id, place from r where place in (select distinct cast(round_even(k * (n - 1) / 9.0, 0) as bigint) + 1 from range(10) as t(k))")
def q_quantile_picks(spark, d):
    return sequences.quantile_picks(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10).select("doc_id", b("place"))


@query("""with t as (select a.conv_id, a.turn, b.turn as o, b.text, 200 - coalesce(sum(length(b.text)) over (partition by a.conv_id, a.turn, b.turn < a.turn order by abs(b.turn - a.turn) rows between unbounded preceding and 1 preceding), 0) as room from conversations a left join conversations b on a.conv_id = b.conv_id and a.turn <> b.turn and length(b.text) > 0)
select conv_id, turn, coalesce(string_agg(right(text, cast(room as bigint)), chr(10) order by o) filter (o < turn and room > 0), '') as before, coalesce(string_agg(left(text, cast(room as bigint)), chr(10) order by o) filter (o > turn and room > 0), '') as after from t group by all""")
def q_adjacent_context(spark, d):
    return sequences.adjacent(read(spark, d, "conversations"), "conv_id", "turn", "text", 200).select("conv_id", "turn", "before", "after")


@query()
def q_chunks(spark, d):
    return sequences.chunks(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", b("chunk"), F.length("text").cast("bigint").alias("n"))


@query()
def q_char_windows(spark, d):
    return sequences.char_windows(lines(spark, d).withColumn("n", F.length("text")), "page", "line", "n", 500, 1)


@query(f"with t as (select conv_id, string_agg('**' || role || '**: ' || trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), chr(10) || chr(10) order by turn) as t from conversations group by conv_id) select conv_id, md5(t) as digest from t")
def q_transcripts(spark, d):
    return model.transcript(read(spark, d, "conversations")).select("conv_id", F.md5("transcript").alias("digest"))


# ---- text expressions ----------------------------------------------------------------------------------------------


@query(f"select doc_id, md5(lower(regexp_replace(text, '{WS}+', '', 'g'))) as key, md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) as norm from documents")
def q_normal_forms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm_key(F.col("text"))).alias("key"), F.md5(T.normalize_ws(F.col("text"))).alias("norm"))


@query("select conv_id, turn, case when regexp_matches(text, '[ぁ-ヿ]') then 'kana' when regexp_matches(text, '[A-Za-z]') then 'latin' when regexp_matches(text, '[一-鿿]') then 'han' else 'other' end as script from conversations")
def q_script_class(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.script_class(F.col("text")).alias("script"))


@query("select conv_id, turn, len(list_filter(regexp_extract_all(text, '[^,;:.!?，。！？；：、]+[,;:.!?，。！？；：、]*'), lambda p: regexp_matches(p, '[\\p{L}\\p{N}]'))) as n from conversations")
def q_clauses(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(T.clauses(F.col("text"))).cast("bigint").alias("n"))


@query("select doc_id, (case when greatest(1, p - 24) > 1 then '…' else '' end) || substring(text, greatest(1, p - 24), least(length(text), p + 27) - greatest(1, p - 24) + 1) || (case when least(length(text), p + 27) < length(text) then '…' else '' end) as excerpt from (select doc_id, text, instr(text, 'tion') as p from documents) where p > 0")
def q_excerpts(spark, d):
    docs = read(spark, d, "documents").withColumn("p", F.instr("text", "tion")).where("p > 0")
    return docs.select("doc_id", T.excerpt(F.col("text"), F.col("p"), F.lit(4)).alias("excerpt"))


@query("select item_id, 'qa_' || left(md5('p|' || item_id || '|' || left(text, 20) || '||x'), 12) as id from benchmark")
def q_hash_ids(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.hash_id(F.lit("p"), F.col("item_id"), F.left("text", F.lit(20)), F.lit(None), F.lit("x")).alias("id"))


@query("select doc_id, case lang when 'en' then 'English' when 'de' then 'Deutsch' else lang end as name from documents")
def q_language_names(spark, d):
    return read(spark, d, "documents").select("doc_id", T.language_name(F.col("lang"), {"en": "English", "de": "Deutsch"}).alias("name"))


@query()
def q_sequence_ratio(spark, d):
    both = pairs(spark, d).select("id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return both.select("id", texts_udf.ratio_udf(F.col("a"), F.col("b")).alias("ratio"), texts_udf.common_udf(F.col("a"), F.col("b")).alias("common"), texts_udf.changes_udf(F.col("a"), F.col("b")).alias("changes"))


@query("select doc_id, length('turn ' || doc_id || ' and ') as period from documents where doc_id % 20 = 0")
def q_repetition(spark, d):
    # Every twentieth document goes round in a loop at its end; no other one repeats itself.
    text = F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.repeat(F.concat(F.lit("turn "), "doc_id", F.lit(" and ")), 2500))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", texts_udf.period_udf(text).cast("bigint").alias("period")).where("period > 0")


# ---- model, logs, statistics, streams ------------------------------------------------------------------------------


@query(f"""with p as (select id, src, 'Terms' || chr(10) || 'a → b' || chr(10) || chr(10) || (case when id % 2 = 0 then 'Context' || chr(10) || dst || chr(10) || chr(10) else '' end) || '|TEXT|' || src as prompt from {PAIRS})
select id, md5(prompt) as prompt, case when id % 5 = 0 then 'known ' || id when id % 5 = 1 then 'not JSON ' || id else src end as translation, case when id % 5 = 1 then 0.1 else 1.0 end::double as confidence, case when id % 5 = 0 then 'glossary' else 'model' end as origin from p""")
def q_mock_translation(spark, d):
    # A fifth is known, a fifth of the replies isn't JSON; all prompts are told apart by their digests.
    two = pairs(spark, d)
    prompts = two.select("id", "src", model.prompt(F.col("src"), F.lit("a → b"), F.when(F.col("id") % 2 == 0, F.col("dst"))).alias("prompt"))
    reply = F.when(F.col("id") % 5 == 1, F.concat(F.lit(" not JSON "), "id")).otherwise(model.mock(F.col("prompt")))
    known = two.where("id % 5 = 0").select("id", F.concat(F.lit("known "), "id").alias("answer"), F.lit("glossary").alias("origin"))
    out = model.settle(prompts.select("id", F.md5("prompt").alias("digest"), reply.alias("reply")), known)
    return out.select("id", F.col("digest").alias("prompt"), "translation", "confidence", "origin")


@query("select event_type as tag, count(*) as calls, cast(sum(event_id % 100) as bigint) as prompt_tokens, cast(sum(user_id) as bigint) as completion_tokens from events group by event_type")
def q_call_usage(spark, d):
    return model.usage(read(spark, d, "events").select(F.col("event_type").alias("tag"), (F.col("event_id") % 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens")))


@query("""select page_id, case page_id % 4 when 0 then '' when 1 then 'GBK,' when 2 then 'x-own,' else 'UTF-8,' end || case page_id % 8
  when 0 then 'cp932,euc_jp,iso2022_jp,utf-8' when 1 then 'gb2312,utf-8' when 2 then 'big5,utf-8' when 3 then 'gbk,big5' when 4 then 'euc_kr,cp949,utf-8' when 5 then 'cp1251,koi8_r,utf-8' when 6 then 'cp1252,iso8859-1,utf-8' else 'cp1252,latin1' end as tried from pages""")
def q_encoding_candidates(spark, d):
    declared = F.element_at(F.array(F.lit(None).cast("string"), F.lit("GBK"), F.lit("x-own"), F.lit("UTF-8")), (F.col("page_id") % 4 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, ["ja", "zh-Hans", "zh-Hant", "zh", "ko", "ru", "en", "xx"])), (F.col("page_id") % 8 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", F.array_join(files.candidates(declared, lang), ",").alias("tried"))


@query("select s_suppkey as rel, case when c_custkey is null then 'missing' else 'differs' end as action from supplier left join customer on c_custkey = s_suppkey and c_custkey % 3 <> 0 where c_custkey is null or c_nationkey <> s_nationkey")
def q_mirror_plan(spark, d):
    source = read(spark, d, "supplier").select(F.col("s_suppkey").alias("rel"), F.col("s_nationkey").alias("size"))
    return files.mirror_plan(source, read(spark, d, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("rel"), F.col("c_nationkey").alias("size")))


@query("with r as (select n_regionkey as g, s_acctbal as v from supplier join nation on n_nationkey = s_nationkey), k as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rank from r), s as (select g, sum(rank) as r, count(*) as n from k group by g) select count(*) as groups, cast(sum(n) as bigint) as n, round(12.0 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1), 6) as h from s")
def q_kruskal(spark, d):
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("s_acctbal").alias("v"))
    return stats.kruskal(rows, "g", "v")


@query("select user_id, round(rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0, 1) as rank, event_id from events")
def q_average_ranks(spark, d):
    return stats.average_ranks(read(spark, d, "events").select("user_id", "event_id", "value"), "value").select("user_id", F.round("rank", 1).alias("rank"), "event_id")


@query()
def q_resampled_medians(spark, d):
    rows = read(spark, d, "customer").withColumn("one", F.col("c_mktsegment") == "BUILDING")
    return stats.resample(rows, "one", "c_acctbal", 200).select(F.round("p", 6).alias("p"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("select event_type, median(value) as median, count(*) as n from events group by event_type")
def q_medians(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median"), F.count("*").alias("n"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def q_tumbling_windows(spark, d):
    return stream.windowed_counts(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as f from events), s as (select user_id, ts, sum(f) over (partition by user_id order by ts, f desc) as k from g) select min(ts) as start, user_id, count(*) as n from s group by user_id, k")
def q_session_windows(spark, d):
    return stream.session_counts(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
