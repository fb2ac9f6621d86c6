"""Named queries over the linkage operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import graph, linkage
from .catalogue import HOST, LINKS, PAIRS, PATH, SQL_LINES, WS, b, lines, pairs, query, read


_TARGET = "(length(href) * 131 + ascii(substr(href, 2)) * 17) % (select count(*) from pages)"


@query(f"""with l as (select distinct page_id as src, {_TARGET} as page from {LINKS}), p as (select page_id as page, string_split(ltrim({PATH}, '/'), '/') as path from pages),
s as (select l.page, l.src as before, len(a.path) + len(p.path) - 2 * coalesce(list_position(list_transform(range(1, least(len(a.path), len(p.path)) + 1), lambda i: a.path[i] <> p.path[i]), true) - 1, least(len(a.path), len(p.path))) as hops, abs(l.src - l.page) as apart from l join p on p.page = l.page join p a on a.page = l.src where a.page % 10 <> 3),
w as (select page, before, 3.0 * least(1, greatest(0, (8 - hops) / 6.0)) + least(1, greatest(0, (128 - apart) / 127.0)) as score from s)
select page, before, round(score, 6) as score from (select *, row_number() over (partition by page order by score desc, before) as n from w) where n <= 3""")
def q_link_predecessors(spark, d):
    # Links of the tables lead outside; each target stands for the page with a number made from it.
    pages = read(spark, d, "pages").select("page_id", F.ltrim(html.path(F.col("url")), F.lit("/")).alias("path"), "html")
    target = (F.length("href") * 131 + F.ascii(F.substr("href", F.lit(2))) * 17) % F.lit(pages.count())
    links = graph.edges(pages).select(F.col("page_id").alias("src"), target.alias("dst"))
    return linkage.link_predecessors(links, pages.select(F.col("page_id").alias("page"), "path", F.col("page_id").alias("rank"), (F.col("page_id") % 10 == 3).alias("is_index")))


@query(f"""with s as (select page_id as id, left(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), 20) as summary from pages), o as (select page_id, {HOST} as host from pages),
f as (select page_id, page_id - 1 as before, 0 as prio, 'plan' as source from o union all select page_id, lag(page_id) over (partition by host order by page_id), 1, 'host' from o),
u as (select page_id, before, arg_min(source, prio) as source, min(prio) as prio from f where before is not null group by all)
select page_id, string_agg(source || ':' || before || ' ' || summary, chr(10) order by prio, before) as pack from u join s on s.id = before where length(summary) > 0 group by page_id""")
def q_context_pack(spark, d):
    from pyspark.sql import Window

    pages = read(spark, d, "pages")
    summaries = pages.select(F.col("page_id").alias("id"), F.left(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1), F.lit(20)).alias("summary"))
    before = F.lag("page_id").over(Window.partitionBy(html.host(F.col("url"))).orderBy("page_id"))
    host = pages.select("page_id", before.alias("before")).where("before is not null")
    return linkage.context_pack([("plan", pages.select("page_id", (F.col("page_id") - 1).alias("before"))), ("host", host)], summaries)


@query(f"""with t as (select item_id as note, list_distinct(list_filter(regexp_split_to_array(lower(text || ' x'), '{WS}+'), lambda w: w <> '')) as h from benchmark), s as (select id, token, count(*) as n from (select id, unnest(list_filter(regexp_split_to_array(lower(src), '{WS}+'), lambda w: w <> '')) as token from {PAIRS}) group by all),
c as (select id, note, cast(sum(n * length(token)) as bigint) as score from s, (select note, unnest(h) as token from t) using (token) group by all)
select id, note, score, rank from (select *, row_number() over (partition by id order by score desc, note) as rank from c) where rank <= 6""".replace(", (select note, unnest(h) as token from t) using (token)", " join (select note, unnest(h) as token from t) using (token)"))
def q_note_relevance(spark, d):
    notes = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"), F.lit("x").alias("summary"))
    return linkage.note_relevance(notes, pairs(spark, d).select("id", F.col("src").alias("text")))


@query("""with r as (select 'r' || event_id as run, epoch(ts) as start, epoch(ts) + value as "end" from events where event_id % 10 = 0), l as (select event_id as log, epoch(ts) as t, case when event_id % 7 = 0 then 'r' || (event_id // 10 * 10) else 'none' end as tag from events),
g as (select log, run, 'tag' as how from l join r on tag = run), m as (select log, arg_max(run, (start, run)) as run from l join r on start <= t and t <= "end" + 2 where log not in (select log from g) group by log) select * from g union all select log, run, 'time' from m""")
def q_log_linkage(spark, d):
    ev = read(spark, d, "events").withColumn("t", F.expr("(unix_micros(cast(ts as timestamp))) / 1000000.0d"))
    runs = ev.where("event_id % 10 = 0").select(F.concat(F.lit("r"), "event_id").alias("run"), F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"))
    tag = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("r"), F.floor(F.col("event_id") / 10) * 10)).otherwise("none")
    return linkage.link_logs(ev.select(F.col("event_id").alias("log"), "t", tag.alias("tag")), runs)


@query("""with m as (select *, event_id * 7 % 11 as page from events), s as (select *, case when lag(page) over w is null or page < lag(page) over w then 1 else 0 end as s from m window w as (partition by user_id order by event_id)), c as (select *, cast(sum(s) over (partition by user_id order by event_id) as bigint) as cycle from s)
select event_id, cycle from (select *, count(*) over (partition by user_id, cycle) as n from c) where n >= 2""")
def q_cycles(spark, d):
    rows = read(spark, d, "events").withColumn("page", F.col("event_id") * 7 % 11)
    return linkage.cycles(rows, "user_id", "event_id", "page").select("event_id", b("cycle"))


@query("select event_id, last_value(coalesce(case when event_type = 'click' then 't' || event_id end, case when event_id % 5 <= 2 then 'new_' || event_id end) ignore nulls) over (partition by user_id order by event_id) as task_of from events")
def q_task_groups(spark, d):
    rows = read(spark, d, "events").withColumns({"task": F.when(F.col("event_type") == "click", F.concat(F.lit("t"), "event_id")), "n": F.col("event_id") % 5})
    return linkage.tasks(rows, "user_id", "event_id", "task", "n").select("event_id", "task_of")


@query(f"select id, page from (select *, row_number() over (partition by page, lower(regexp_replace(text, '{WS}+', '', 'g')) order by id) as n from {SQL_LINES}) where n = 1")
def q_issue_dedup(spark, d):
    rows = lines(spark, d).withColumn("key", T.norm_key(F.col("text")))
    return linkage.first_of_each(rows, ["page", "key"], ["id"]).select("id", "page")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1")
def q_best_confidence(spark, d):
    return linkage.first_of_each(read(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"]).select("user_id", "event_id", "value")


@query("select user_id, event_type, min(value) as confidence, bool_or(value < 5) as needs_human from events group by all")
def q_confidence_rollup(spark, d):
    return linkage.confidence_rollup(read(spark, d, "events").select("user_id", "event_type", F.col("value").alias("confidence"), (F.col("value") < 5).alias("needs_human")), ["user_id", "event_type"])


@query("with s as (select event_type, value / 100 as v from events), r as (select *, row_number() over (partition by event_type order by v) - 1 as i, count(*) over (partition by event_type) as n from s) select event_type, count(*) as n, round(avg(v), 6) as mean, max(v) filter (i = n // 2) as median, min(v) as least, max(v) filter (i = n // 10) as p10, count(*) filter (v < 0.4) as low from r group by event_type")
def q_distribution(spark, d):
    return linkage.distribution(read(spark, d, "events").select("event_type", (F.col("value") / 100).alias("v")), "event_type", "v")


@query("select c_custkey, case when c_custkey % 10 = 0 then 'FAILED' when c_acctbal * 20 > 100000 or c_nationkey * 20 > 300 then 'long' else '' end as flag from customer")
def q_costs(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("calls"), (F.col("c_acctbal") * 20).alias("completion_tokens"), (F.col("c_nationkey") * 20).alias("seconds"))
    return linkage.costs(rows).select("c_custkey", "flag")


@query("with f as (select distinct case event_id % 3 when 0 then 'whole' when 1 then 'slide' else 'page' end as condition, event_id * 13 % 97 as cluster from events where event_id % 4 > 0 ), t as (select count(distinct cluster) as t from f) select condition, count(*) as clusters, round(count(*) / max(t), 6) as share, count(*) filter (cluster not in (select cluster from f where condition = 'whole')) as new from f, t group by condition")
def q_coverage(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "whole").when(F.col("event_id") % 3 == 1, "slide").otherwise("page")
    return linkage.coverage(read(spark, d, "events").where("event_id % 4 > 0").select(kind.alias("condition"), (F.col("event_id") * 13 % 97).alias("cluster")))


@query()
def q_clusters(spark, d):
    rows = read(spark, d, "events").where("event_type in ('click', 'view')")
    return linkage.clusters(rows.select(F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.col("user_id") % 3).alias("b")))


@query("with a as (select r_regionkey, row_number() over (order by r_name) as rank from region), n as (select 'n' || n_nationkey as node, n_regionkey, row_number() over (partition by n_regionkey order by n_name) as rank from nation) select 'r' || r_regionkey as node, rank as path_rank from a union all select node, a.rank * 1000 + n.rank from n join a on n_regionkey = r_regionkey")
def q_composite_ranks(spark, d):
    from pyspark.sql import Window

    region = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.row_number().over(Window.orderBy("r_name")).alias("rank"))
    nation = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("rank"))
    return linkage.composite_ranks(region.unionByName(nation)).select("node", "path_rank")


@query()
def q_depth_first(spark, d):
    pages = read(spark, d, "pages")
    links = graph.edges(pages).join(pages.select("page_id", html.host(F.col("url")).alias("site")), "page_id")
    return linkage.depth_first(links.select("site", F.concat(F.lit("p"), "page_id").alias("src"), "pos", F.col("href").alias("dst")))


@query(f"select id, unnest(list_intersect(list_distinct(regexp_extract_all(regexp_replace(dst, '[(（][^)）]*[)）]', ' ', 'g'), '[a-z]{{6,}}')), list_distinct(regexp_extract_all(src, '[a-z]{{6,}}')))) as token from {PAIRS}")
def q_residual_tokens(spark, d):
    return linkage.residual_tokens(pairs(spark, d), "[a-z]{6,}")


@query("select doc_id as page, md5(text) as digest from documents")
def q_reassemble_identity(spark, d):
    # Every line but the first gets its line end back; untranslated pieces keep their source, so the text returns as it was.
    pieces = lines(spark, d).select("page", F.col("line").alias("start"), F.when(F.col("line") > 0, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")).alias("piece"), F.lit(None).cast("string").alias("translation"))
    return linkage.reassemble(pieces).select("page", F.md5("text").alias("digest"))


@query(f"""with l as (select id, i, trim(regexp_replace(s[i], '{WS}+', ' ', 'g'), ' ') as key, t[i] as t from (select id, string_split(src, chr(10)) as s, string_split(src || chr(10) || 'x', chr(10)) as t from {PAIRS}) z, unnest(range(1, len(s) + 1)) as r(i) where len(s) + 1 = len(t))
select id, md5(string_agg(case when length(key) % 2 = 0 and key <> '' then '<' || key || '>' else t end, chr(10) order by i)) as digest from l group by id""")
def q_rebuild(spark, d):
    two = pairs(spark, d).select("id", "src", F.col("src").alias("dst"))
    keys = two.select(F.explode(F.split("src", "\n")).alias("s")).select(T.normalize_ws(F.col("s")).alias("src")).distinct().where("length(src) % 2 = 0 and src != ''")
    return linkage.rebuild(two, keys.withColumn("dst", F.concat(F.lit("<"), "src", F.lit(">")))).select("id", F.md5("text").alias("digest"))
