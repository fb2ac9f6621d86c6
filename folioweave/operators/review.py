"""Queues of findings, verdicts on them, histories with targets and resets, dictionaries with imports.

Each function gives a new table or a plan; writing it is the caller's."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import texts_udf
from .containment import occurrences
from .pages import _over
from .quality import placeholder_rule, term_rule

# ---- the queue -----------------------------------------------------------------------------------------------------


def natural(ids: Column) -> Column:
    """The order of segment ids: shorter first, then by text."""
    return F.struct(F.length(ids.cast("string")), ids.cast("string"))


def make_items(findings: DataFrame) -> DataFrame:
    """findings (page, segments, reason, suggestion, severity, source) as queue items: id of their content, open, resolved if a
    segment is known, origin null."""
    ident = T.hash_id(F.col("page"), F.array_join(F.transform("segments", lambda s: s.cast("string")), ","), F.col("reason"), F.col("suggestion"), F.col("source"))
    return findings.withColumns({"id": ident, "status": F.lit("open"), "resolved": F.size("segments") > 0, "origin": F.lit(None).cast("string")})


def queue_stats(items: DataFrame) -> DataFrame:
    """total, open, adopted, and open ones by severity, of a queue: one row."""
    one = lambda s: F.count_if((F.col("status") == "open") & (F.col("severity") == s)).alias(f"open_{s}")
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "adopted").alias("adopted"), one("high"), one("mid"), one("low"))


def review_stats(items: DataFrame) -> DataFrame:
    """reason, open: open items by reason."""
    return items.where("status = 'open'").groupBy("reason").agg(F.count("*").alias("open"))


def removed(items: DataFrame, status: str | None = "open", page: object = None) -> Column:
    """Whether an item is taken from the queue; status None or 'all' and page None match any."""
    hit = F.lit(True) if status in (None, "all") else F.col("status") == status
    return hit if page is None else hit & (F.col("page") == page)


def remove(items: DataFrame, status: str | None = "open", page: object = None) -> DataFrame:
    return items.where(~F.coalesce(removed(items, status, page), F.lit(False)))


def removal_counts(items: DataFrame, status: str | None = "open", page: object = None) -> DataFrame:
    """deleted, kept: what remove would do; nothing is changed."""
    hit = F.coalesce(removed(items, status, page), F.lit(False))
    return items.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("kept"))


def listed_ids(raw: Column) -> Column:
    """Ids of a JSON list of strings or of objects with an id."""
    objects = F.from_json(raw, "array<struct<id: string>>", {"mode": "PERMISSIVE"})
    strings = F.from_json(raw, "array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(F.transform(objects, lambda x: x.id), F.array().cast("array<string>")), F.coalesce(strings, F.array().cast("array<string>"))), lambda x: x.isNotNull() & ~x.startswith("{")))


def adjudicable(items: DataFrame, page: object = None, most: int | None = None) -> DataFrame:
    """Open, resolved items with segments, of a page if one is named, by id; at most ``most``."""
    rows = items.where("status = 'open' and coalesce(resolved, true) and size(segments) > 0")
    rows = rows if page is None else rows.where(F.col("page") == page)
    return rows if most is None else rows.orderBy("id").limit(most)


def next_pending(plan: DataFrame, status: DataFrame, n: int) -> DataFrame:
    """page, rank of the first n pages of the plan that are pending (no status: pending)."""
    both = plan.join(status.select("page", "status"), "page", "left")
    return both.where("coalesce(status, 'pending') = 'pending'").orderBy("rank").limit(n).select("page", "rank")


def qa_status(plan: DataFrame, checks: DataFrame, items: DataFrame, pending_only: bool = False, issues_only: bool = False) -> DataFrame:
    """page, rank, checked, issues, open: the plan beside each page's latest check (page, at, issues) and its open items."""
    last = checks.groupBy("page").agg(F.max_by("issues", "at").alias("issues"))
    open_items = items.where("status = 'open'").groupBy("page").agg(F.count("*").alias("open"))
    out = plan.join(last, "page", "left").join(open_items, "page", "left").select("page", "rank", F.col("issues").isNotNull().alias("checked"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("open", F.lit(0)).alias("open"))
    out = out.where("not checked") if pending_only else out
    return out.where("issues > 0") if issues_only else out


def run_rules(pairs: DataFrame, glossary: DataFrame, token: str = "[[P") -> DataFrame:
    """id, rule, severity, detail: pairs whose placeholders differ in number (high), and terms without their translation (mid)."""
    high = placeholder_rule(pairs, token).select("id", F.lit("placeholder").alias("rule"), F.lit("high").alias("severity"), F.concat_ws(" ", "src_n", "dst_n").alias("detail"))
    mid = term_rule(pairs, glossary).select("id", F.lit("term").alias("rule"), F.lit("mid").alias("severity"), F.concat_ws(" → ", "src", "dst").alias("detail"))
    return high.unionByName(mid)


def decisions(items: DataFrame, versions: DataFrame, op: str = "qa-apply") -> DataFrame:
    """id, status, old, new of each applied or rejected item (page, segments, ...): for an applied one the translation that
    ``op`` last wrote to its first segment with a history, and the last that anything else wrote before that."""
    window = Window.partitionBy("page", "segment").orderBy("version")
    marked = versions.withColumn("old", F.last(F.when(F.col("op") != op, F.col("translation")), ignorenulls=True).over(window))
    last = marked.where(F.col("op") == op).groupBy("page", "segment").agg(F.max_by(F.struct("old", F.col("translation").alias("new")), "version").alias("v"), F.lit(True).alias("hit"))
    known = versions.select("page", "segment").distinct().join(last, ["page", "segment"], "left")
    done = items.where("status in ('applied', 'rejected')")
    spread = done.where("status = 'applied'").select("id", "page", F.posexplode("segments").alias("at", "segment")).join(known, ["page", "segment"])
    first = spread.groupBy("id").agg(F.min_by(F.struct("v"), "at").alias("f"))
    return done.join(first, "id", "left").select("id", "status", F.coalesce("f.v.old", F.lit("")).alias("old"), F.coalesce("f.v.new", F.lit("")).alias("new"))


def recurrences(new: DataFrame, old: DataFrame, threshold: float = 0.6) -> DataFrame:
    """id, best, score of each new issue (id, page, segments, reason, suggestion, dst_quote): the old issue of its page that shares
    a segment and is most like it (the best of three texts' ratios), null below the threshold. Pairs meet on page and segment."""
    spread = lambda df, p: df.select(F.col("id").alias(f"{p}id"), "page", F.explode("segments").alias("segment"))
    met = spread(new, "").join(spread(old, "o_"), ["page", "segment"]).select("id", "o_id").distinct()
    texts = ["reason", "suggestion", "dst_quote"]
    both = met.join(new.select("id", *texts), "id").join(old.select(F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in texts]), "o_id")
    like = F.greatest(*[F.when((F.col(c) != "") & (F.col(f"o_{c}") != ""), texts_udf.ratio_udf(F.col(c), F.col(f"o_{c}"))).otherwise(0.0) for c in texts])
    best = both.withColumn("score", like).where(F.col("score") >= threshold).groupBy("id").agg(F.max_by(F.struct("o_id", "score"), F.struct("score", F.col("o_id"))).alias("b"))
    return new.select("id").join(best, "id", "left").select("id", F.col("b.o_id").alias("best"), F.col("b.score").alias("score"))


def composition(new: DataFrame, matched: DataFrame, touched: DataFrame) -> DataFrame:
    """kind, n: new issues that recur (matched: id, best), that are new on a touched segment (page, segment), or new elsewhere."""
    on = new.select("id", "page", F.explode("segments").alias("segment")).join(touched, ["page", "segment"], "left_semi").select("id").distinct().withColumn("on", F.lit(True))
    kinds = new.select("id").join(matched.select("id", "best"), "id", "left").join(on, "id", "left")
    kind = F.when(F.col("best").isNotNull(), "recurred").when(F.col("on"), "touched").otherwise("elsewhere")
    return kinds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def recurrence_rates(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """source (null: all), threshold, n, rate of issues (source, score) whose best score reaches each of a few thresholds."""
    each = scored.select("source", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("double")
    return each.groupingSets([["threshold"], ["source", "threshold"]], "source", "threshold").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("rate"))


# ---- verdicts ------------------------------------------------------------------------------------------------------

VERDICT = "struct<verdict: string, reason: string, suggestion: string, index: int>"


def read_verdict(reply: str | None) -> dict:
    """verdict (adopt, reject; anything else is skip), reason, suggestion and, where told, index of a judge's reply; what can't be
    read even with its strings repaired is skip."""
    text = (reply or "").strip()
    block = texts_udf.first_object(text) or text
    for attempt in (text.removeprefix("```json").removesuffix("```"), block, texts_udf.repair_strings(block), texts_udf.first_object(texts_udf.repair_strings(text))):
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(found, dict) and "verdict" in found:
            said = str(found["verdict"] or "").strip().lower()
            index = found.get("index")
            index = int(index) if isinstance(index, int) or isinstance(index, str) and index.strip().lstrip("-").isdigit() else None
            return {"verdict": said if said in ("adopt", "reject") else "skip", "reason": str(found.get("reason") or ""), "suggestion": str(found.get("suggestion") or ""), "index": index}
    return {"verdict": "skip", "reason": "unreadable", "suggestion": "", "index": None}


def verdicts(replies: DataFrame) -> DataFrame:
    """The columns of replies but ``reply``, with verdict, reason, suggestion, index."""
    rest = [c for c in replies.columns if c != "reply"]
    return replies.select(*rest, _over(read_verdict, VERDICT)(F.col("reply")).alias("v")).select(*rest, "v.*")


def drifted(replies: DataFrame, items: DataFrame, margin: int = 6) -> DataFrame:
    """page, asked, drift: whether a reply (page, asked, reply) shares a longer passage, by ``margin``, with another item of its page
    (page, id, profile) than with the one asked for."""
    both = replies.join(items, "page").withColumn("common", texts_udf.common_udf(F.col("reply"), F.col("profile")))
    own = F.max(F.when(F.col("id") == F.col("asked"), F.col("common")))
    other = F.coalesce(F.max(F.when(F.col("id") != F.col("asked"), F.col("common"))), F.lit(0))
    return both.groupBy("page", "asked").agg((other - own >= margin).alias("drift")).select("page", "asked", F.coalesce("drift", F.lit(False)).alias("drift"))


def drift_audit(calls: DataFrame) -> DataFrame:
    """grp, calls, resets, mismatches of calls (grp, messages, asked, echoed): calls that begin anew (two messages), though not the
    first of their group, and replies that echo another index."""
    first = F.row_number().over(Window.partitionBy("grp").orderBy("call")) == 1
    return calls.withColumn("first", first).groupBy("grp").agg(F.count("*").alias("calls"), F.count_if(~F.col("first") & (F.col("messages") == 2)).alias("resets"), F.count_if(F.col("echoed").isNotNull() & (F.col("echoed") != F.col("asked"))).alias("mismatches"))


# ---- histories -----------------------------------------------------------------------------------------------------


def commit(state: DataFrame, op: str, op_id: str, at: int) -> DataFrame:
    """The state (page, segment, translation) as versions to append: op, op_id, version by the time and a hash of the key."""
    return state.select("page", "segment", "translation", F.lit(op).alias("op"), F.lit(op_id).alias("op_id"), F.lit(at).cast("bigint").alias("version"))


def targets(versions: DataFrame, segments: DataFrame | None = None, op_id: str | None = None) -> DataFrame:
    """page, segment, to_version: for an operation's segments the last version that it didn't write; for named ones (page,
    segment) the last whose translation differs from the current; null where there is none."""
    keys = ["page", "segment"]
    if op_id is not None:
        touched = versions.where(F.col("op_id") == op_id).select(*keys).distinct()
        found = versions.where(F.col("op_id") != op_id)
    else:
        touched = segments.select(*keys).distinct()
        now = versions.groupBy(*keys).agg(F.max_by("translation", "version").alias("now"))
        found = versions.join(now, keys).where(~F.col("translation").eqNullSafe(F.col("now")))
    last = found.groupBy(*keys).agg(F.max("version").alias("to_version"))
    return touched.join(last, keys, "left")


def restored(state: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The state (page, segment, translation) after going back to the wanted versions (page, segment, to_version)."""
    keys = ["page", "segment"]
    there = wanted.where("to_version is not null").join(versions.select(*keys, F.col("version").alias("to_version"), F.col("translation").alias("then")), [*keys, "to_version"]).select(*keys, "then", F.lit(True).alias("back"))
    both = state.join(there, keys, "left")
    return both.select(*keys, F.when(F.col("back"), F.col("then")).otherwise(F.col("translation")).alias("translation"))


def picked(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """page, segment, version that ``pick`` names (page, segment, pick): a version's own number, else a place from 1, or from the
    end if negative."""
    keys = ["page", "segment"]
    up, down = Window.partitionBy(*keys).orderBy("version"), Window.partitionBy(*keys).orderBy(F.desc("version"))
    placed = versions.select(*keys, "version", F.row_number().over(up).alias("i"), (-F.row_number().over(down)).alias("j"))
    both = placed.join(wanted, keys)
    own = F.max(F.when(F.col("version") == F.col("pick"), F.col("version")))
    place = F.max(F.when((F.col("i") == F.col("pick")) | (F.col("j") == F.col("pick")), F.col("version")))
    return both.groupBy(*keys).agg(F.coalesce(own, place).alias("version"))


def applied_before(versions: DataFrame, op: str = "qa-apply") -> DataFrame:
    """page, segment, old, new: each segment's last version by ``op`` and the one just before it."""
    window = Window.partitionBy("page", "segment").orderBy("version")
    marked = versions.withColumn("old", F.lag("translation").over(window)).where(F.col("op") == op)
    return marked.groupBy("page", "segment").agg(F.max_by(F.struct("old", F.col("translation").alias("new")), "version").alias("v")).select("page", "segment", "v.old", "v.new")


def backfill(state: DataFrame, versions: DataFrame) -> DataFrame:
    """Translated segments without any version."""
    return state.where("coalesce(translation, '') != ''").join(versions.select("page", "segment").distinct(), ["page", "segment"], "left_anti")


def reset(state: DataFrame, pages: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """The state without the segments of reset pages, and with null in place of reset segments' translations."""
    if pages is not None:
        state = state.join(pages.select("page"), "page", "left_anti")
    if segments is not None:
        hit = segments.select("page", "segment").distinct().withColumn("_gone", F.lit(True))
        state = state.join(hit, ["page", "segment"], "left").withColumn("translation", F.when(F.col("_gone").isNull(), F.col("translation"))).drop("_gone")
    return state


def folded(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items (id, translation) after the last decision on each (id, at, action, value): accept takes the value, or what stands;
    delete empties; skip and none leave it open."""
    last = events.groupBy("id").agg(F.max_by(F.struct("action", "value"), "at").alias("e"))
    both = items.join(last, "id", "left")
    action = F.coalesce(F.col("e.action"), F.lit("none"))
    return both.select("id", F.when(action == "accept", F.coalesce("e.value", "translation")).when(action == "delete", F.lit(None)).otherwise(F.col("translation")).alias("translation"), F.when(action == "accept", "done").when(action == "delete", "deleted").otherwise("open").alias("status"))


def plan_text(plan: DataFrame) -> DataFrame:
    """page, text of a restore plan (page, segment, action, from_value, to_value): a line a segment that changes, then the totals."""
    line = F.concat(F.lit("- "), F.col("segment").cast("string"), F.lit(" "), "action", F.lit(": "), F.coalesce("from_value", F.lit("∅")), F.lit(" → "), F.coalesce("to_value", F.lit("∅")))
    rows = plan.withColumn("line", F.when(F.col("action") != "same", F.struct(natural(F.col("segment")).alias("k"), line.alias("line"))))
    out = rows.groupBy("page").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.count_if(F.col("action") == "same").alias("same"))
    return out.select("page", F.concat_ws("\n", F.array_join(F.transform("lines", lambda x: x.line), "\n"), F.format_string("%d changed, %d same", F.size("lines"), "same")).alias("text"))


def last_groups(rows: DataFrame, by: str, group: str, order: str, n: int) -> DataFrame:
    """The rows of each key's n groups that came last."""
    last = rows.groupBy(by, group).agg(F.max(order).alias("_last"))
    kept = last.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_last"), group))).where(F.col("_n") <= n)
    return rows.join(kept.select(by, group), [by, group], "left_semi")


# ---- dictionaries --------------------------------------------------------------------------------------------------


def import_confirmed(glossary: DataFrame, incoming: DataFrame, categories: list[str], read_only: str = "read_only") -> DataFrame:
    """src, dst, action for incoming terms (src, dst, category, seq): skipped (empty, or of no known category), added, updated (the
    old one had no dst, or the same), conflict (another dst stands)."""
    ok = (F.trim("src") != "") & (F.trim("dst") != "") & F.coalesce(F.col("category").isin(categories), F.lit(False))
    rows = incoming.withColumn("ok", F.coalesce(ok, F.lit(False)))
    last = rows.where("ok").groupBy("src").agg(F.max_by("dst", "seq").alias("dst"))
    both = last.join(glossary.select("src", F.col("dst").alias("old"), F.lit(True).alias("known")), "src", "left")
    action = F.when(F.col("known").isNull(), "added").when((F.coalesce("old", F.lit("")) == "") | (F.col("old") == F.col("dst")), "updated").otherwise("conflict")
    skipped = rows.where("not ok").select("src", "dst", F.lit("skipped").alias("action"))
    return both.select("src", F.when(action == "conflict", F.col("old")).otherwise(F.col("dst")).alias("dst"), action.alias("action")).unionByName(skipped)


def learn_phrases(memory: DataFrame, pairs: DataFrame, glossary: DataFrame, longest: int = 30) -> DataFrame:
    """key, dst, usage: the memory with pairs (src, dst, seq) put in; long ones and those that the read-only glossary has stay out."""
    key = T.normalize_ws(F.col("src"))
    new = pairs.withColumn("key", key).where((F.length("key") <= longest) & (F.length("key") > 0))
    new = new.join(glossary.where("read_only").select(F.col("src").alias("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.max_by("dst", "seq").alias("n"), F.count("*").alias("u"))
    both = memory.join(new, "key", "full_outer")
    return both.select("key", F.coalesce("n", "dst").alias("dst"), (F.coalesce("usage", F.lit(0)) + F.coalesce("u", F.lit(0))).alias("usage"))


def confirm(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """The glossary with the named terms (src, dst) confirmed; a dst that isn't null replaces theirs."""
    hit = terms.groupBy("src").agg(F.max("dst").alias("_dst"), F.lit(True).alias("_hit"))
    both = glossary.join(hit, "src", "left")
    return both.withColumns({"dst": F.coalesce("_dst", "dst"), "status": F.when(F.col("_hit"), "confirmed").otherwise(F.col("status"))}).drop("_dst", "_hit")


def add_term(src: str, dst: str, glossary: DataFrame, phrases: DataFrame, memory: DataFrame, notes: DataFrame, keywords: list[str] | None = None) -> dict[str, DataFrame]:
    """A confirmed term and what follows: its phrase goes, and memories and notes that hold the term without its translation, or
    any of the keywords."""
    from .memory import purge_keywords, purge_term

    term = glossary.sparkSession.createDataFrame([(src, dst, "confirmed")], "src string, dst string, status string")
    memory, notes = purge_term(memory, src, dst), notes.where(~(F.col("quote").contains(src) & ~F.col("summary").contains(dst)))
    if keywords:
        memory, notes = purge_keywords(memory, keywords), purge_keywords(notes, keywords, "summary")
    return {"glossary": glossary.where(F.col("src") != src).unionByName(term, allowMissingColumns=True), "phrases": phrases.where(F.col("key") != T.normalize_ws(F.lit(src))), "memory": memory, "notes": notes}


def audit_terms(pairs: DataFrame, glossary: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, before, after of the pairs that rebuilding from the read-only glossary, then the phrases, would change."""
    from .linkage import rebuild

    own = glossary.where("read_only").select(T.normalize_ws(F.col("src")).alias("src"), "dst").groupBy("src").agg(F.min("dst").alias("dst"))
    rest = phrases.select(F.col("key").alias("src"), "dst").join(own.select("src"), "src", "left_anti")
    after = rebuild(pairs, own.unionByName(rest)).withColumnRenamed("text", "after")
    return pairs.join(after, "id").where("after != dst").select("id", F.col("dst").alias("before"), "after")


def related(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page, related: the paths of each list that exist, in order."""
    each = pages.select("page", F.posexplode("related").alias("at", "path")).join(known.select(F.col("page").alias("path")), "path", "left_semi")
    kept = each.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x.path).alias("related"))
    return pages.select("page").join(kept, "page", "left").select("page", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def hit_texts(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """src, texts, places: how many texts hold each term, and how often."""
    return occurrences(terms, texts).groupBy(F.col("term").alias("src")).agg(F.count("*").alias("texts"), F.sum("n").alias("places"))
