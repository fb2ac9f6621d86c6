"""Calls of a language model and the steps around them: settings, retries, repair, and the loops over pages, items and batches.

A model is any function of a prompt (and of temperature and the most tokens) that gives a Reply; ``echo`` is the offline one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import references, texts_udf
from ..functions import text as T
from ..operators import memory, mining, review


class NetworkError(Exception):
    pass


class WallTime(Exception):
    pass


class Loop(Exception):
    """The reply repeats itself."""


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    finish: str = "stop"


@dataclass(frozen=True)
class Settings:
    """What a call is made with. ``with_own`` puts a step's own settings over the general ones; an empty text inherits."""

    model: str = "echo"
    key: str = ""
    temperature: float = 0.3
    max_tokens: int = 4096
    ceiling: int = 32768
    wall: float = 300.0
    walls: dict[str, float] = field(default_factory=dict)
    tag: str = ""

    def with_own(self, own: dict) -> Settings:
        return replace(self, **{k: v for k, v in own.items() if v is not None and v != ""})

    def wall_for(self, tag: str) -> float:
        return self.walls.get(tag.partition("_")[0], self.wall)


def echo(prompt: str, temperature: float, max_tokens: int) -> Reply:
    """What stands behind the last text mark, as JSON with full confidence."""
    marks = [prompt.rfind(m) + len(m) for m in ("|TEXT|", "|DST|") if m in prompt]
    said = prompt[max(marks) :] if marks else ""
    return Reply(json.dumps({"translation": said, "confidence": 1.0, "notes": []}, ensure_ascii=False), len(prompt), len(said))


def streamed(chunks: Iterable[str], wall: float, clock: Callable[[], float] = time.monotonic, every: int = 512) -> str:
    """The text of a stream of chunks; the time is looked at with each, repetition every ``every`` characters."""
    began, text, due = clock(), "", every
    for chunk in chunks:
        if clock() - began > wall:
            raise WallTime(f"{len(text)} characters")
        text += chunk
        if len(text) >= due:
            due = len(text) + every
            if p := texts_udf.period(text):
                raise Loop(f"period {p}")
    return text


def called(model: Callable[..., Reply], prompt: str, settings: Settings, sleep: Callable[[float], None] = time.sleep, network: int = 3, loops: int = 2, walls: int = 1, empties: int = 1) -> Reply:
    """A reply with text. Four budgets, each its own: network errors (waits double), repetitions (each a tenth warmer, three tenths
    at most), wall time, empty replies; an empty reply that ran out of tokens gets twice as many, once, up to the ceiling."""
    left = {NetworkError: network, Loop: loops, WallTime: walls, "empty": empties}
    temperature, tokens, waits, longer = settings.temperature, settings.max_tokens, 0, False
    while True:
        try:
            reply = model(prompt, temperature, tokens)
        except (NetworkError, Loop, WallTime) as error:
            kind = type(error)
            if not left[kind]:
                raise
            left[kind] -= 1
            if kind is NetworkError:
                sleep(2.0**waits)
                waits += 1
            elif kind is Loop:
                temperature = min(temperature + 0.1, settings.temperature + 0.3)
            continue
        if reply.text.strip():
            return reply
        if reply.finish == "length" and not longer and tokens < settings.ceiling:
            tokens, longer = min(2 * tokens, settings.ceiling), True
        elif left["empty"]:
            left["empty"] -= 1
        else:
            raise ValueError("empty reply")


def asked(model: Callable[..., Reply], prompt: str, settings: Settings, key: str = "translation", again: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The object that a reply holds, with ``key``; a reply that can't be read is asked for again with the reason, at last taken as
    plain text with confidence 0.1."""
    said, question = "", prompt
    for _ in range(again + 1):
        said = called(model, question, settings, sleep).text
        if found := texts_udf.tolerant_json(said, key):
            found = json.loads(found)
            if key in found:
                return found
        question = f"{prompt}\n\nThe last reply was no JSON object with {key}:\n{said[:500]}"
    return {key: references.cleaned(said), "confidence": 0.1}


def chat(prompts: DataFrame, model: Callable[..., Reply], settings: Settings, rate: float | None = None) -> DataFrame:
    """id, reply, error, prompt_tokens, completion_tokens, seconds of each prompt (id, tag, prompt). A failed call is a row with its
    error; ``rate`` calls a minute are made at most by each task."""
    kind = dict(prompts.dtypes)["id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if rate:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + 60.0 / rate
                began = time.monotonic()
                try:
                    reply, error = called(model, r.prompt or "", replace(settings, wall=settings.wall_for(r.tag or ""))), None
                except Exception as failure:  # noqa: BLE001  a row tells of it, others go on
                    reply, error = Reply(""), f"{type(failure).__name__}: {failure}"
                out.append((r.id, reply.text, error, reply.prompt_tokens, reply.completion_tokens, time.monotonic() - began))
            yield pd.DataFrame(out, columns=["id", "reply", "error", "prompt_tokens", "completion_tokens", "seconds"])

    return prompts.select("id", "tag", "prompt").mapInPandas(run, f"id {kind}, reply string, error string, prompt_tokens bigint, completion_tokens bigint, seconds double")


# ---- prompts -------------------------------------------------------------------------------------------------------


def sections(*parts: tuple[str, Column]) -> Column:
    """Parts that aren't empty under their headings, an empty line between; a part without a heading stands alone."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {head}\n" if head else ""), body)) for head, body in parts])


def term_lines(terms: Column) -> Column:
    """Terms (array of src, dst, note) as a list."""
    line = lambda t: F.concat(F.lit("- "), t.src, F.lit(" → "), t.dst, F.when(F.coalesce(t.note, F.lit("")) != "", F.concat(F.lit(" ("), t.note, F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(terms, line), "\n")


def translate_prompt(source: Column, terms: Column, context: Column, style: Column, first: bool = True) -> Column:
    """The first turn of a page carries style and context, the next ones terms only."""
    head = (("Style", style), ("Context", context)) if first else ()
    return sections(*head, ("Terms", terms), ("", F.concat(F.lit("|TEXT|"), source)))


def fix_prompt(source: Column, current: Column, advice: Column, reference: Column) -> Column:
    return sections(("Source", source), ("Reference", reference), ("Advice", advice), ("", F.concat(F.lit("|DST|"), current)))


def item_text(index: Column, reason: Column, suggestion: Column, src: Column, dst: Column) -> Column:
    return sections(("", F.format_string("Item %d", index)), ("Reason", F.left(reason, F.lit(500))), ("Suggestion", F.left(suggestion, F.lit(500))), ("Source", F.left(src, F.lit(200))), ("Translation", F.left(dst, F.lit(200))))


def item_index(text: Column) -> Column:
    """The number in an item's text; null if it has none."""
    return F.regexp_extract(text, r"(?m)^Item (\d+)$", 1).try_cast("int")


def styled(text: Column, preset: Column, heading: str = "Style") -> Column:
    """A text of sections (## ) without those of that heading, and the preset as its last section."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=## )"), lambda p: (F.trim(p) != "") & ~F.ltrim(p).startswith(f"## {heading}"))
    bare = F.trim(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\s+$", "")), "\n\n"))
    return F.concat_ws("\n\n", F.when(bare != "", bare), F.when(F.coalesce(preset, F.lit("")) != "", F.concat(F.lit(f"## {heading}\n"), preset)))


# ---- loops ---------------------------------------------------------------------------------------------------------


def batches(rows: DataFrame, order: list, size: int = 40) -> DataFrame:
    """rows with ``batch``: ``size`` in a row share one."""
    from ..operators.graph import numbered

    return numbered(rows, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def reviewed_terms(candidates: DataFrame, known: DataFrame, judge: Callable[[list[str]], dict[str, bool]], size: int = 40) -> DataFrame:
    """src, keep of candidates (src): those known (src, keep) as they are, the rest judged ``size`` at a time. What a judge doesn't
    say is kept; a batch whose judge fails says nothing and comes again next time."""
    new = batches(candidates.select("src").distinct().join(known.select("src"), "src", "left_anti"), [F.col("src")], size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.src)
        try:
            said = judge(names)
        except Exception:  # noqa: BLE001
            return pd.DataFrame({"src": [], "keep": []}, dtype=object)
        return pd.DataFrame({"src": names, "keep": [bool(said.get(n, True)) for n in names]})

    return known.select("src", "keep").unionByName(new.groupBy("batch").applyInPandas(run, "src string, keep boolean"))


def two_passes(found: DataFrame, judge: Callable[[DataFrame], DataFrame] | None, split: int = 7, least: int = 3) -> DataFrame:
    """Terms of two bands: the frequent ones reviewed first; then rarer ones that aren't part of those kept, reviewed too; one row a
    white-space-free form. Without a judge the first band's candidates are all there is."""
    first = mining.band(found, split)
    if judge is None:
        return first.select("src", "count", "pages")
    kept = judge(first)
    second = mining.band(found, least, split)
    both = mining.maximal(kept.select("src", "count", "pages").withColumn("first", F.lit(True)).unionByName(second.select("src", "count", "pages").withColumn("first", F.lit(False)))).where("not first").drop("first")
    every = kept.select("src", "count", "pages").unionByName(judge(both).select("src", "count", "pages"))
    best = F.max_by(F.struct("src", "count", "pages"), F.struct(F.col("src").contains(" "), "count", "src"))
    return every.groupBy(T.norm_key(F.col("src")).alias("key")).agg(best.alias("b")).select("b.*")


ALGORITHMS: dict[str, Callable[[DataFrame], DataFrame]] = {"runs": mining.runs, "repeat_lines": mining.repeat_lines, "c_value": mining.c_value, "bpe": mining.byte_pairs, "entropy": mining.boundary_entropy, "pmi": mining.pmi}


def algorithms(choice: str | list[str] | None = None) -> list[str]:
    """Names of the algorithms: all of them, those named, or the usual two; a name that isn't one is an error."""
    names = list(ALGORITHMS) if choice == "all" else ["runs", "repeat_lines"] if not choice else choice.split(",") if isinstance(choice, str) else list(choice)
    if unknown := [n for n in names if n not in ALGORITHMS]:
        raise ValueError(f"no algorithm {unknown}")
    return names


def page_terms(pages: DataFrame, model: Callable[..., Reply], settings: Settings, longest: int = 6000) -> DataFrame:
    """src, dst, category, confidence: terms that a model names in the first ``longest`` characters of each page (id, text), of one
    source the surest; ties go to the smaller id."""
    prompts = pages.select("id", F.lit("term").alias("tag"), sections(("Terms of this text as JSON", F.left("text", F.lit(longest)))).alias("prompt"))
    terms = F.from_json("reply", "struct<terms: array<struct<src: string, dst: string, category: string, confidence: double>>>").terms
    each = chat(prompts, model, settings).select("id", F.explode(terms).alias("t")).select("id", "t.*").where("trim(coalesce(src, '')) != ''")
    order = Window.partitionBy("src").orderBy(F.desc_nulls_last("confidence"), "id")
    return each.withColumn("n", F.row_number().over(order)).where("n = 1").select("src", "dst", "category", "confidence")


def summaries(pages: DataFrame, model: Callable[..., Reply], settings: Settings, done: DataFrame | None = None, key: str = "summary") -> DataFrame:
    """id, text: one call a page (id, text) that isn't done; replies that can't be read are left out."""
    todo = pages if done is None else pages.join(done.select("id"), "id", "left_anti")
    replies = chat(todo.select("id", F.lit("summary").alias("tag"), sections((f"Write {key} as JSON", F.col("text"))).alias("prompt")), model, settings)
    said = F.coalesce(F.get_json_object(texts_udf.json_udf(F.col("reply")), f"$.{key}"), F.get_json_object("reply", f"$.{key}"))
    return replies.where("error is null").select("id", said.alias("text")).where("text is not null")


def fits_another(profiles: list[str], replies: dict[int, str], margin: int) -> set[int]:
    """The items whose reply shares with another item's profile a part that is longer, by margin or more, than the longest it shares
    with its own. For that only parts of one length matter, own plus margin: replies are taken by that length, with the hashes of
    all such parts of the page's profiles; what meets one is looked up in the profiles themselves."""
    distinct = list(dict.fromkeys(profiles))
    if margin < 1:  # then a shorter part with another one counts too
        common = {i: [texts_udf.longest_common(reply, x) for x in profiles] for i, reply in replies.items()}
        return {i for i, c in common.items() if max((x for j, x in enumerate(c) if j != i), default=0) - c[i] >= margin}
    if len(distinct) < 2:
        return set()
    by_size: dict[int, list[int]] = {}
    for i, reply in replies.items():
        if len(reply) >= (size := texts_udf.longest_common(reply, profiles[i]) + margin):
            by_size.setdefault(size, []).append(i)
    out = set()
    for size, items in by_size.items():
        parts = {hash(x[k : k + size]) for x in distinct for k in range(len(x) - size + 1)}
        for i in items:
            met = [part for k in range(len(replies[i]) - size + 1) if hash(part := replies[i][k : k + size]) in parts]
            if any(part in x for part in met for x in distinct):
                out.add(i)
    return out


def adjudicated(items: DataFrame, judge: Callable[[list[str], int, dict], str], margin: int = 6) -> DataFrame:
    """page, id, verdict, reason, suggestion, drift of items (page, id, profile): a page's items are put to the judge in turn, who
    sees the replies so far; a reply that echoes another index, or fits another item better, is skip. One failed item doesn't
    stop its page. A page is one conversation, so one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id").to_dict("records")
        said, replies, failed = [], {}, {}
        for i, item in enumerate(rows):
            try:
                replies[i] = judge(said, i, item)
                said.append(replies[i])
            except Exception as failure:  # noqa: BLE001
                failed[i] = type(failure).__name__
        other = fits_another([x["profile"] or "" for x in rows], replies, margin)
        out = []
        for i, item in enumerate(rows):
            if i in failed:
                out.append((item["page"], item["id"], "skip", failed[i], "", False))
                continue
            found = review.read_verdict(replies[i])
            drift = i in other or found["index"] not in (None, i + 1)
            out.append((item["page"], item["id"], "skip" if drift else found["verdict"], found["reason"], found["suggestion"], drift))
        return pd.DataFrame(out, columns=["page", "id", "verdict", "reason", "suggestion", "drift"])

    kinds = dict(items.dtypes)
    return items.groupBy("page").applyInPandas(run, f"page {kinds['page']}, id {kinds['id']}, verdict string, reason string, suggestion string, drift boolean")


def resumed(todo: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], key: str = "page", size: int = 1000) -> int:
    """Apply step to the keys of todo that ``path`` doesn't hold yet, ``size`` at a time, each batch appended when done; how many
    batches ran. A repeated run takes up where the last one stopped."""
    spark = todo.sparkSession
    ran = 0
    while True:
        try:
            done = spark.read.parquet(path).select(key).distinct()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            done = None
        rest = (todo if done is None else todo.join(done, key, "left_anti")).orderBy(key).limit(size)
        if rest.isEmpty():
            return ran
        step(rest).write.mode("append").parquet(path)
        ran += 1


def translated(segments: DataFrame, glossary: DataFrame, phrases: DataFrame, terms: DataFrame, model: Callable[..., Reply], settings: Settings) -> DataFrame:
    """page, id, translation, confidence, needs_human, origin of segments (page, id, text): dictionaries first; else the model, asked
    with the page's terms (page, lines); lost placeholders are put back. Confidence below a half, and placeholders that still differ,
    need a human."""
    from ..operators import quality, similarity
    from . import model as simple

    rows = segments.withColumn("key", F.concat_ws("#", "page", "id"))
    known = similarity.cascade(rows.select(F.col("key").alias("id"), "text"), glossary, phrases)
    todo = rows.join(known.where("origin = 'model'").select(F.col("id").alias("key")), "key").join(terms, "page", "left")
    prompts = todo.select(F.col("key").alias("id"), F.lit("translate").alias("tag"), translate_prompt(F.col("text"), F.col("lines"), F.lit(None), F.lit(None)).alias("prompt"))
    replies = chat(prompts, model, settings).select("id", F.coalesce("reply", F.lit("")).alias("reply"))
    said = simple.settle(known.select("id").join(replies, "id", "left"), known.where("origin != 'model'"))
    both = rows.join(said.withColumnRenamed("id", "key"), "key")
    fixed = quality.restore_placeholders(F.col("text"), F.col("translation"))
    both = both.withColumn("translation", fixed)
    same = F.sort_array(T.placeholders(F.col("text"))) == F.sort_array(T.placeholders(F.col("translation")))
    return both.select("page", "id", "translation", "confidence", ((F.col("confidence") < 0.5) | ~same).alias("needs_human"), "origin")


# ---- reviews by hand, logs -----------------------------------------------------------------------------------------


def review_lines(terms: DataFrame) -> DataFrame:
    """line: terms as one JSON object a line, of four fields."""
    return terms.select(F.to_json(F.struct("src", "dst", "category", "count")).alias("line"))


def read_review(lines: DataFrame) -> DataFrame:
    """line, src, dst, category, ok of non-empty lines, a comma behind the object allowed; what isn't one isn't ok."""
    body = F.regexp_replace(F.trim("line"), r",\s*$", "")
    found = F.from_json(body, "src string, dst string, category string")
    return lines.where("trim(line) != ''").select("line", found.alias("f")).select("line", "f.src", "f.dst", "f.category", (F.coalesce(F.trim("f.src"), F.lit("")) != "").alias("ok"))


def log_text(calls: DataFrame) -> DataFrame:
    """grp, text: calls (grp, call, messages: array of role and content, reply) of each group as Markdown, in order."""
    said = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("### "), m.role, F.lit("\n\n"), m.content)), "\n\n")
    one = F.concat(F.lit("## "), F.col("call").cast("string"), F.lit("\n\n"), said, F.lit("\n\n### reply\n\n"), F.coalesce("reply", F.lit("")))
    return calls.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("call", one.alias("one")))), lambda x: x.one), "\n\n").alias("text"))


def rebound(logs: DataFrame, runs: DataFrame, before: DataFrame) -> DataFrame:
    """log, run, how: a log (log, tag, t) belongs to the run (run, start) of its tag, else to the one it was bound to before (log,
    run), else to the last run that began by its time; each log once."""
    exact = logs.join(runs.select(F.col("run").alias("tag")), "tag").select("log", F.col("tag").alias("run"), F.lit("tag").alias("how"))
    rest = logs.join(exact.select("log"), "log", "left_anti")
    kept = rest.join(before.join(runs.select("run"), "run", "left_semi"), "log").groupBy("log").agg(F.min("run").alias("run")).withColumn("how", F.lit("before"))
    last = rest.join(kept.select("log"), "log", "left_anti").select("log", "t", F.lit(None).cast("string").alias("run"), F.lit(1).alias("kind"))
    slots = last.unionByName(runs.select(F.lit(None).cast(dict(logs.dtypes)["log"]).alias("log"), F.col("start").alias("t"), "run", F.lit(0).alias("kind"))).withColumn("day", F.floor(F.col("t") / 86_400))
    inside = Window.partitionBy("day").orderBy("t", "kind", "run")
    found = slots.withColumn("at", F.last("run", ignorenulls=True).over(inside))
    # The last run of an earlier day serves a log before the first of its own.
    days = slots.groupBy("day").agg(F.max_by("run", F.struct(F.when(F.col("run").isNotNull(), F.col("t")).alias("s"), "run")).alias("final"))
    carried = days.withColumn("carried", F.last("final", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))  # a row a day
    timed = found.where("kind = 1").join(carried.select("day", "carried"), "day", "left").select("log", F.coalesce("at", "carried").alias("run"), F.lit("time").alias("how")).where("run is not null")
    return exact.unionByName(kept.select("log", "run", "how")).unionByName(timed)


def longest_prefixes(texts: DataFrame, pages: DataFrame, most: int = 80) -> DataFrame:
    """id, size: how many first characters (of ``most``, white space folded) a text (id, text) shares with the page (page, text) that
    shares most, if any. That page is a neighbour in the order of texts, so one sort by first character finds it."""
    head = F.left(T.normalize_ws(F.col("text")), F.lit(most))
    rows = texts.select("id", head.alias("x"), F.lit(None).cast("string").alias("p")).unionByName(pages.select(F.lit(None).cast(dict(texts.dtypes)["id"]).alias("id"), head.alias("x"), head.alias("p"))).where("x != ''")
    window = Window.partitionBy(F.left("x", F.lit(1))).orderBy("x")
    sides = [F.last("p", ignorenulls=True).over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.first("p", ignorenulls=True).over(window.rangeBetween(Window.currentRow, Window.unboundedFollowing))]

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(b.isNull(), 0).when(first > 0, first - 1).otherwise(F.least(F.length(a), F.length(b)))

    found = rows.withColumns({"l": sides[0], "r": sides[1]}).where("id is not null")
    return found.select("id", F.greatest(shared(F.col("x"), F.col("l")), shared(F.col("x"), F.col("r"))).cast("bigint").alias("size")).where("size > 0")


def learnt(phrases: DataFrame, pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """The phrase memory after learning what is fit for it from pairs (src, dst, seq)."""
    return review.learn_phrases(phrases, memory.learnable(pairs), glossary)
