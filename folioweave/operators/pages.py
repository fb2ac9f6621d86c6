"""Pages as tables of segments, references beside them, and what is left of the source in them.

The functions run over Arrow batches of rows; joins and groupings are Spark's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import page, references

SEGMENTS = f"array<struct<{page.SCHEMA}>>"


def _over(function: Callable, kind: str) -> Callable[..., Column]:
    """A function of one row's values as an Arrow-batched Column function; what it gives for a struct is a dict."""

    def call(*columns: Column) -> Column:
        def rows(part: tuple) -> pd.Series | pd.DataFrame:
            found = [function(*row) for row in zip(*part, strict=True)]
            return pd.DataFrame(found) if kind.startswith("struct<") else pd.Series(found, dtype=object)

        if len(columns) == 1:

            @F.pandas_udf(kind)
            def run(a: pd.Series) -> pd.Series:
                return rows((a,))
        else:

            @F.pandas_udf(kind)
            def run(a: pd.Series, b: pd.Series) -> pd.Series:
                return rows((a, b))

        return run(*columns)

    return call


def segmented(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of pages with id, kind, start, end, text, source_text, placeholders of each segment."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(_over(page.segments, SEGMENTS)(F.col(html))).alias("s")).select(*rest, "s.*")


def reassembled(pages: DataFrame, segments: DataFrame, key: str = "page_id") -> DataFrame:
    """key, html: pages with the trimmed translations of their segments (key, start, end, placeholders, translation) in place,
    placeholders put back; segments without a translation keep their source. All in the JVM: the page is cut at the segments
    and joined again, front to back."""
    said = F.regexp_replace("translation", r"^[\s　]+|[\s　]+$", "")
    said = F.aggregate(F.coalesce("placeholders", F.expr("cast(array() as array<struct<token: string, raw: string>>)")), said, lambda text, p: F.replace(text, p.token, p.raw))
    parts = segments.where("translation is not null and start >= 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", said.alias("said")))).alias("parts"))
    both = pages.select(key, "html").join(parts, key, "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, p: F.when(p.start < acc["at"], acc).otherwise(F.struct(F.concat(acc["done"], F.substring(F.col("html"), acc["at"] + 1, p.start - acc["at"]), p.said).alias("done"), p.end.alias("at")))
    built = F.aggregate("parts", start, step)
    return both.withColumn("b", built).select(key, F.when(F.col("parts").isNull(), F.col("html")).otherwise(F.concat(F.col("b.done"), F.substring(F.col("html"), F.col("b.at") + 1, F.length("html")))).alias("html"))


def rebuilt(done: DataFrame, outputs: DataFrame, pages: DataFrame, segments: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that are done but have no output, reassembled."""
    return reassembled(pages.join(done.select(key), key, "left_semi").join(outputs.select(key), key, "left_anti"), segments, key)


def annotated(pages: DataFrame, notes: DataFrame, corrections: DataFrame, key: str = "page_id", longest: int = 24) -> DataFrame:
    """key, html, found, missed: pages with marks behind the quotes of their notes (key, quote, text) and of their active
    corrections (key, ref_err, corrected), which are quoted by their first ``longest`` characters."""
    own = notes.select(key, "quote", "text").unionByName(corrections.where("coalesce(status, 'active') = 'active' and ref_err != corrected").select(key, F.left("corrected", F.lit(longest)).alias("quote"), F.concat("corrected", F.lit(" ← "), "ref_err").alias("text")))
    grouped = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("quote", "text"))).alias("notes"))

    def mark(source, found):
        found = [] if found is None else list(found)
        ends = [page.quote_end(source or "", 0, len(source or ""), n["quote"] or "") for n in found]
        return {"html": page.annotate(source or "", [(e, n["text"]) for e, n in zip(ends, found, strict=True)]), "found": sum(e >= 0 for e in ends), "missed": sum(e < 0 for e in ends)}

    both = pages.select(key, "html").join(grouped, key, "left")
    return _marked(both, key, mark)


def _marked(both: DataFrame, key: str, mark: Callable) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [mark(h, n) for h, n in zip(part.html, part.notes, strict=True)]
            yield pd.DataFrame({key: part[key], "html": [o["html"] for o in out], "found": [o["found"] for o in out], "missed": [o["missed"] for o in out]})

    return both.mapInPandas(run, f"{key} {dict(both.dtypes)[key]}, html string, found int, missed int")


# ---- references ----------------------------------------------------------------------------------------------------


def reference_texts(pages: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """page, text: of the four names a page's reference may have in each folder (the path, the path as .txt, the flat name, the
    flat name as .txt), the first that is among the files (path, text); one kind of line end, no runs of empty lines."""
    rel = F.col("page")
    flat = F.replace(rel, F.lit("/"), F.lit("__"))
    swap = lambda x: F.concat(F.regexp_replace(x, r"\.[^./]*$", ""), F.lit(".txt"))
    names = F.array(*[F.concat(F.lit(f + "/"), n) for f in folders for n in (rel, swap(rel), flat, swap(flat))])
    tried = pages.select("page", F.posexplode(names).alias("prio", "path")).join(files.select("path", "text"), "path")
    best = tried.groupBy("page").agg(F.min_by("text", "prio").alias("text"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n"), "\n{3,}", "\n\n")
    return best.select("page", F.regexp_replace(clean, r"^[\s　]+|[\s　]+$", "").alias("text"))


def import_references(files: DataFrame, pages: DataFrame) -> DataFrame:
    """file, page, how: files (file) belong to the page (page, date) of their stem, or of the date that photoYYMMDD names; else
    they are unmapped."""
    stem = F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", "")
    name = F.regexp_replace(F.regexp_replace("page", "^.*/", ""), r"\.[^.]*$", "")
    by_name = pages.groupBy(name.alias("stem")).agg(F.min("page").alias("named"))
    by_date = pages.where("date is not null").groupBy("date").agg(F.min("page").alias("dated"))
    day = F.when(F.col("stem").rlike("^photo[0-9]{6}$"), F.concat(F.lit("19"), F.substring("stem", 6, 2), F.lit("-"), F.substring("stem", 8, 2), F.lit("-"), F.substring("stem", 10, 2)))
    both = files.select("file", stem.alias("stem")).withColumn("date", day).join(by_name, "stem", "left").join(by_date, "date", "left")
    how = F.when(F.col("named").isNotNull(), "name").when(F.col("dated").isNotNull(), "date").otherwise("unmapped")
    return both.select("file", F.coalesce("named", "dated").alias("page"), how.alias("how"))


def draft_lines(text: Column) -> Column:
    """The translated lines of a mixed draft (references.reference_lines), in Catalyst."""
    trimmed = F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", ""))
    count = lambda x, c: F.length(x) - F.length(F.regexp_replace(x, c, ""))
    kana, han = (lambda x: count(x, "[぀-ヿ]")), (lambda x: count(x, "[一-鿿]"))
    return F.array_join(F.filter(trimmed, lambda x: x.rlike("[^-=—―_ \\t]") & ~x.startswith("●") & (han(x) > 0) & ((kana(x) == 0) | (kana(x) < han(x)))), "\n")


def checked(segments: DataFrame, refs: DataFrame, corrections: DataFrame | None = None, weights: dict[str, float] | None = None, threshold: float = 0.97, least: int = 4) -> DataFrame:
    """page, id, score, fragment, diff, corrections_applied, covered of the segments (page, id, kind, text, translation) that
    fall short of their page's reference (page, text). Titles and attributes have no weight unless ``weights`` says so."""
    weight = F.when(F.col("kind").isin("head_title", "attr_title", "attr_alt"), 0.0).otherwise(1.0)
    for kind, value in (weights or {}).items():
        weight = F.when(F.col("kind") == kind, float(value)).otherwise(weight)
    rows = segments.where((F.col("kind") == "text") & (weight > 0))
    if corrections is not None:
        grouped = corrections.groupBy("page", "id").agg(F.sort_array(F.collect_list(F.struct("ref_err", "corrected", "status"))).alias("corrections"))
        rows = rows.join(grouped, ["page", "id"], "left")
    else:
        rows = rows.withColumn("corrections", F.expr("cast(null as array<struct<ref_err: string, corrected: string, status: string>>)"))
    kinds = dict(rows.dtypes)
    # A page's segments are one row, so its reference is moved and prepared once, not for each of them.
    grouped = rows.groupBy("page").agg(F.collect_list(F.struct("id", "text", "translation", "corrections")).alias("segments"))
    both = refs.select("page", F.col("text").alias("reference")).join(grouped, "page")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                for s in r.segments:
                    given = [] if s["corrections"] is None else list(s["corrections"])
                    if found := references.check(r.reference, s["translation"], s["text"], given, threshold, least):
                        out.append((r.page, s["id"], *found.values()))
            yield pd.DataFrame(out, columns=["page", "id", "score", "fragment", "diff", "corrections_applied", "covered"])

    return both.select("page", "reference", "segments").mapInPandas(run, f"page {kinds['page']}, id {kinds['id']}, score double, fragment string, diff string, corrections_applied int, covered boolean")


def tails(segments: DataFrame, refs: DataFrame) -> DataFrame:
    """page, tail: the end of each page's reference that none of its translations covers; pages without one aren't named."""
    grouped = segments.where("kind = 'text'").groupBy("page").agg(F.collect_list("translation").alias("said"))
    both = refs.select("page", "text").join(grouped, "page", "left")
    tail = _over(lambda text, said: references.uncovered_tail(text, [] if said is None else list(said)), "string")
    return both.select("page", tail(F.col("text"), F.col("said")).alias("tail")).where("tail != ''")


def with_tail(segments: DataFrame, tails: DataFrame) -> DataFrame:
    """segments with their page's tail behind the translation of the last translated text segment."""
    last = segments.where("kind = 'text' and coalesce(translation, '') != ''").groupBy("page").agg(F.max_by("id", "start").alias("last"))
    both = segments.join(last.join(tails, "page"), "page", "left")
    said = F.when((F.col("id") == F.col("last")) & F.col("tail").isNotNull(), F.concat("translation", F.lit("\n"), "tail")).otherwise(F.col("translation"))
    return both.withColumn("translation", said).select(segments.columns)


def current_corrections(records: DataFrame, superseded: DataFrame) -> DataFrame:
    """Records (page, id, ref_err, corrected, at) with both sides, as active, or superseded by a later mark (page, id, at)."""
    last = superseded.groupBy("page", "id").agg(F.max("at").alias("marked"))
    valid = records.where("trim(coalesce(ref_err, '')) != '' and trim(coalesce(corrected, '')) != ''").join(last, ["page", "id"], "left")
    return valid.withColumn("status", F.when(F.col("marked") >= F.col("at"), "superseded").otherwise("active")).drop("marked")


def inline_note(corrected: Column, ref_err: Column) -> Column:
    return F.concat(corrected, F.lit("（原译文有误："), ref_err, F.lit("）"))


# ---- residuals -----------------------------------------------------------------------------------------------------


def residuals(pairs: DataFrame) -> DataFrame:
    """The columns of pairs (src, dst among them) with token, start, excerpt of each run of source script left in dst."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    found = _over(lambda s, t: references.residual(s, t), "array<struct<token: string, start: int, excerpt: string>>")
    # Most pairs have no run of the class at all; they don't leave the JVM.
    some = pairs.where(F.col("dst").rlike("[ぁ-ゖゝ-ゟ]"))
    return some.select(*rest, F.explode(found(F.col("src"), F.col("dst"))).alias("r")).select(*rest, "r.*")


def residual_report(found: DataFrame, command: str = "reset") -> DataFrame:
    """page, segments, tokens, reset: by page, with the command that resets its segments; ids in natural order."""
    key = F.struct(F.length(F.col("id").cast("string")), F.col("id").cast("string"))
    ids = F.transform(F.array_sort(F.collect_set(key)), lambda x: x.col2)
    return found.groupBy("page").agg(ids.alias("ids"), F.count("*").alias("tokens")).select("page", F.array_join("ids", " ").alias("segments"), "tokens", F.concat_ws(" ", F.lit(command), "page", F.lit("--segments"), F.array_join("ids", " ")).alias("reset"))
