"""Reading sites, reference texts, logs and caches; writing pages and logs. Paths go through Spark's readers only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = r"(?i)\.(html?|htm)$"
# Encodings to try for a language, in order.
ENCODINGS = {
    "ja": ["cp932", "euc_jp", "iso2022_jp"],
    "zh-Hans": ["gbk", "gb2312"],
    "zh-Hant": ["big5"],
    "zh": ["gbk", "big5"],
    "ko": ["euc_kr", "cp949"],
    "ru": ["cp1251", "koi8_r"],
    "en": ["cp1252", "iso8859-1"],
}
DEFAULT = ["utf-8", "cp1252", "latin1"]


def site(spark: SparkSession, root: str) -> DataFrame:
    """rel, size, content, is_page of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "").alias("rel"), F.col("length").alias("size"), "content").withColumn("is_page", F.col("rel").rlike(PAGE))


def candidates(declared: Column, lang: Column) -> Column:
    """Encodings to try in order: declared, the language's, UTF-8; each once whatever its case."""
    table = F.create_map(*[x for k, v in ENCODINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(table, lang), F.array(*map(F.lit, DEFAULT)))
    every = F.array_compact(F.concat(F.array(declared), own, F.array(F.lit("utf-8"))))
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def decode(content: Column, encodings: Column, strict: bool = True) -> Column:
    """encoding and text by the first encoding that decodes; else null, or with strict off UTF-8 with replacements."""
    @F.pandas_udf("encoding string, text string")
    def run(raw: pd.Series, names: pd.Series) -> pd.DataFrame:
        out = []
        for data, tries in zip(raw, names, strict=True):
            found = (None, None if strict or data is None else bytes(data).decode("utf-8", "replace"))
            for name in tries if data is not None else ():
                try:
                    found = (name, bytes(data).decode(name))
                    break
                except (UnicodeDecodeError, LookupError):
                    continue
            out.append(found)
        return pd.DataFrame(out, columns=["encoding", "text"])

    return run(content, encodings)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def segment_cache(raw: Column, segment: str = "id bigint, start bigint, end bigint, text string, translation string") -> Column:
    """Segments of a cache that is either a list or an object with key segments."""
    return F.coalesce(F.from_json(raw, f"struct<segments:array<struct<{segment.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>>>").segments, F.from_json(raw, f"array<struct<{segment.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>>"))


def reference_text(text: Column) -> Column:
    """Byte order mark off, one kind of line end, at most one empty line in a row, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"), "\n{3,}", "\n\n"))


def mirror_plan(source: DataFrame, output: DataFrame) -> DataFrame:
    """rel, action: what to copy, because it is missing in the output or of another size."""
    both = source.join(output.select("rel", F.col("size").alias("there")), "rel", "left")
    return both.where(F.col("there").isNull() | (F.col("there") != F.col("size"))).select("rel", F.when(F.col("there").isNull(), "missing").otherwise("differs").alias("action"))


def paths_in(text: Column) -> Column:
    """Drive-letter and data-folder paths in a text."""
    return F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z]:[\\/]|instance/data-)[A-Za-z0-9_./\\-]+)"), F.lit(1))


def log_page(tag: Column) -> Column:
    """The page key of a call's tag: its kind in front and a segment number behind are cut."""
    return F.regexp_replace(F.regexp_replace(tag, "^(?:translate|qa|fix|note)_", ""), "_seg[0-9]+$", "")


def write_pages(pages: DataFrame, path: str) -> None:
    """page, text as Parquet partitions by page; overwritten as a whole."""
    pages.write.mode("overwrite").parquet(path)


def append_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").parquet(path)


def decode_again(content: Column, known: Column, encodings: Column, strict: bool = True) -> Column:
    """encoding and text by the encoding known from an earlier scan if it still decodes, else by the candidates."""
    return decode(content, F.array_distinct(F.array_compact(F.concat(F.array(known), encodings))), strict)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def _system(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


def write_page_files(pages: DataFrame, root: str) -> DataFrame:
    """rel, size of pages (rel, html) written below root as UTF-8 files, each whole when it has its name."""

    def run(parts):
        system, at = _system(root)
        for part in parts:
            sizes = []
            for rel, html in zip(part.rel, part.html, strict=True):
                data = (html or "").encode()
                system.create_dir(f"{at}/{rel}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{at}/{rel}.part", compression=None) as out:
                    out.write(data)
                system.move(f"{at}/{rel}.part", f"{at}/{rel}")
                sizes.append(len(data))
            yield pd.DataFrame({"rel": part.rel, "size": sizes})

    return pages.select("rel", "html").mapInPandas(run, "rel string, size bigint")


def copy_files(plan: DataFrame, source: str, target: str) -> DataFrame:
    """rel, copied of a mirror plan's files."""

    def run(parts):
        import shutil

        (a, x), (b, y) = _system(source), _system(target)
        for part in parts:
            for rel in part.rel:
                b.create_dir(f"{y}/{rel}".rpartition("/")[0], recursive=True)
                with a.open_input_stream(f"{x}/{rel}", compression=None) as src, b.open_output_stream(f"{y}/{rel}", compression=None) as out:
                    shutil.copyfileobj(src, out)
            yield pd.DataFrame({"rel": part.rel, "copied": True})

    return plan.select("rel").mapInPandas(run, "rel string, copied boolean")


def backup(spark: SparkSession, path: str, stamp: str, suffix: str = "") -> str:
    """A copy of what stands at path beside it, as path.stamp[.suffix].bak; empty text if nothing does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = ".".join(x for x in (path.rstrip("/"), stamp, suffix, "bak") if x)
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(name)
    system = a.getFileSystem(conf)
    if not system.exists(a):
        return ""
    jvm.org.apache.hadoop.fs.FileUtil.copy(system, a, system, b, False, conf)
    return name


def json_strings(text: Column) -> Column:
    """Every string in a JSON value, keys left out, in order; the text itself where it isn't JSON."""
    import json

    def walk(value) -> list[str]:
        if isinstance(value, str):
            return [value]
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return [s for x in inner for s in walk(x)]

    @F.pandas_udf("array<string>")
    def run(raw: pd.Series) -> pd.Series:
        out = []
        for x in raw:
            try:
                out.append(walk(json.loads(x)))
            except (TypeError, ValueError, RecursionError):
                out.append([] if x is None else [x])
        return pd.Series(out, dtype=object)

    return run(text)


#: Preferences that travel between projects.
PREFERENCES = ("glossary", "style_refs", "style")


def preferences(settings: DataFrame) -> DataFrame:
    """Of settings (key, value) those that travel."""
    return settings.where(F.col("key").isin(*PREFERENCES))


def style_refs(rows: DataFrame) -> DataFrame:
    """Pairs with both sides."""
    return rows.where("trim(coalesce(src, '')) != '' and trim(coalesce(dst, '')) != ''")
