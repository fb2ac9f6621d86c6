"""License scans: phrases, and an exact containment join of text blocks with notice templates.

A block is a window of consecutive words, of a template's number of words divided by the threshold, wherever it starts and
whatever line ends lie inside; a shorter text is one block. It matches a template if it holds at least ``need`` of the
template's distinct words, all words that the template requires and none that it forbids. A block may be moved to start at
a word of the vocabulary, so only those starts are looked at.

The texts are scanned once: phrases are counted and the words shared with the vocabulary are kept, with their places only
where the text as a whole could hold some template (length filter on the text). Words are put in one global order, rarest in
the corpus first (document counts over all rows). If a block holds ``need`` of a template's words, then the first
``size - need + 1`` words of each, in that order, meet (prefix filter); the sets must be large enough (length filter), and what
can still follow the meeting words on both sides must reach ``need`` (positional filter). What is left is verified exactly. The
templates are a fixed list, so their prefix index is a literal of known size; nothing else is broadcast by request.

All of it is DataFrame functions: no Python runs on the executors.

Defined results: null text is empty (0 words, no label, score 0); a text without phrases has null first_word and
last_word; rows with equal doc_id and text get equal results, each its own row; null ids are kept; an empty table gives an
empty result; other columns are ignored. score is 1 with a base place, else the best template containment found, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases with their labels; notice templates with theirs, the words that they require, and those that they forbid.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("bsd", "released under the bsd license", "bsd", ""),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4", "noncommercial noderivatives noderivs sharealike"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4", "nc nd sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4", "nd sa"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general redistribute", "affero lesser library"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general 3", "affero lesser library"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser", ""),
    ("mit", "released under the mit license", "mit", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted copy software", ""),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", "mozilla 2", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
)
THRESHOLD = 0.8


def _need(size: int, threshold: float) -> int:
    """Words of a template of that size that a block must hold."""
    return math.ceil(size * threshold - 1e-9)


def _count_words(norm):
    """Words of a text in which single blanks part them; blanks around it don't count."""
    trimmed = F.trim(norm)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _folded(text):
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class Notices:
    """Templates as sets: their words, how many of them a block must hold, and how long it may be."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.labels = [label for label, *_ in templates]
        self.sets = [sorted(set(text.split())) for _, text, *_ in templates]
        self.needs = [_need(len(s), threshold) for s in self.sets]
        self.widths = [math.ceil(len(text.split()) / threshold - 1e-9) for _, text, *_ in templates]
        self.required = [sorted(set(words.split())) for _, _, words, _ in templates]
        self.forbidden = [sorted(set(words.split())) for *_, words in templates]
        self.vocabulary = sorted(set().union(*self.sets, *self.forbidden))


def _literal(words: list[str]):
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def scanned(docs: DataFrame, notices: Notices, phrases=PHRASES) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base (labels), present (words of the vocabulary) and hits (their
    places, null where no template can be held) of each row of doc_id, text: one pass over the texts."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.concat(F.lit(" "), F.trim(F.regexp_replace(_folded(F.col("text")), NOT_WORD, " ")), F.lit(" ")).alias("padded"))
    rows = rows.withColumn("n_words", _count_words(F.col("padded")))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in phrases:
        inside = F.lit(f" {phrase} ")
        has = F.col("padded").contains(inside)
        counts.append(F.when(has, F.regexp_count("padded", F.lit(f" (?={phrase} )"))).otherwise(0))
        firsts.append(F.when(has, _count_words(F.substring_index("padded", f" {phrase} ", 1))))
        lasts.append(F.when(has, F.col("n_words") - len(phrase.split()) - _count_words(F.substring_index("padded", f" {phrase} ", -1))))
        labels.append(F.when(has, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    vocabulary = _literal(notices.vocabulary)
    rows = rows.select("doc_id", "key", "n_words", total.cast("bigint").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), F.split(F.trim("padded"), " ").alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", vocabulary))
    could = F.lit(False)
    for words, need, required in zip(notices.sets, notices.needs, notices.required, strict=True):
        fits = F.size(F.array_intersect("present", _literal(words))) >= need
        for word in reversed(required):
            fits = F.array_contains("present", word) & fits
        could = could | fits
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains(vocabulary, x.word))
    return rows.withColumn("hits", F.when(could, places)).drop("words")


def token_order(facts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each vocabulary word: by the rows that hold it, fewest first. At most len(vocabulary) rows are fetched."""
    counted = {r.word: r["count"] for r in facts.select(F.explode("present").alias("word")).groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}


def matching_blocks(facts: DataFrame, notices: Notices) -> DataFrame:
    """doc_id, key, template (its number), label, score of every template that some block of the text matches."""
    order = token_order(facts, notices.vocabulary)
    least = min(notices.needs)
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    index, prefixes = [], set()
    listed = lambda words: f"array({', '.join(map(str, sorted(order[w] for w in words)))})" if words else "cast(array() as array<int>)"
    for n, (label, words, need, width, required, forbidden) in enumerate(zip(notices.labels, notices.sets, notices.needs, notices.widths, notices.required, notices.forbidden, strict=True)):
        ranked = sorted(order[w] for w in words)
        prefixes.update(ranked[: len(ranked) - need + 1])
        index += [f"({n}, '{label}', {listed(words)}, {need}, {width}, {listed(required)}, {listed(forbidden)}, {at}, {rank})" for at, rank in enumerate(ranked[: len(ranked) - need + 1])]
    index = facts.sparkSession.sql(f"select * from values {', '.join(index)} as t(template, label, of, need, width, required, forbidden, of_at, rank)")
    hits = facts.where(F.col("hits").isNotNull()).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.explode("hits").alias("hit"))
    hits = hits.select("doc_id", "key", F.col("hit.pos").alias("pos"), F.element_at(ranks, F.col("hit.word")).alias("rank"))
    ahead = Window.partitionBy("doc_id", "key").orderBy("pos").rangeBetween(0, max(notices.widths) - 1)
    blocks = hits.select("doc_id", "key", "pos", F.collect_list(F.struct("pos", "rank")).over(ahead).alias("held"))
    blocks = blocks.withColumn("ranks", F.array_sort(F.array_distinct(F.transform("held", lambda x: x.rank))))
    blocks = blocks.where((F.size("ranks") >= least) & F.arrays_overlap("ranks", F.array(*map(F.lit, sorted(prefixes)))))
    probes = blocks.select("doc_id", "key", "pos", "held", "ranks", F.posexplode(F.slice("ranks", 1, F.size("ranks") - least + 1)).alias("at", "rank"))
    pairs = probes.join(F.broadcast(index), "rank")  # a fixed list: its size is the templates'
    pairs = pairs.where((F.size("ranks") >= F.col("need")) & (F.least(F.size("ranks") - F.col("at"), F.size("of") - F.col("of_at")) >= F.col("need")))
    own = F.array_distinct(F.transform(F.filter("held", lambda x: x.pos < F.col("pos") + F.col("width")), lambda x: x.rank))
    pairs = pairs.withColumn("own", own).withColumn("overlap", F.size(F.array_intersect("own", "of"))).where(F.col("overlap") >= F.col("need"))
    pairs = pairs.where((F.size(F.array_except("required", "own")) == 0) & (F.size(F.array_intersect("forbidden", "own")) == 0))
    return pairs.groupBy("doc_id", "key", "template").agg(F.first("label").alias("label"), F.max(F.col("overlap") / F.size("of")).alias("score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    docs = common.only(docs, id_col, text_col).toDF("doc_id", "text")
    notices = Notices()
    base = common.written(scanned(docs, notices), "licenses")
    found = matching_blocks(base, notices).groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.withColumnsRenamed({"doc_id": "of_id", "key": "of_key"})
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same result in DuckDB's SQL: every block that starts at a word of a template, against that template, no filter."""
    count = lambda s: f"(case when trim({s}, ' ') = '' then 0 else length(trim({s}, ' ')) - length(replace(trim({s}, ' '), ' ', '')) + 1 end)"
    fold = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    places = " union all ".join(f"select doc_id, key, '{label}' as label, {len(p.split())} as size, i as place from words, unnest(range(n_words)) as r(i) where " + " and ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) for p, label in PHRASES)
    notices = Notices()
    listed = lambda words: f"[{', '.join(map(repr, words))}]::varchar[]"
    templates = ", ".join(f"('{label}', {listed(words)}, {need}, {width}, {listed(required)}, {listed(forbidden)})" for label, words, need, width, required, forbidden in zip(notices.labels, notices.sets, notices.needs, notices.widths, notices.required, notices.forbidden, strict=True))
    return f"""
    with rows as (select doc_id, md5(coalesce(text, '')) as key, trim(regexp_replace({fold}, '{NOT_WORD}', ' ', 'g'), ' ') as norm from documents),
    words as (select doc_id, key, string_split(norm, ' ') as w, cast({count('norm')} as bigint) as n_words from rows),
    places as ({places}),
    base as (select doc_id, key, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by all),
    templates(label, words, need, width, required, forbidden) as (values {templates}),
    able as (select distinct doc_id, key, w, n_words, label, words, need, width, required, forbidden from words, templates where list_has_all(w, required)),
    starts as (select doc_id, key, label, words, need, required, forbidden, w[i + 1 : i + width] as block from able, unnest(range(n_words)) as r(i) where list_contains(words, w[i + 1])),
    scored as (select doc_id, key, label, len(list_intersect(block, words)) / len(words) as score from starts where len(list_intersect(block, words)) >= need and list_has_all(block, required) and not list_has_any(block, forbidden)),
    blocks as (select doc_id, key, list(distinct label) as more, max(score) as best from scored group by all)
    select w.doc_id, w.n_words, cast(coalesce(b.n_base, 0) as bigint) as n_base, cast(b.first_word as bigint) as first_word, cast(b.last_word as bigint) as last_word,
      coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.more, [])))), ','), '') as labels,
      cast(case when b.n_base > 0 then 1 else coalesce(k.best, 0) end as double) as score
    from words w left join base b on w.doc_id is not distinct from b.doc_id and w.key = b.key left join blocks k on w.doc_id is not distinct from k.doc_id and w.key = k.key
    """
