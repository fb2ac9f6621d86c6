"""Operators over inputs on which a bounded version would give another result."""

import numpy as np
from pyspark.sql import functions as F

from folioweave.operators import linkage, mining, stats
from folioweave.plans import catalogue


def byte_pairs(words, merges, least):
    symbols, totals = {w: list(w) for w in words}, {}
    for _ in range(merges):
        pairs = {}
        for w, s in symbols.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + words[w]
        if not pairs or max(pairs.values()) < least:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        for w, s in symbols.items():
            out = []
            for x in s:
                if out and (out[-1], x) == best:
                    out[-1] += x
                else:
                    out.append(x)
            symbols[w] = out
    for w, s in symbols.items():
        for x in s:
            if len(x) > 1:
                totals[x] = totals.get(x, 0) + words[w]
    return totals


def test_byte_pairs_of_all_types(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {"q" + "".join(letters[i // 26**k % 26] for k in range(4)): 1 for i in range(60_000)} | {"aaaaa": 40_000, "zz": 2, "b": 9}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.token: r["count"] for r in mining.byte_pairs(df, 4).collect()}
    assert got == byte_pairs(words, 4, 4)
    assert mining.byte_pairs(df.where("false")).count() == 0


def test_resample_reads_all_values(spark):
    rows = spark.range(140_000).selectExpr("if(id % 3 = 0, 'a', 'b') as g", "cast(id * id % 100003 as double) as v")
    a, b = (np.array([r.v for r in rows.where(f"g = '{g}'").orderBy(F.xxhash64("g", "v")).collect()]) for g in "ab")
    permuted, boot = [], []
    for i in range(4):
        rng = np.random.default_rng(7 + i)
        mixed = rng.permutation(np.concatenate([a, b]))
        permuted.append(abs(np.median(mixed[: len(a)]) - np.median(mixed[len(a) :])))
        boot.append(np.median(rng.choice(a, len(a))) - np.median(rng.choice(b, len(b))))
    got = stats.resample(rows, "g", "v", 4).first()
    assert got.p == (sum(x >= abs(np.median(a) - np.median(b)) for x in permuted) + 1) / 5
    assert np.allclose([got.low, got.high], np.percentile(boot, [2.5, 97.5]))


def test_link_predecessors_of_many_pages(spark):
    pages = [(i, f"a/{i % 7}/p{i}.html", i * 31 % 70 if i % 11 else None, i % 13 == 0) for i in range(70)]
    links = [(i, j) for i in range(70) for j in (0, (i * 5 + 1) % 70)]
    got = linkage.link_predecessors(spark.createDataFrame(links, "src int, dst int"), spark.createDataFrame(pages, "page int, path string, rank int, is_index boolean")).collect()
    near = lambda v, low, high: max(0.0, min(1.0, (high - v) / (high - low)))
    want = []
    for page, path, rank, _ in pages:
        scored = []
        for src in {s for s, d in links if d == page and not pages[s][3]}:
            a, c = pages[src][1].split("/"), path.split("/")
            same = next((k for k, (x, y) in enumerate(zip(a, c, strict=False)) if x != y), len(a))
            apart = 128 if rank is None or pages[src][2] is None else abs(rank - pages[src][2])
            scored.append((-round(3 * near(len(a) + len(c) - 2 * same, 2, 8) + near(apart, 1, 128), 6), pages[src][2] is None, pages[src][2], src))
        want += [(page, src, -s) for s, _, _, src in sorted(scored)[:3]]
    assert sorted((r.page, r.before, r.score) for r in got) == sorted(want)


def test_sequence_ratio_of_whole_texts(spark, tmp_path):
    a, b = "x" * 200 + "abcdefghij", "x" * 200 + "klmnopqrst"
    spark.createDataFrame([(1, 1, "user", a), (1, 2, "assistant", b)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.queries()["sequence_ratio"](spark, str(tmp_path)).collect()
    assert [(r.common, r.changes) for r in got] == [(200, 2)] and got[0].ratio < 1
