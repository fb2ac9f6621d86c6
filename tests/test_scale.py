"""Operators whose work once grew with the square of a table, against brute force."""

import difflib
import math
import random
import re
import time
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from folioweave.functions import grams, matching, references, texts_udf
from folioweave.operators import mining, ngrams, pages, similarity
from folioweave.plans import loop


def gram_set(text, n=2):
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) >= n else {text} - {""}


def dice(a, b, n=2):
    a, b = gram_set(a, n), gram_set(b, n)
    return 2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_dice_of_blocks_is_that_of_sets():
    pick = random.Random(5)
    for n in (1, 2, 3, 5):
        for letters in ("ab", "abcdefghij", "日本語🙂abc\0"):
            left, right = (["".join(pick.choices(letters, k=pick.randint(0, 12))) for _ in range(size)] for size in (60, 400))
            for threshold in (0.3, 0.8, 1.0):
                got = sorted(zip(*[c.tolist() for c in grams.like(grams.block(left, n), right, n, threshold)], strict=True))
                assert got == sorted((i, j, s) for i, a in enumerate(left) for j, b in enumerate(right) if (s := dice(a, b, n)) >= threshold and s)


def test_dice_pairs_in_one_pass(spark, monkeypatch):
    pick = random.Random(3)
    words = ["".join(pick.choices("abcde", k=5)) for _ in range(12)]
    left, right = ([(i, "".join(pick.choices(words, k=4))) for i in range(size)] for size in (90, 500))
    right += [(1000 + i, left[0][1]) for i in range(20)] + [(None, left[0][1]), (1, None), (2, " .")]
    a, b = spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "id long, text string")
    for name in ("BLOCK_TEXTS", "GROUP", "ROWS"):  # several blocks, groups and batches
        monkeypatch.setattr(similarity, name, 40)
    want = sorted((x, -half_up(s), y) for x, t in left for y, u in right if y is not None and (s := dice(t, u or "")) >= 0.6)
    pairs = similarity.dice_pairs(a, b.where("id is not null"), 0.6)
    assert sorted((r.l_id, -r.score, r.r_id) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().toString()
    assert "explode" not in plan and "Join" not in plan  # no gram is a row, no text meets another in a shuffle
    best = [row for at, row in enumerate(want) if at < 3 or want[at - 3][0] != row[0]]
    got = similarity.top_k(similarity.dice_pairs(a, b.where("id is not null"), 0.6, k=3), 3, "l_id", "score", "r_id")
    assert sorted((r.l_id, -r.score, r.r_id) for r in got.collect()) == best
    assert similarity.dice_pairs(a, b.where("id is null"), 0.99).select("l_id").distinct().orderBy("l_id").first().l_id == 0
    assert similarity.dice_pairs(a.where(F.lit(False)), b, 0.6).count() == 0


def test_matching_is_difflibs():
    pick = random.Random(7)
    for letters, size in (("ab", 30), ("abcdefgh", 60), ("日本語abc", 40), ("etaoin shrdlucmfwypvbgkjqxz" + "etaoins " * 9, 420)):
        for _ in range(60):
            a, b = ("".join(pick.choices(letters, k=pick.randint(0, size))) for _ in range(2))
            b += "".join(a[at : at + 9] for at in range(0, len(a), 17)) if pick.random() < 0.5 else ""
            plain = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert matching.Index(b).longest(a) == tuple(plain.find_longest_match()), (a, b)
            for least in (1, 3, 4, 6):
                assert matching.Index(b).blocks(a, least) == [(m.b, m.size) for m in plain.get_matching_blocks() if m.size >= least]
            for x, y in ((a, b), (b, a), (a * 9, b * 9)):
                assert matching.ratio(x, y) == difflib.SequenceMatcher(None, x, y).ratio(), (x, y)


def test_tail_of_a_long_page():
    pick = random.Random(1)
    lines = ["".join(pick.choices("abcdefghijklmnop", k=60)) for _ in range(1500)]
    said = [line[:30] + "#" + line[31:] for line in lines[:1200]]  # none stands in the page as it is
    began = time.process_time()
    assert references.uncovered_tail("\n".join(lines), said) == "\n".join(lines[1200:])
    assert time.process_time() - began < 10


def test_checks_hold_a_reference_once(spark):
    text = "The first line of a page. " * 30
    rows = spark.createDataFrame([(1, i, "text", f"{i} {text[:300]}", f"{i} {text[:300]}" if i % 2 else f"{text[100:150]} {i} wrong {text[:90]}") for i in range(8)], "page int, id int, kind string, text string, translation string")
    refs = spark.createDataFrame([(1, "\n".join(f"{i} {text[:300]}" for i in range(8))), (2, text)], "page int, text string")
    found = pages.checked(rows, refs)
    want = {r.id: references.check(refs.first().text, r.translation, r.text) for r in rows.collect()}
    assert {r.id: (r.score, r.fragment, r.diff, r.covered) for r in found.collect()} == {i: (w["score"], w["fragment"], w["diff"], w["covered"]) for i, w in want.items() if w}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Join") < joined.index("collect_list")  # the reference meets a page's segments as one row


def test_many_items_of_a_page_are_judged(spark):
    def judge(said, i, item):
        return f'{{"verdict": "adopt", "reason": "{["profile of nobody", item["profile"], "about item %d of many" % (7 * i)][i % 3]}"}}'

    rows = [{"page": "p", "id": i, "profile": f"this is about item {i} of many"} for i in range(1200)]
    profiles = [r["profile"] for r in rows]
    small = {i: judge([], i, rows[i]) for i in range(40)}
    common = {i: [texts_udf.longest_common(reply, x) for x in profiles[:40]] for i, reply in small.items()}
    for margin in (-1, 0, 1, 2, 6):
        want = {i for i, c in common.items() if max(x for j, x in enumerate(c) if j != i) - c[i] >= margin}
        assert loop.fits_another(profiles[:40], small, margin) == want
    began = time.process_time()
    assert len(loop.fits_another(profiles, {i: judge([], i, r) for i, r in enumerate(rows)}, 1)) > 100
    assert time.process_time() - began < 10
    found = loop.adjudicated(spark.createDataFrame([{**r, "profile": "p"} for r in rows], "page string, id long, profile string"), judge)
    assert {(r.verdict, r.drift) for r in found.collect()} == {("adopt", False)}


def test_c_value_moves_little_and_counts_exactly(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 500)
    pick = random.Random(2)
    names = ["".join(pick.choices("abcdefgh", k=4)) for _ in range(300)]
    passage = " ".join(pick.choices(names, k=30))
    texts = [" ".join(pick.choices(names, k=pick.randint(0, 60))) + (f", {passage} " if i % 9 == 0 else " x x x x x x x x") for i in range(120)] + [None, ""]
    counts, value = Counter(), {}
    for text in texts:
        w = re.findall("[A-Za-z]+", text or "")
        counts.update((n, tuple(w[i : i + n])) for n in range(1, 7) for i in range(len(w) - n + 1))
    kept = {g: c for (n, g), c in counts.items() if c >= 3}
    for g, c in kept.items():
        held = [f for o, f in kept.items() if len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))]
        value[" ".join(g)] = (c, math.log2(len(g) + 1) * (c - (sum(held) / len(held) if held else 0)))
    found = mining.c_value(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r.src: (r["count"], r.value) for r in found.collect()}
    assert got.keys() == value.keys() and all(got[s][0] == c and abs(got[s][1] - v) < 1e-5 for s, (c, v) in value.items())
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "explode" not in plan  # no row a word, no string a place
